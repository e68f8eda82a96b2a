"""Queries of scalar functions, over awkward values made of the tables that both engines read and DuckDB works out by itself."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from hearthledger.functions import dates, descriptions, names, privacy
from hearthledger.functions import text as T
from hearthledger.operators import balances, classify
from hearthledger.plans.registry import query
from hearthledger.sources.fixtures import frame


def _case(of: str, values: list[str]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _shaped(column: str, shapes: list[str]) -> str:
    """SQL for both engines: a value for each order, of one of the shapes around numbers and words of the tables ({d}, {t} of two digits, {w} a word)."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    parts = lambda shape: [x[1] if x in ("{d}", "{t}", "{w}") else quoted(x) for x in re.split(r"(\{[dtw]\})", shape) if x]
    values = [f"concat({', '.join(parts(shape))}, '')" if shape else "''" for shape in shapes]
    return f"SELECT {_case(f'k % {len(shapes)}', values)} AS {column} FROM (SELECT o_orderkey AS k, CAST(o_orderkey % 900 + 1 AS VARCHAR(9)) AS d, CAST(o_custkey % 90 + 10 AS VARCHAR(9)) AS t, split_part(p_name, ' ', 1) AS w FROM orders JOIN part ON p_partkey = o_orderkey % 40) x"


# Amounts as printed, well and badly, around the digits of every line of a bill.
_SHAPES = ["{d}", "${d}", "-{d}", "({d})", "{d}-", "{d} CR", "{d}cr", "(${d})", "-${d}", "$ {d}", " {d} ", "({d}", "{d})", "--{d}", "{d}x", "({d}) CR", "-({d})", "( -{d} )", "{d} -", "+{d}", "$", "CR", "{d} USD"]
_DIGITS = ["CAST(l_orderkey AS VARCHAR(20))", "concat(CAST(l_linenumber AS VARCHAR(9)), ',', lpad(CAST(l_orderkey % 1000 AS VARCHAR(9)), 3, '0'), '.', lpad(CAST(l_partkey % 100 AS VARCHAR(9)), 2, '0'))",
           "concat(CAST(l_linenumber AS VARCHAR(9)), '.', CAST(l_partkey % 10 AS VARCHAR(9)))", "concat(CAST(l_orderkey AS VARCHAR(20)), '.005')", "concat('1,2,', CAST(l_linenumber AS VARCHAR(9)))", "concat('12,34,', CAST(l_linenumber AS VARCHAR(9)), '.6')", "concat(',', CAST(l_linenumber AS VARCHAR(9)))", "concat(CAST(l_linenumber AS VARCHAR(9)), ',23')", "concat('.', CAST(l_linenumber AS VARCHAR(9)))", "concat('1234,567.', CAST(l_linenumber AS VARCHAR(9)))"]


_SHAPED = [" || ".join([f"'{p}'" for p in [s.split("{d}")[0]] if p] + (["d"] if "{d}" in s else []) + [f"'{p}'" for p in s.split("{d}")[1:] if p]) or "d" for s in _SHAPES]
_PRINTED = f"SELECT l_orderkey, l_linenumber, {_case(f'(l_orderkey + l_partkey * 3) % {len(_SHAPES)}', _SHAPED)} AS printed FROM (SELECT l_orderkey, l_linenumber, l_partkey, {_case(f'l_partkey % {len(_DIGITS)}', _DIGITS)} AS d FROM lineitem) t"


@query("parse_money", f"""WITH p AS ({_PRINTED}), b AS (SELECT *, upper(replace(replace(printed, ' ', ''), '$', '')) AS x FROM p WHERE TRUE),
s AS (SELECT *, CASE WHEN ends_with(x, 'CR') THEN left(x, len(x) - 2) ELSE x END AS y FROM b), u AS (SELECT *, CASE WHEN ends_with(y, '-') THEN left(y, len(y) - 1) ELSE y END AS z FROM s),
v AS (SELECT *, CASE WHEN starts_with(z, '(') AND ends_with(z, ')') THEN z[2:-2] ELSE z END AS w FROM u), q AS (SELECT *, CASE WHEN starts_with(w, '-') THEN w[2:] ELSE w END AS n FROM v)
SELECT l_orderkey, l_linenumber, printed, CASE WHEN (regexp_full_match(n, '[0-9]+(\\.[0-9]{{1,2}})?') OR regexp_full_match(n, '[0-9]{{1,3}}(,[0-9]{{3}})+(\\.[0-9]{{1,2}})?')) AND NOT starts_with(printed, '-(')
  THEN CAST(CAST(replace(n, ',', '') AS DECIMAL(18,2)) * 100 AS BIGINT) * CASE WHEN n = x THEN 1 ELSE -1 END END AS minor FROM q""".replace("\\\\", "\\"))  # fmt: skip
def _(s, d):
    rows = frame(s, d, _PRINTED)
    return rows.select("l_orderkey", "l_linenumber", "printed", T.money_minor(F.col("printed")).alias("minor"))


# Descriptions with the words that decide a kind, whole and inside others.
_KIND_WORDS = ["PAYMENT THANK YOU", "AUTOPAY", "pmt received", "CRD PMT 12", "CREDIT CARD PAYMENT", "EPAY 7", "INTEREST CHARGED", "LATE FEE", "SERVICE FEES WAIVED", "ONLINE TRANSFER TO SAVINGS", "TRANSFERS", "WIRE SUPPLY STORE",
               "ZELLE PIZZA", "THANK YOU BAKERY", "COFFEE HOUSE", "REPAYMENTS LTD", "INTERESTING BOOKS", "COFFEE", "ANNUAL MEMBERSHIP FEE", "FEE INTEREST TRANSFER"]
_HINTS = ["NULL", "NULL", "NULL", "'payment_or_refund'", "'adjustment'"]
_KINDS = f"""SELECT o_orderkey AS id, {_case(f'o_orderkey % {len(_KIND_WORDS)}', [f"'{w}'" for w in _KIND_WORDS])} AS clean, {_case(f'o_custkey % {len(_HINTS)}', _HINTS)} AS hint,
  CASE o_orderkey % 3 WHEN 0 THEN 'checking' WHEN 1 THEN 'credit' ELSE 'savings' END AS account_type, CASE WHEN o_custkey % 2 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(-5 AS BIGINT) END AS amount_minor FROM orders"""


_HAS = lambda words: f"len(list_intersect(string_split(upper(clean), ' '), {words})) > 0"


@query("kind_resolution", f"""WITH k AS ({_KINDS}) SELECT id, CASE WHEN hint = 'payment_or_refund' THEN CASE WHEN {_HAS("['PAYMENT', 'AUTOPAY', 'PMT']")} THEN 'payment' ELSE 'refund' END WHEN hint IS NOT NULL THEN hint
  WHEN account_type <> 'credit' AND {_HAS("['PAYMENT', 'AUTOPAY', 'PMT', 'EPAY']")} THEN 'transfer' WHEN {_HAS("['INTEREST']")} THEN 'interest' WHEN {_HAS("['FEE']")} THEN 'fee' WHEN {_HAS("['TRANSFER']")} THEN 'transfer'
  WHEN {_HAS("['PAYMENT', 'AUTOPAY', 'PMT']")} THEN 'payment' WHEN amount_minor >= 0 THEN 'purchase' ELSE 'refund' END AS kind FROM k""")  # fmt: skip
def _(s, d):
    rows = frame(s, d, _KINDS)
    return rows.select("id", T.kind(F.col("hint"), F.col("clean"), F.col("amount_minor"), F.col("account_type")).alias("kind"))


_MINORS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) * CASE WHEN o_orderkey % 4 = 0 THEN 1000 ELSE 1 END AS minor FROM orders"


@query("money_formatting", f"WITH m AS ({_MINORS}) SELECT id, concat(CASE WHEN minor < 0 THEN '-' ELSE '' END, '$', format('{{:,}}', abs(minor) // 100), '.', lpad(CAST(abs(minor) % 100 AS VARCHAR), 2, '0')) AS shown, CAST(CAST(minor / 100 AS DECIMAL(20,2)) AS VARCHAR) AS plain FROM m")
def _(s, d):
    return frame(s, d, _MINORS).select("id", T.money_text(F.col("minor")).alias("shown"), T.money_plain(F.col("minor")).alias("plain"))


_INPUTS = ["{d},234.56", "${d}", "{d}.5", "{d}.005", "{d}.0049", ".{d}", "{d}.", "-{d}", "abc{d}", "", "  ${d}.999 ", "1.{d}.3", "$", "{d}e3"]


@query("balance_input", f"WITH v AS ({_shaped('raw', _INPUTS)}), b AS (SELECT raw, replace(regexp_replace(trim(raw), '^\\$', ''), ',', '') AS n FROM v) SELECT raw, CASE WHEN regexp_full_match(n, '[0-9]*[.]?[0-9]+|[0-9]+[.]') THEN CAST(floor(CAST(regexp_replace(n, '([.][0-9]{{3}}).*', '\\1') AS DECIMAL(18,3)) * 100 + 0.5) AS BIGINT) END AS minor FROM b")
def _(s, d):
    return frame(s, d, _shaped("raw", _INPUTS)).select("raw", balances.input_minor(F.col("raw")).alias("minor"))


_DECIMALS = ["{d},234.565", "$-{d}.5", "({d})", "{d}e3", "abc{d}", "NaN", "", "  -{d}.004 ", "999999999{d}.99", "--{d}"]


@query("model_amounts", f"WITH v AS ({_shaped('raw', _DECIMALS)}) SELECT raw, CASE WHEN lower(raw) <> 'nan' THEN CAST(round(TRY_CAST(CAST(TRY_CAST(regexp_replace(trim(raw), '[$, ()]', '', 'g') AS DOUBLE) AS DECIMAL(30,6)) AS DECIMAL(30,6)) * 100) AS BIGINT) END AS minor FROM v")
def _(s, d):
    return frame(s, d, _shaped("raw", _DECIMALS)).select("raw", T.decimal_minor(F.col("raw")).alias("minor"))


_NAMES = ["Blue  {w} ", "{w}&B-Store #{d}", "___", "Zoë {w}'s", "online_{w}", "ONE {w}", "{d} lives", ""]


@query("names_and_labels", rf"""WITH v AS ({_shaped('raw', _NAMES)}), s AS (SELECT raw, trim(regexp_replace(lower(raw), '[^a-z0-9]+', '_', 'g'), '_') AS k, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS q FROM v)
SELECT raw, CASE WHEN k = '' THEN 'unknown' ELSE k END AS slug, CASE WHEN q <> '' THEN q END AS account_name, lower(q) AS label,
  array_to_string(list_transform(string_split(raw, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS titled, CASE WHEN raw = '' THEN 'Bank credit' ELSE concat('Bank credit ...', raw) END AS display FROM s""")  # fmt: skip
def _(s, d):
    raw = F.col("raw")
    return frame(s, d, _shaped("raw", _NAMES)).select(
        "raw", names.slug(raw).alias("slug"), names.account_name(raw).alias("account_name"), names.label(raw).alias("label"), names.titled(raw).alias("titled"), names.account_display(F.lit("Bank"), F.lit("credit"), raw).alias("display")
    )


_BOXES = ["Box {d}A", "int : {d}", "st", "box LT", "b:st", "{d}", " {d} a ", "BOX int:{d}"]


@query("form_boxes", f"WITH v AS ({_shaped('raw', _BOXES)}), c AS (SELECT raw, regexp_replace(replace(raw, ' ', ''), '^(?i)box', '') AS t FROM v), p AS (SELECT raw, t, string_split(t, ':')[-1] AS n FROM c), u AS (SELECT *, CASE WHEN upper(n) IN ('ST', 'LT') THEN upper(n) ELSE lower(n) END AS m FROM p) SELECT raw, CASE WHEN contains(t, ':') THEN concat(upper(string_split(t, ':')[1]), ':', m) ELSE m END AS box FROM u")
def _(s, d):
    return frame(s, d, _shaped("raw", _BOXES)).select("raw", names.box(F.col("raw")).alias("box"))


_FILES = ["a/b/My File ({d}).pdf", "../../{w}/passwd", "", "résumé{d}.pdf", "{w}{d}/", "ok-{w}_{d}.PDF"]


@query("file_names", f"WITH v AS ({_shaped('raw', _FILES)}), b AS (SELECT raw, string_split(rtrim(raw, '/'), '/')[-1] AS n FROM v) SELECT raw, regexp_replace(CASE WHEN n = '' THEN 'statement.pdf' ELSE n END, '[^A-Za-z0-9._ -]', '_', 'g') AS name FROM b")
def _(s, d):
    return frame(s, d, _shaped("raw", _FILES)).select("raw", names.file_name(F.col("raw")).alias("name"))


_TINS = ["9{t}-34-56{t}", "{t}-00000{t}", "***-**-43{t}", "{t}", "{w} {t}-34567{t} Inc", "name 1{t} 45 67{t} end", "runs 12345{t} and 1234567890{t}", "plain {w}", "CA", "St. 1234{t} x"]


@query("taxpayer_numbers", r"""WITH v AS (__V__), m AS (SELECT raw, regexp_replace(raw, '[^0-9]', '', 'g') AS d, regexp_replace(regexp_replace(raw, '(^|[^0-9])[0-9]{3}[- ]?[0-9]{2}[- ]?([0-9]{4})($|[^0-9])', '\1***-**-\2\3', 'g'), '(^|[^0-9])[0-9]{2}-?[0-9]{3}([0-9]{4})($|[^0-9])', '\1**-***\2\3', 'g') AS s FROM v)
SELECT raw, CASE WHEN len(d) >= 4 THEN right(d, 4) END AS last_four, s AS scrubbed, regexp_matches(raw, '[0-9]{6,}') OR s <> raw AS has_number,
  CASE WHEN regexp_matches(s, '[A-Za-z]') THEN rtrim(left(s, 32)) END AS jurisdiction FROM m""".replace("__V__", _shaped("raw", _TINS)))  # fmt: skip
def _(s, d):
    raw = F.col("raw")
    return frame(s, d, _shaped("raw", _TINS)).select("raw", privacy.last_four(raw).alias("last_four"), privacy.scrubbed(raw).alias("scrubbed"), privacy.has_number(raw).alias("has_number"), privacy.jurisdiction(raw).alias("jurisdiction"))


@query("forbidden_shapes", rf"""SELECT doc_id, CASE WHEN regexp_matches(text, '\d{{6,}}') THEN 'long_digit_run' WHEN regexp_matches(text, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}.+-]+@[\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}-]+\.[\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]+') THEN 'email'
  WHEN regexp_matches(text, '\+?\d[\d\-\(\) ]{{8,}}\d') THEN 'phone' WHEN regexp_matches(text, '\$\s?\d') THEN 'currency_amount' WHEN regexp_matches(text, '\b\d{{4}}-\d{{2}}-\d{{2}}\b') THEN 'iso_date' END AS shape FROM documents""")  # fmt: skip
def _(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", privacy.forbidden(F.col("text")).alias("shape"))


# A user's own entries: names of the first parts and numbers of the first customers; lines hold those and others, in several spellings.
_OWN = "SELECT DISTINCT p_name AS entry FROM part WHERE p_partkey < 6 UNION ALL SELECT concat('555-', CAST(100 + c_custkey AS VARCHAR(9)), '-', CAST(2000 + c_custkey AS VARCHAR(9))) AS entry FROM customer WHERE c_custkey < 6 UNION ALL SELECT concat('Flat ', CAST(s_suppkey AS VARCHAR(9)), ' ', CAST(s_nationkey AS VARCHAR(9))) AS entry FROM supplier WHERE s_suppkey < 3"
_PEOPLE = """SELECT o_orderkey AS id, o_custkey AS ref, CAST(o_orderkey % 9 AS INT) AS way, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, CAST(100 + o_custkey % 14 AS VARCHAR(9)) AS x, CAST(2000 + o_custkey % 14 AS VARCHAR(9)) AS y, p_name AS name, CAST(s_suppkey AS VARCHAR(9)) AS flat, CAST(s_nationkey AS VARCHAR(9)) AS door
  FROM orders JOIN part ON p_partkey = o_orderkey % 60 JOIN supplier ON s_suppkey = o_orderkey % 7"""
_LINES = f"""SELECT id, ref, way, name, x, y, flat, door, concat('To ', CASE way WHEN 0 THEN upper(name) WHEN 1 THEN concat(b, ', ', a) WHEN 2 THEN concat(a, ' Q. ', b) WHEN 3 THEN concat(a, 's ', b) WHEN 4 THEN concat('(555) ', x, '.', y) WHEN 5 THEN concat('+1 555', x, y)
  WHEN 6 THEN concat('x555 ', x, ' / ', y) WHEN 7 THEN concat('flat ', flat, ', ', door) ELSE concat(b, ' ', a, ' R.') END, ' ref ', CAST(ref AS VARCHAR(20))) AS line FROM ({_PEOPLE}) p"""


@query("personal_entries", f"""WITH l AS ({_LINES}), own AS ({_OWN}), e AS (SELECT *, CASE WHEN way IN (0, 1, 2, 8) THEN CASE WHEN name IN (FROM own) THEN '[NAME]' END WHEN way IN (4, 5, 6) THEN CASE WHEN concat('555-', x, '-', y) IN (FROM own) THEN concat(CASE way WHEN 6 THEN 'x' ELSE '' END, '[PHONE]') END WHEN way = 7 THEN CASE WHEN concat('Flat ', flat, ' ', door) IN (FROM own) THEN '[REDACTED]' END END AS token FROM l)
SELECT id, CASE WHEN token IS NULL THEN line ELSE concat('To ', token, ' ref ', CAST(ref AS VARCHAR)) END AS line, CASE WHEN token = '[NAME]' THEN 1 ELSE 0 END AS n_names FROM e""")  # fmt: skip
def _(s, d):
    own = [r["entry"] for r in frame(s, d, _OWN).collect()]  # a user's own, a dozen
    return frame(s, d, _LINES).select("id", privacy.personal(F.col("line"), own).alias("_p")).select("id", F.col("_p.text").alias("line"), F.col("_p.counts")["[NAME]"].alias("n_names"))


_STORES = """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'AMZN Mktp US order' WHEN 1 THEN 'WAL-MART SUPERCENTER 12' WHEN 2 THEN 'uber eats x' WHEN 3 THEN 'UBER TRIP' WHEN 4 THEN 'sbux amzn' WHEN 5 THEN 'corner shop' ELSE 'x netflix.com netflix' END AS line FROM orders"""


@query("store_aliases", f"WITH l AS ({_STORES}) SELECT id, CASE id % 7 WHEN 0 THEN 'Amazon order' WHEN 1 THEN 'Walmart 12' WHEN 2 THEN 'Uber Eats x' WHEN 3 THEN 'Uber' WHEN 4 THEN 'sbux Amazon' WHEN 5 THEN 'corner shop' ELSE 'x Netflix netflix' END AS line FROM l")
def _(s, d):
    return frame(s, d, _STORES).select("id", names.store_alias(F.col("line")).alias("line"))


# Printed dates of every order, in the ways of statements; the period is the order's month.
_DATES = """SELECT o_orderkey AS id, CAST(date_trunc('month', o_orderdate) AS DATE) AS period_start, last_day(CAST(o_orderdate AS DATE)) AS period_end, CAST(o_orderdate AS DATE) AS dated,
  year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, CAST(o_orderkey % 7 AS INT) AS way FROM orders"""
_SHORT = _case("m - 1", [f"'{x}'" for x in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()])
_LONG = _case("m - 1", [f"'{x}'" for x in "January February March April May June July August September October November December".split()])
_SHOWN = f"""SELECT id, period_start, period_end, dated, way, CASE way WHEN 0 THEN concat(CAST(m AS VARCHAR(2)), '/', CAST(dd AS VARCHAR(2)), '/', CAST(y AS VARCHAR(4))) WHEN 1 THEN concat(lpad(CAST(m AS VARCHAR(2)), 2, '0'), '-', lpad(CAST(dd AS VARCHAR(2)), 2, '0'), '-', substring(CAST(y AS VARCHAR(4)), 3, 2))
  WHEN 2 THEN concat({_SHORT}, ' ', CAST(dd AS VARCHAR(2)), ', ', CAST(y AS VARCHAR(4))) WHEN 3 THEN concat({_LONG}, ' ', CAST(dd AS VARCHAR(2)), ' ', CAST(y AS VARCHAR(4))) WHEN 4 THEN concat(CAST(m AS VARCHAR(2)), '/', CAST(dd AS VARCHAR(2)))
  WHEN 5 THEN concat({_SHORT}, ' ', CAST(dd AS VARCHAR(2))) ELSE concat(CAST(m + 13 AS VARCHAR(2)), '/', CAST(dd AS VARCHAR(2)), '/', CAST(y AS VARCHAR(4))) END AS printed FROM ({_DATES}) t"""  # fmt: skip


@query("printed_dates", f"WITH p AS ({_SHOWN}) SELECT id, printed, CASE WHEN way < 6 THEN dated END AS in_period, CASE WHEN way < 4 THEN dated END AS with_year, CASE WHEN way < 6 THEN dated END AS near_anchor FROM p")
def _(s, d):
    rows = frame(s, d, _SHOWN).withColumn("_p", dates.parts(F.col("printed")))
    return rows.select("id", "printed", dates.in_period(F.col("_p"), F.col("period_start"), F.col("period_end")).alias("in_period"), dates.full(F.col("printed")).alias("with_year"), dates.near_anchor(F.col("_p"), F.col("period_end")).alias("near_anchor"))


_SURE = "SELECT o_orderkey AS id, (o_orderkey % 21) / 20.0 AS score, CASE WHEN o_orderkey % 3 > 0 THEN 'bank' END AS issuer FROM orders"


@query("parser_confidence", f"SELECT id, issuer IS NOT NULL AND score >= 0.8 AS sure FROM ({_SURE})")
def _(s, d):
    return frame(s, d, _SURE).select("id", classify.sure(F.col("score"), F.col("issuer")).alias("sure"))


# Raw descriptions with all that the steps take away or replace, around names of parts.
_RAW = """SELECT o_orderkey AS id, CAST(o_orderkey % 6 AS INT) AS way, p_name AS name, CASE o_orderkey % 6 WHEN 0 THEN concat('POS DEBIT   ', p_name, ' $12.50') WHEN 1 THEN concat('SQ *', p_name, ' REF#', CAST(o_orderkey AS VARCHAR(20))) WHEN 2 THEN concat(p_name, ' Lee, Ann') WHEN 3 THEN concat('amzn mktp us ', p_name)
  WHEN 4 THEN concat('ＣＡＦＥ ', p_name) ELSE concat(p_name, ' a', CAST(o_orderkey AS VARCHAR(20)), '@b.co 5551234567') END AS raw FROM orders JOIN part ON p_partkey = o_orderkey % 60"""


@query("descriptions_normalised", f"""SELECT id, CASE way WHEN 0 THEN name || ' [AMOUNT]' WHEN 1 THEN name WHEN 2 THEN name || ' [NAME]' WHEN 3 THEN 'Amazon ' || name WHEN 4 THEN 'CAFE ' || name ELSE name || ' [EMAIL] [NUM]' END AS clean,
  CASE way WHEN 3 THEN 'amazon ' || name WHEN 4 THEN 'cafe ' || name ELSE name END AS merchant_key, CAST(way = 0 AS BIGINT) AS n_amounts, CAST(way = 2 AS BIGINT) AS n_names, CAST(way = 5 AS BIGINT) AS n_emails FROM ({_RAW})""")  # fmt: skip
def _(s, d):
    """All steps from a raw description to its key."""
    out = descriptions.normalised(frame(s, d, _RAW), ["Ann Lee"], "raw")
    return out.select("id", F.col("description_clean").alias("clean"), "merchant_key", F.col("replaced")["amount"].alias("n_amounts"), F.col("replaced")["name"].alias("n_names"), F.col("replaced")["email"].alias("n_emails"))
