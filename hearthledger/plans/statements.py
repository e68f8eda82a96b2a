"""Queries of the statement readers: statements are printed from the lines of bills as words on pages, read back, and compared with the bills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthledger.functions.columns import let
from hearthledger.functions.text import money_plain
from hearthledger.plans.registry import query
from hearthledger.sources import layouts, tax_readers, words
from hearthledger.sources.fixtures import frame
from hearthledger.sources.tables import kept

# A statement for each supplier and year: sections 1 to 3 by return flag, rows in order.
_BASE = """SELECT *, row_number() OVER (PARTITION BY k, sec ORDER BY o, n, cents, shop, d) AS rn, row_number() OVER (PARTITION BY k ORDER BY o, n, cents, shop, d) AS nth FROM (
  SELECT concat(CAST(l_suppkey AS VARCHAR(9)), '-', CAST(year(l_shipdate) AS VARCHAR(4))) AS k, CAST(l_suppkey AS BIGINT) AS supplier, year(l_shipdate) AS y, CAST(l_shipdate AS DATE) AS d, l_orderkey AS o, l_linenumber AS n,
    CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS sec, concat('Shop ', CAST(l_partkey % 97 AS VARCHAR(9)), ' Ltd') AS shop, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents FROM lineitem) t"""
_STEP = 6.0


def _base(s, d, prefix: str, more: str = "") -> DataFrame:
    """Rows of bills with the name of their file as file_sha256, by which they are dealt out for all that follows; `more` are columns of SQL over them."""
    named = _BASE.replace("SELECT concat(CAST(l_suppkey", f"SELECT concat('{prefix}', CAST(l_suppkey")
    return frame(s, d, f"SELECT *{more} FROM ({named}) t".replace("VARCHAR(9)", "STRING").replace("VARCHAR(4)", "STRING")).withColumnRenamed("k", "file_sha256")


def cell(x: float | Column, text: str | Column, single: bool = False) -> Column:
    """Words (text, x0, x1, dy) of a text printed at x, parted by blanks; a text that is known to have none is `single`. Words of a row are a little off (dy)."""
    x = F.lit(float(x)) if isinstance(x, (int, float)) else x

    def word(t: Column, before: Column | int, dy: Column | float) -> Column:
        x0 = x + F.lit(before) * _STEP
        return F.struct(t.alias("text"), x0.alias("x0"), (x0 + F.length(t) * _STEP - 0.5).alias("x1"), F.lit(dy).alias("dy"))

    if isinstance(text, str):
        parts = text.split(" ")
        return F.array(*[word(F.lit(t), len(" ".join(parts[:i])) + (i > 0), 0.5 * (i % 2)) for i, t in enumerate(parts)])
    if single:
        return F.array(word(text, 0, 0.0))
    before = lambda texts, i: F.when(i == 0, 0).otherwise(F.length(F.array_join(F.slice(texts, 1, i), " ")) + 1)
    words_ = let(F.split(text, " "), lambda texts: F.transform(texts, lambda t, i: word(t, before(texts, i), F.pmod(i, F.lit(2)) * 0.5)))
    return F.coalesce(words_, F.array().cast("array<struct<text: string, x0: double, x1: double, dy: double>>"))


def line(when, page, at, *cells: Column) -> Column:
    return F.when(when, F.struct(F.lit(page).cast("int").alias("page"), (F.lit(at) if isinstance(at, int) else at).cast("int").alias("line"), F.concat(*cells).alias("words")))


def _words(base: DataFrame, prefix: str, lines: list[Column], heads: list[Column]) -> DataFrame:
    """Words of printed lines: those of each row of the bill, and, with its first row, those that a statement has once."""
    file = Window.partitionBy("file_sha256")
    sums = {f"sum{i}": F.sum(F.when(F.col("sec") == i, _signed(prefix))).over(file) for i in (1, 2, 3)} | {"sum": F.sum(_signed(prefix)).over(file)}
    once = F.when(F.col("nth") == 1, F.array(*heads)).otherwise(F.array())
    return printed(exploded(base.withColumns(sums), F.concat(F.array(*lines), once)))


def exploded(base: DataFrame, lines: Column, file: str | Column = "file_sha256") -> DataFrame:
    """(file_sha256, l) of the lines that are printed.

    The lines are a column first, as a generator's own expression is not compiled; the filter of a plain explode would work them out once more.
    """
    return base.select(file, lines.alias("_l")).select("file_sha256", F.explode_outer("_l").alias("l")).where("l is not null")


def printed(made: DataFrame) -> DataFrame:
    """(file_sha256, page_number, words) of lines (file_sha256, l)."""
    placed = made.select("file_sha256", F.col("l.page").alias("page_number"), (F.col("l.line") * 12.0).alias("_top"), F.col("l.words").alias("words"))
    at = lambda w: F.struct((F.col("_top") + w["dy"]).alias("top"), w["x0"].alias("x0"), w["x1"].alias("x1"), w["text"].alias("text"), (F.col("_top") + w["dy"] + 10).alias("bottom"))
    return placed.select(*words.PAGE, F.transform("words", at).alias("words"))


def _signed(prefix: str) -> Column:
    """The amount of a row as each layout prints it: payments and some purchases are negative; at a bank debits are positive."""
    minus = (F.col("sec") == 1) | ((F.col("n") == 3) & (F.col("sec") == 2)) if prefix != "D" else F.col("sec") == 1
    return F.when(minus, -F.col("cents")).otherwise(F.col("cents"))


_SIGN = "CASE WHEN sec = 1 OR (n = 3 AND sec = 2) THEN -cents ELSE cents END"
_TEXT = "concat(shop, CASE WHEN n = 5 THEN ' second line' ELSE '' END)"
_full = lambda c: F.date_format(c, "MM/dd/yyyy")
_short = lambda c: F.date_format(c, "M/d")
_COLUMNS = ("file_sha256", "ordinal", "posted_date", "description_raw", "amount_minor", "section", "kind_hint")
_ORDINAL = "row_number() OVER (PARTITION BY k ORDER BY sec, rn)"


def _at(more: int = 0) -> Column:
    """The line of a row of the bill, or one after it."""
    return F.col("rn") * 3 + 10 + more



def _a_rows(s, d) -> DataFrame:
    names = list(layouts.A_SECTIONS.values())
    amount = money_plain(_signed("A"))
    lines = [
        line(F.lit(True), F.col("sec"), _at(), cell(0, _full("d"), True), cell(80, _full(F.date_add("d", 1)), True), cell(160, F.col("shop")), cell(400, F.col("o").cast("string"), True), cell(480, "1234"), cell(560, amount, True)),
        line(F.col("n") == 5, F.col("sec"), _at(1), cell(160, "second line")), line(F.col("n") == 6, F.col("sec"), _at(2), cell(160, "40.00 EUR X 1.1250")),
    ]
    labels = ("Trans Date", "Post Date", "Description", "Reference Number", "Account Number", "Amount", "Total")
    heads = [line(F.lit(True), 1, 0, *[cell(x, t) for x, t in zip((0, 80, 160, 400, 480, 560, 640), labels)]), line(F.lit(True), 4, 1, cell(0, names[3].upper()))]
    heads += [line(F.lit(True), i, 1, cell(0, names[i - 1].upper())) for i in (1, 2, 3)]
    heads += [line(F.lit(True), i, 1_000_000, cell(0, F.concat(F.lit(f"TOTAL {names[i - 1].upper()} FOR THIS PERIOD "), money_plain(F.coalesce(F.col(f"sum{i}"), F.lit(0)))))) for i in (1, 2, 3)]
    heads.append(line(F.lit(True), 4, 1_000_000, cell(0, "TOTAL INTEREST CHARGED FOR THIS PERIOD 0.00")))
    return words.rows_of(_words(_base(s, d, "A"), "A", lines, heads))


_A_NAME = "CASE sec WHEN 1 THEN 'Payments and Other Credits' WHEN 2 THEN 'Purchases and Adjustments' ELSE 'Fees' END"


@query("statements_layout_a", f"""SELECT concat('A', k) AS file_sha256, {_ORDINAL} AS ordinal, CAST(d + INTERVAL 1 DAY AS DATE) AS posted_date, d AS transaction_date, {_TEXT} AS description_raw, {_SIGN} AS amount_minor, {_A_NAME} AS section,
  CASE sec WHEN 1 THEN 'payment_or_refund' WHEN 3 THEN 'fee' ELSE CASE WHEN n = 3 THEN 'adjustment' ELSE 'purchase' END END AS kind_hint, CASE WHEN n = 6 THEN 4000 END AS fx_amount_minor, CASE WHEN n = 6 THEN 'EUR' END AS fx_currency, CASE WHEN n = 6 THEN CAST(1.125 AS DOUBLE) END AS fx_rate FROM ({_BASE})""")  # fmt: skip
def _(s, d):
    return layouts.layout_a(_a_rows(s, d)).select(*_COLUMNS, "transaction_date", "fx_amount_minor", "fx_currency", "fx_rate")


@query("statement_section_totals", f"SELECT concat('A', k) AS file_sha256, {_A_NAME} AS section, CAST(sum({_SIGN}) AS BIGINT) AS printed_minor FROM ({_BASE}) GROUP BY k, sec UNION ALL SELECT concat('A', k), s, 0 FROM (SELECT k, s, count(*) FILTER (sec = i) AS c FROM ({_BASE}), (VALUES (1, 'Payments and Other Credits'), (2, 'Purchases and Adjustments'), (3, 'Fees'), (4, 'Interest Charged')) v(i, s) GROUP BY k, s) WHERE c = 0")
def _(s, d):
    return layouts.a_totals(_a_rows(s, d))


def _period_heads(page: int = 1, first: str = "Previous Balance", last: str = "New Balance", opening: int = 100_000, sign: int = 1) -> list[Column]:
    """The period and balances; a bank's closing balance is less by what was spent."""
    year = F.col("y").cast("string")
    return [
        line(F.lit(True), page, 0, cell(0, F.concat(F.lit("Statement period 01/01/"), year, F.lit(" through 12/31/"), year))),
        line(F.lit(True), page, 1, cell(0, F.concat(F.lit(f"{first} $"), money_plain(F.lit(opening).cast("bigint"))))),
        line(F.lit(True), page, 2, cell(0, F.concat(F.lit(f"{last} "), money_plain((F.lit(opening) + sign * F.col("sum")).cast("bigint"))))),
    ]


def _b_rows(s, d) -> DataFrame:
    base = _base(s, d, "B")
    page = F.least(F.col("sec"), F.lit(2))
    at = 10 + 3 * F.col("nth")
    lines = [
        line(F.lit(True), page, at, cell(0, _short("d"), True), cell(60, F.col("shop")), cell(400, money_plain(_signed("B")), True)),
        line(F.col("n") == 5, page, at + 1, cell(60, "second line")), line(F.col("n") == 6, page, at + 2, cell(60, "FOREIGN CURRENCY AMOUNT 35.00 GBP EXCH RATE 1.20000")),
    ]
    heads = [*_period_heads(), line(F.lit(True), 1, 3, cell(0, "ACCOUNT ACTIVITY")), line(F.lit(True), 1, 4, cell(0, "Date of"), cell(60, "Merchant Name or Transaction Description"), cell(400, "$ Amount")),
             line(F.lit(True), 1, 5, cell(0, "PAYMENTS AND OTHER CREDITS")), line(F.lit(True), 2, 0, cell(0, "PURCHASES")), line(F.lit(True), 3, 0, cell(0, "INTEREST CHARGED")), line(F.lit(True), 3, 1, cell(0, "1/5"), cell(60, "Interest on balance"), cell(400, "3.00"))]
    return words.rows_of(_words(base, "B", lines, heads))


@query("statements_layout_b", f"""SELECT concat('B', k) AS file_sha256, row_number() OVER (PARTITION BY k ORDER BY least(sec, 2), nth) AS ordinal, d AS posted_date, {_TEXT} AS description_raw, {_SIGN} AS amount_minor, CASE sec WHEN 1 THEN 'PAYMENTS AND OTHER CREDITS' ELSE 'PURCHASES' END AS section,
  CASE WHEN sec = 1 THEN 'payment_or_refund' WHEN n = 3 AND sec = 2 THEN 'adjustment' ELSE 'purchase' END AS kind_hint, CASE WHEN n = 6 THEN 3500 END AS fx_amount_minor, CASE WHEN n = 6 THEN 'GBP' END AS fx_currency, CASE WHEN n = 6 THEN CAST(1.2 AS DOUBLE) END AS fx_rate FROM ({_BASE})""")  # fmt: skip
def _(s, d):
    return layouts.layout_b(_b_rows(s, d)).select(*_COLUMNS, "fx_amount_minor", "fx_currency", "fx_rate")


@query("statement_summaries", f"SELECT concat('B', k) AS file_sha256, make_date(y, 1, 1) AS period_start, make_date(y, 12, 31) AS period_end, 100000 AS opening_balance_minor, CAST(abs(100000 + sum({_SIGN})) AS BIGINT) AS closing_balance_minor FROM ({_BASE}) GROUP BY k, y HAVING 100000 + sum({_SIGN}) >= 0 UNION ALL SELECT concat('B', k), make_date(y, 1, 1), make_date(y, 12, 31), NULL, NULL FROM ({_BASE}) GROUP BY k, y HAVING 100000 + sum({_SIGN}) < 0")
def _(s, d):
    return layouts.summaries(_b_rows(s, d)).drop("text")


def _c_rows(s, d) -> DataFrame:
    page = F.least(F.col("sec"), F.lit(2))
    at = 10 + 3 * F.col("nth")
    cells = [cell(0, _short("d"), True), cell(100, F.col("shop")), cell(450, money_plain(_signed("C")), True)]
    label = (F.col("sec") > 1) & (F.col("n") != 2)
    lines = [
        line(~label, page, at, *cells), line(label, page, at, *cells, cell(300, "Gas Stations")), line(F.col("n") == 5, page, at + 1, cell(100, "second line")), line(F.col("n") == 6, page, at + 2, cell(100, "FX 125.00 EUR RATE 1.0870")),
    ]
    heads = [*_period_heads(), line(F.lit(True), 1, 4, cell(0, "TRANS. DATE"), cell(100, "PAYMENTS AND CREDITS"), cell(450, "AMOUNT")), line(F.lit(True), 2, 0, cell(0, "TRANS. DATE"), cell(100, "PURCHASES"), cell(300, "MERCHANT CATEGORY"), cell(450, "AMOUNT"))]
    return words.rows_of(_words(_base(s, d, "C"), "C", lines, heads))


@query("statements_layout_c", f"""SELECT concat('C', k) AS file_sha256, row_number() OVER (PARTITION BY k ORDER BY least(sec, 2), nth) AS ordinal, d AS posted_date, {_TEXT} AS description_raw, {_SIGN} AS amount_minor, CASE sec WHEN 1 THEN 'PAYMENTS AND CREDITS' ELSE 'PURCHASES' END AS section,
  CASE WHEN sec = 1 THEN 'payment_or_refund' ELSE 'purchase' END AS kind_hint, CASE WHEN sec > 1 AND n <> 2 THEN 'Gas Stations' END AS issuer_category, CASE WHEN n = 6 THEN 12500 END AS fx_amount_minor, CASE WHEN n = 6 THEN 'EUR' END AS fx_currency, CASE WHEN n = 6 THEN CAST(1.087 AS DOUBLE) END AS fx_rate FROM ({_BASE})""")  # fmt: skip
def _(s, d):
    return layouts.layout_c(_c_rows(s, d)).select(*_COLUMNS, "issuer_category", "fx_amount_minor", "fx_currency", "fx_rate")


_D_TEXT = "concat(shop, CASE n WHEN 4 THEN ' AUTOPAY' WHEN 2 THEN ' REFUND' ELSE '' END)"
_D_SIGN = "CASE WHEN sec = 1 THEN -cents ELSE cents END"
# The printed balance is off by a unit of money where n = 6 (and so all that follow it look right again only if they follow from it).
_D_BALANCE = f"10000000 - sum({_D_SIGN}) OVER (PARTITION BY k ORDER BY sec, rn) + CASE WHEN n = 6 THEN 100 ELSE 0 END"


def _d_rows(s, d) -> DataFrame:
    base = _base(s, d, "D", f", {_D_TEXT} AS text, {_D_BALANCE} AS balance")
    debit, shown = F.col("sec") > 1, F.col("n") % 3 == 0
    cells = [cell(0, _short("d"), True), cell(60, F.col("text"))]
    amount = money_plain(F.col("cents"))
    shows = lambda when, *more: line(when, F.col("sec"), _at(), *cells, *more)
    balance = cell(460, money_plain(F.col("balance").cast("bigint")), True)
    lines = [
        shows(debit & ~shown, cell(300, amount, True)), shows(debit & shown, cell(300, amount, True), balance), shows(~debit & ~shown, cell(380, amount, True)), shows(~debit & shown, cell(380, amount, True), balance),
        line(F.col("n") == 5, F.col("sec"), _at(1), cell(60, "second line")), line(F.col("n") == 6, F.col("sec"), _at(2), cell(60, "FOREIGN AMOUNT 45.00 EUR RATE 1.0921")),
    ]
    heads = [*_period_heads(1, "Beginning Balance", "Ending Balance", 10_000_000, -1), line(F.lit(True), 1, 4, cell(0, "Date"), cell(60, "Description"), cell(300, "Withdrawals"), cell(380, "Deposits"), cell(460, "Balance"))]
    heads += [line(F.lit(True), i, 6, cell(0, name)) for i, name in ((1, "Deposits and Additions"), (2, "ATM & Debit Card Withdrawals"), (3, "Fees"))]
    return words.rows_of(_words(base, "D", lines, heads))


_D_NAME = "CASE sec WHEN 1 THEN 'deposits and additions' WHEN 2 THEN 'atm & debit card withdrawals' ELSE 'fees' END"


@query("statements_layout_d", f"""SELECT concat('D', k) AS file_sha256, {_ORDINAL} AS ordinal, d AS posted_date, concat({_D_TEXT}, CASE WHEN n = 5 THEN ' second line' ELSE '' END) AS description_raw, {_D_SIGN} AS amount_minor, {_D_NAME} AS section,
  CASE WHEN n = 4 THEN 'transfer' WHEN sec = 1 AND n = 2 THEN 'refund' WHEN sec = 1 THEN 'transfer' WHEN sec = 2 THEN 'purchase' ELSE 'fee' END AS kind_hint, CASE WHEN n % 3 = 0 THEN CAST({_D_BALANCE} AS BIGINT) END AS balance_minor, CASE WHEN n = 6 THEN 4500 END AS fx_amount_minor FROM ({_BASE})""")  # fmt: skip
def _(s, d):
    return layouts.layout_d(_d_rows(s, d)).select(*_COLUMNS, "balance_minor", "fx_amount_minor")


@query("statement_balance_breaks", f"""WITH t AS (SELECT k, {_ORDINAL} AS ordinal, {_D_SIGN} AS a, CASE WHEN n % 3 = 0 THEN CAST({_D_BALANCE} AS BIGINT) END AS b FROM ({_BASE})), c AS (SELECT *, sum(a) OVER (PARTITION BY k ORDER BY ordinal) AS run, count(b) OVER (PARTITION BY k ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM t),
p AS (SELECT k, g + 1 AS g, b AS before, run AS upto FROM c WHERE b IS NOT NULL) SELECT concat('D', c.k) AS file_sha256, ordinal, CAST(coalesce(before, 10000000) - (run - coalesce(upto, 0)) AS BIGINT) AS expected_minor, b AS balance_minor FROM c LEFT JOIN p ON p.k = c.k AND p.g = c.g WHERE b IS NOT NULL AND b <> coalesce(before, 10000000) - (run - coalesce(upto, 0))""")  # fmt: skip
def _(s, d):
    rows = kept(_d_rows(s, d), "statement-rows")
    return layouts.balance_breaks(layouts.layout_d(rows), layouts.summaries(rows))


_PER_PAGE = 40
_G_ISSUER = "CASE supplier % 4 WHEN 0 THEN 'North Bank statement' WHEN 1 THEN 'ALDER-CARD' WHEN 2 THEN 'Fern Savings with Alder Card' ELSE 'Your statement' END"


def _g_rows(s, d) -> DataFrame:
    base = _base(s, d, "G")
    page, at = F.floor((F.col("nth") - 1) / _PER_PAGE) + 1, 10 + 2 * F.col("nth")
    lines = [
        line(F.lit(True), page, at, cell(0, _full("d"), True), cell(90, F.col("shop")), cell(300, money_plain(_signed("G")), True)), line((F.col("n") == 5) & (F.col("nth") % 3 == 0), page, at + 1, cell(90, "second line")),
        line(F.col("nth") % _PER_PAGE == 1, page, 4, cell(0, "Date"), cell(90, "Details"), cell(300, "Amount")),
    ]
    heads = [line(F.lit(True), 1, 0, cell(0, F.expr(_G_ISSUER)))]
    return words.rows_of(_words(base, "G", lines, heads))


# A table has three rows or more from its first dated one to its last, with those that go on with a text, and six in ten are dated.
_G_READ = f"""(SELECT *, row_number() OVER (PARTITION BY k ORDER BY nth) AS ordinal, count(*) OVER (PARTITION BY k) AS whole FROM (
  SELECT *, count(*) OVER p AS c, count(*) FILTER (n = 5 AND nth % 3 = 0 AND nth < top) OVER p AS more FROM (SELECT *, (nth - 1) // {_PER_PAGE} AS page, max(nth) OVER (PARTITION BY k, (nth - 1) // {_PER_PAGE}) AS top FROM ({_BASE})) WINDOW p AS (PARTITION BY k, page)) WHERE c + more >= 3 AND c >= 0.6 * (c + more))"""


@query("statements_generic", f"SELECT concat('G', k) AS file_sha256, ordinal, d AS posted_date, concat(shop, CASE WHEN n = 5 AND nth % 3 = 0 THEN ' second line' ELSE '' END) AS description_raw, {_SIGN} AS amount_minor, CAST(NULL AS VARCHAR) AS section, CAST(NULL AS VARCHAR) AS kind_hint FROM {_G_READ} WHERE whole >= 3")
def _(s, d):
    return layouts.generic(_g_rows(s, d)).select(*_COLUMNS)


@query("statement_tables", f"SELECT concat('G', k) AS file_sha256, CAST((nth - 1) // {_PER_PAGE} + 1 AS INTEGER) AS page_number, count(*) AS data, count(*) FILTER (n = 5 AND nth % 3 = 0) AS continuation FROM {_G_READ} GROUP BY ALL")
def _(s, d):
    of = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(k)
    return words.tables_of(_g_rows(s, d)).groupBy(*words.PAGE).agg(of("data"), of("continuation"))


@query("statement_issuers", f"SELECT DISTINCT concat('G', k) AS file_sha256, CASE supplier % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS issuer_id FROM ({_BASE})")
def _(s, d):
    terms = s.createDataFrame([(0, "North Bank"), (1, "Alder Card"), (2, "Fern Savings"), (3, "Quay Credit")], "issuer_id bigint, term string")
    return layouts.issuer_of(_g_rows(s, d), terms)


@query("statement_detection", f"SELECT concat(p, k) AS file_sha256, parser_id, CAST(score AS DOUBLE) AS detect_score FROM (SELECT DISTINCT k FROM ({_BASE})), (VALUES ('A', 'layout_a_credit', 0.9), ('B', 'layout_b_credit', 0.95), ('C', 'layout_c_credit', 0.9), ('D', 'layout_d_bank', 0.9), ('G', 'generic_table', 0.0)) v(p, parser_id, score)")
def _(s, d):
    every = _a_rows(s, d)
    for more in (_b_rows, _c_rows, _d_rows, _g_rows):
        every = every.unionByName(more(s, d))
    return layouts.detected(layouts.summaries(every))


# Tables of any bank with a debit, a credit and a balance that only some rows have: what rows without one spend is owed to the next balance.
def _h_rows(s, d) -> DataFrame:
    base = _base(s, d, "H", f", {_H_BALANCE} AS balance")
    page, at = F.floor((F.col("nth") - 1) / _PER_PAGE) + 1, 10 + 2 * F.col("nth")
    amount, shows = money_plain(F.col("cents")), F.col("nth") % 3 != 2
    cells = [cell(0, _full("d"), True), cell(90, F.col("shop"))]
    debit, credit, balance = cell(240, amount, True), cell(340, amount, True), cell(440, money_plain(F.col("balance").cast("bigint")), True)
    is_debit = F.col("sec") > 1
    lines = [
        line(is_debit & shows, page, at, *cells, debit, balance), line(is_debit & ~shows, page, at, *cells, debit), line(~is_debit & shows, page, at, *cells, credit, balance), line(~is_debit & ~shows, page, at, *cells, credit),
        line(F.col("nth") % _PER_PAGE == 1, page, 4, cell(0, "Date"), cell(90, "Details"), cell(240, "Debit"), cell(340, "Credit"), cell(440, "Balance")),
    ]
    return words.rows_of(_words(base, "H", lines, [line(F.lit(True), 1, 0, cell(0, "Your statement"))]))


_H_SIGN = "CASE WHEN sec > 1 THEN cents ELSE -cents END"
_H_BALANCE = f"50000000 - sum({_H_SIGN}) OVER (PARTITION BY k ORDER BY nth) + CASE WHEN n = 6 THEN 100 ELSE 0 END"
_H_READ = f"(SELECT *, row_number() OVER (PARTITION BY k ORDER BY nth) AS ordinal FROM (SELECT *, count(*) OVER (PARTITION BY k) AS whole, CASE WHEN nth % 3 <> 2 THEN CAST(balance AS BIGINT) END AS shown FROM (SELECT *, count(*) OVER (PARTITION BY k, (nth - 1) // {_PER_PAGE}) AS c, {_H_BALANCE} AS balance FROM ({_BASE})) WHERE c >= 3) WHERE whole >= 3)"


@query("statement_table_columns", f"SELECT concat('H', k) AS file_sha256, ordinal, d AS posted_date, shop AS description_raw, CAST({_H_SIGN} AS BIGINT) AS amount_minor, shown AS balance_minor FROM {_H_READ}")
def _(s, d):
    """Debits, credits and balances of any table."""
    return layouts.generic(kept(_h_rows(s, d), "statement-rows")).select("file_sha256", "ordinal", "posted_date", "description_raw", "amount_minor", "balance_minor")


@query("statement_table_balances", f"""WITH t AS (SELECT k, ordinal, {_H_SIGN} AS a, shown AS b FROM {_H_READ}), c AS (SELECT *, sum(a) OVER (PARTITION BY k ORDER BY ordinal) AS run, count(b) OVER (PARTITION BY k ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM t), p AS (SELECT k, g + 1 AS g, b AS before, run AS upto FROM c WHERE b IS NOT NULL)
SELECT concat('H', c.k) AS file_sha256, ordinal, CAST(before - (run - upto) AS BIGINT) AS expected_minor, b AS balance_minor FROM c JOIN p ON p.k = c.k AND p.g = c.g WHERE b IS NOT NULL AND b <> before - (run - upto)""")  # fmt: skip
def _(s, d):
    """Rows of any table whose balance does not follow from the one before and what was spent since; the statements have no opening balance."""
    rows = kept(_h_rows(s, d), "statement-rows")
    return layouts.balance_breaks(kept(layouts.generic(rows), "statement-rows"), layouts.summaries(rows))


_EVERY = " UNION ALL ".join(
    f"SELECT concat('{p}', k) AS file_sha256, {p_sql} AS ordinal, d AS posted_date, {a_sql} AS amount_minor, '{name}' AS parser_id, CAST({score} AS DOUBLE) AS detect_score, CAST(NULL AS VARCHAR) AS error FROM ({_BASE})"
    for p, p_sql, a_sql, name, score in (
        ("B", "row_number() OVER (PARTITION BY k ORDER BY least(sec, 2), nth)", _SIGN, "layout_b_credit", 0.95), ("C", "row_number() OVER (PARTITION BY k ORDER BY least(sec, 2), nth)", _SIGN, "layout_c_credit", 0.9), ("D", _ORDINAL, _D_SIGN, "layout_d_bank", 0.9),
    )
)


@query("statement_dispatch", f"""{_EVERY} UNION ALL SELECT concat('A', k), {_ORDINAL}, CAST(d + INTERVAL 1 DAY AS DATE), {_SIGN}, 'layout_a_credit', 0.9, NULL FROM ({_BASE})
UNION ALL SELECT concat('G', k), ordinal, d, {_SIGN}, 'generic_table', 0.0, NULL FROM {_G_READ} WHERE whole >= 3 UNION ALL SELECT DISTINCT concat('G', k), NULL, NULL, NULL, 'generic_table', 0.0, '{tax_readers.NO_LAYOUT}' FROM ({_BASE}) t WHERE k NOT IN (SELECT k FROM {_G_READ} WHERE whole >= 3)""")  # fmt: skip
def _(s, d):
    """A folder of statements of all layouts, each read by the reader detected for it."""
    every = _a_rows(s, d)
    for more in (_b_rows, _c_rows, _d_rows, _g_rows):
        every = every.unionByName(more(s, d))
    return tax_readers.statements(every).select("file_sha256", F.col("ordinal").cast("bigint").alias("ordinal"), "posted_date", "amount_minor", "parser_id", "detect_score", "error")
