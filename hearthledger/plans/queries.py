"""Registered queries of the ledger and, where SQL can express them, the same results in DuckDB's SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from hearthledger.functions import text as T
from hearthledger.operators import classify, ledger, networth, spend, tax
from hearthledger.operators.spend import SpendQuery
from hearthledger.plans.registry import QUERIES, SQL
from hearthledger.plans.registry import query as _query
from hearthledger.sources.fixtures import view, with_views

_PERIODS = {
    "day": "strftime(posted_date, '%Y-%m-%d')", "week": "strftime(posted_date, '%Y-W%W')", "month": "strftime(posted_date, '%Y-%m')",
    "quarter": "concat(year(posted_date), '-Q', quarter(posted_date))", "year": "strftime(posted_date, '%Y')", "all": "'all'",
}
#: SQL's // floors; totals can be negative, so the average is made to truncate.
_SUMS = (
    "CAST(sum(amount_minor) AS BIGINT) AS total_minor, count(*) AS txn_count, "
    "CAST(sign(sum(amount_minor)) * (abs(sum(amount_minor)) // count(*)) AS BIGINT) AS avg_minor"
)
_SPEND = "kind IN ('purchase', 'fee', 'interest', 'refund') AND currency = 'USD'"


def _spend(spark, d, q: SpendQuery):
    rows = "transactions" if "merchant" in q.group_by or q.search is not None else "transactions_core"
    return spend.spend(view(spark, d, rows), view(spark, d, "categories"), view(spark, d, "subcategories"), q)


def _add_grain(grain: str) -> None:
    sql = f"SELECT {_PERIODS[grain]} AS period, c.key AS category, currency, {_SUMS} FROM transactions t LEFT JOIN categories c ON category_id = c.id WHERE {_SPEND} GROUP BY ALL"
    _query(f"agg_spend_by_{grain}_category", sql, "transactions", "categories")(lambda s, d: _spend(s, d, SpendQuery(grain=grain)))


for _g in _PERIODS:
    _add_grain(_g)

_SUB = """LEFT JOIN (SELECT s.id AS sid, CASE WHEN s.status = 'merged' THEN m.key ELSE s.key END AS sub
  FROM subcategories s LEFT JOIN subcategories m ON s.merged_into = m.id) r ON subcategory_id = sid"""


@_query("agg_spend_by_all_keys", f"SELECT {_PERIODS['quarter']} AS period, c.key AS category, sub AS subcategory, user_id AS \"user\", account_id AS account, merchant_key AS merchant, currency, {_SUMS} FROM transactions t LEFT JOIN categories c ON category_id = c.id {_SUB} WHERE {_SPEND} GROUP BY ALL", "transactions", "categories", "subcategories")
def _(s, d):
    return _spend(s, d, SpendQuery(group_by=spend.KEYS, grain="quarter"))


@_query("agg_spend_filtered", f"SELECT sub AS subcategory, currency, {_SUMS} FROM transactions {_SUB} LEFT JOIN categories c ON category_id = c.id WHERE currency = 'USD' AND kind IN ('purchase', 'fee', 'interest') AND user_id IN (1, 3, 5) AND posted_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND c.key IN ('groceries', 'dining', 'travel') AND sub IN ('supermarket', 'hotel', 'bar') AND amount_minor BETWEEN 1000000 AND 30000000 AND contains(translate(description_clean, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'pos ') GROUP BY ALL", "transactions", "categories", "subcategories")
def _(s, d):
    q = SpendQuery(
        group_by=("subcategory",), user_ids=(1, 3, 5), start=date(1996, 1, 1), end=date(1999, 12, 31), categories=("groceries", "dining", "travel"),
        subcategories=("supermarket", "hotel", "bar"), min_amount=1_000_000, max_amount=30_000_000, search="POS ", net_refunds=False,
    )
    return _spend(s, d, q)


@_query("agg_spend_literal_search", f"SELECT kind AS k, currency, {_SUMS} FROM transactions WHERE currency = 'EUR' AND contains(lower(description_clean), '100%_off') GROUP BY ALL", "transactions")
def _(s, d):
    rows = spend.selected(view(s, d, "transactions"), SpendQuery(currency="EUR", include_non_spend=True, search="100%_off"))
    sums = rows.groupBy(F.col("kind").alias("k"), "currency").agg(F.sum("amount_minor").alias("total_minor"), F.count("id").alias("txn_count"))
    return sums.withColumn("avg_minor", F.expr("total_minor div txn_count"))


_NAMES = """names AS (
  SELECT merchant_key, coalesce(max(cn), max(dn)) AS display_name FROM (
    SELECT merchant_key, first(merchant_canonical ORDER BY n DESC, merchant_canonical) AS cn, NULL AS dn FROM (SELECT merchant_key, merchant_canonical, count(*) AS n FROM transactions WHERE trim(merchant_canonical) <> '' GROUP BY ALL) GROUP BY merchant_key
    UNION ALL
    SELECT merchant_key, NULL, first(description_clean ORDER BY n DESC, length(description_clean), description_clean) FROM (SELECT merchant_key, description_clean, count(*) AS n FROM transactions WHERE trim(description_clean) <> '' GROUP BY ALL) GROUP BY merchant_key
  ) GROUP BY merchant_key)"""


@_query("merchant_display_names", "SELECT * FROM names", "transactions")
def _(s, d):
    return spend.merchant_names(view(s, d, "transactions"))


SQL["merchant_display_names"] = with_views("", "transactions") + f", {_NAMES} SELECT * FROM names"


@_query("top_merchants")
def _(s, d):
    return spend.top_merchants(view(s, d, "transactions"), view(s, d, "categories"), view(s, d, "subcategories"), SpendQuery(), 25)


SQL["top_merchants"] = with_views("", "transactions") + f""", {_NAMES}, top AS (
  SELECT merchant_key AS merchant, currency, {_SUMS} FROM transactions WHERE {_SPEND} GROUP BY merchant_key, currency ORDER BY total_minor DESC, merchant LIMIT 25)
SELECT merchant, currency, total_minor, txn_count, avg_minor, display_name FROM top LEFT JOIN names ON merchant_key = merchant WHERE trim(merchant) <> ''"""


@_query("list_transactions", "SELECT id, posted_date, amount_minor, kind, user_id FROM transactions WHERE kind IN ('purchase', 'fee', 'interest', 'refund') AND needs_review ORDER BY amount_minor DESC, id LIMIT 100 OFFSET 100", "transactions")
def _(s, d):
    page = spend.list_transactions(view(s, d, "transactions"), needs_review=True, sort="-amount_minor", page=2, size=100)
    return page.select("id", "posted_date", "amount_minor", "kind", "user_id")


@_query("month_over_month", f"SELECT period, total_minor, lag(total_minor) OVER (ORDER BY period) AS previous_minor, total_minor - lag(total_minor) OVER (ORDER BY period) AS change_minor FROM (SELECT {_PERIODS['month']} AS period, {_SUMS} FROM transactions WHERE {_SPEND} GROUP BY ALL)", "transactions")
def _(s, d):
    return spend.change_by_month(_spend(s, d, SpendQuery(group_by=("period",)))).select("period", "total_minor", "previous_minor", "change_minor")


@_query("pivot_by_category", f"SELECT {_PERIODS['year']} AS period, CAST(sum(amount_minor) FILTER (c.key = 'groceries') AS BIGINT) AS groceries, CAST(sum(amount_minor) FILTER (c.key = 'dining') AS BIGINT) AS dining, CAST(sum(amount_minor) FILTER (c.key = 'travel') AS BIGINT) AS travel, CAST(sum(amount_minor) FILTER (c.key = 'online_shopping') AS BIGINT) AS online_shopping, CAST(sum(amount_minor) FILTER (c.key IS NULL) AS BIGINT) AS uncategorized FROM transactions LEFT JOIN categories c ON category_id = c.id WHERE {_SPEND} GROUP BY ALL", "transactions", "categories")
def _(s, d):
    return spend.pivot_by_category(_spend(s, d, SpendQuery(grain="year")), ["groceries", "dining", "travel", "online_shopping"])


_MONTHLY = """e AS (SELECT *, year * 12 + month - 1 AS m FROM balance_entries WHERE currency = 'USD'),
a AS (SELECT user_id, category, account_name, min(m) AS first_m FROM e GROUP BY ALL),
cal AS (SELECT unnest(range((SELECT min(m) FROM e), (SELECT max(m) FROM e) + 1)) AS mm),
filled AS (SELECT a.user_id, a.category, a.account_name, mm, e.balance_minor AS own,
  last_value(e.balance_minor IGNORE NULLS) OVER (PARTITION BY a.user_id, a.category, a.account_name ORDER BY mm) AS balance_minor
  FROM a JOIN cal ON mm >= first_m LEFT JOIN e ON e.m = mm AND e.user_id = a.user_id AND e.category = a.category AND e.account_name = a.account_name)"""


@_query("net_worth_monthly")
def _(s, d):
    return networth.monthly(view(s, d, "balance_entries"))


SQL["net_worth_monthly"] = with_views("", "balance_entries") + f", {_MONTHLY} SELECT user_id, category, account_name, CAST(mm AS INTEGER) AS month_number, balance_minor, own IS NULL AS carried FROM filled"


@_query("net_worth_totals")
def _(s, d):
    out = networth.with_change(networth.totals(networth.monthly(view(s, d, "balance_entries"))))
    return out.select("period", "assets_minor", "liabilities_minor", "net_minor", "change_minor")


SQL["net_worth_totals"] = with_views("", "balance_entries") + f""", {_MONTHLY}, t AS (
  SELECT mm, CAST(coalesce(sum(balance_minor) FILTER (category <> 'credit_card'), 0) AS BIGINT) AS assets_minor, CAST(coalesce(sum(balance_minor) FILTER (category = 'credit_card'), 0) AS BIGINT) AS liabilities_minor FROM filled GROUP BY mm)
SELECT printf('%04d-%02d', CAST(mm // 12 AS INT), CAST(mm % 12 + 1 AS INT)) AS period, assets_minor, liabilities_minor, assets_minor - liabilities_minor AS net_minor,
       assets_minor - liabilities_minor - lag(assets_minor - liabilities_minor) OVER (ORDER BY mm) AS change_minor FROM t"""


@_query("net_worth_snapshot", "SELECT user_id, category, account_name, arg_max(balance_minor, year * 12 + month) AS balance_minor, printf('%04d-%02d', CAST((max(year * 12 + month - 1)) // 12 AS INT), CAST(max(year * 12 + month - 1) % 12 + 1 AS INT)) AS as_of, max(year * 12 + month - 1) < 1998 * 12 + 5 AS carried FROM balance_entries WHERE currency = 'USD' AND year * 12 + month - 1 <= 1998 * 12 + 5 GROUP BY ALL", "balance_entries")
def _(s, d):
    return networth.snapshot(view(s, d, "balance_entries"), 1998, 6)


@_query("tax_income_rollup", "SELECT i.user_id, i.tax_year, role, form_type, CASE WHEN role = 'return' THEN form_id ELSE 0 END AS return_form_id, category, is_memo, CAST(sum(amount_minor) AS BIGINT) AS amount_minor FROM income_items i JOIN tax_forms f ON form_id = f.id GROUP BY ALL", "income_items", "tax_forms")
def _(s, d):
    return tax.rollup(view(s, d, "income_items"), view(s, d, "tax_forms"), memo=True)


@_query("tax_form_counts", "SELECT user_id, tax_year, role, count(*) AS form_count, count(DISTINCT document_id) AS document_count, CAST(sum(is_corrected) AS BIGINT) AS corrected FROM tax_forms GROUP BY ALL", "tax_forms")
def _(s, d):
    return tax.form_counts(view(s, d, "tax_forms"))


@_query("tax_latest_returns", "SELECT user_id, tax_year, max(id) AS latest_return, count(*) AS returns FROM tax_forms WHERE form_type = '1040' GROUP BY ALL", "tax_forms")
def _(s, d):
    return tax.latest_returns(view(s, d, "tax_forms"))


@_query("tax_income_by_payer", "SELECT i.user_id, i.tax_year, coalesce(payer_name, 'Unknown payer') AS payer, form_type, category, CAST(sum(amount_minor) AS BIGINT) AS amount_minor FROM income_items i JOIN tax_forms f ON form_id = f.id WHERE role = 'source' AND NOT is_memo AND category <> 'qualified_dividends' GROUP BY ALL", "income_items", "tax_forms")
def _(s, d):
    return tax.income_by_payer(view(s, d, "income_items"), view(s, d, "tax_forms"))


_YEAR = """ret AS (SELECT user_id, tax_year, max(id) AS lr FROM tax_forms WHERE form_type = '1040' GROUP BY ALL),
side AS (SELECT i.user_id, i.tax_year, role, category, CAST(sum(amount_minor) AS BIGINT) AS v FROM income_items i JOIN tax_forms f ON form_id = f.id LEFT JOIN ret r ON r.user_id = i.user_id AND r.tax_year = i.tax_year
  WHERE (role = 'source' OR (form_type = '1040' AND form_id = lr)) AND (NOT is_memo OR category = 'qualified_dividends') GROUP BY ALL),
tside AS (SELECT i.user_id, i.tax_year, role, category, CAST(sum(amount_minor) AS BIGINT) AS v FROM tax_items i JOIN tax_forms f ON form_id = f.id LEFT JOIN ret r ON r.user_id = i.user_id AND r.tax_year = i.tax_year
  WHERE role = 'source' OR form_type <> '1040' OR form_id = lr GROUP BY ALL),
keys AS (SELECT user_id, tax_year, bool_or(role = 'source') AS src FROM tax_forms GROUP BY ALL),
p AS (SELECT k.user_id, k.tax_year, src, lr,
  coalesce((SELECT sum(v) FROM side s WHERE s.user_id = k.user_id AND s.tax_year = k.tax_year AND role = CASE WHEN lr IS NULL THEN 'source' ELSE 'return' END AND category NOT IN ('qualified_dividends', 'short_term_capital_gain', 'long_term_capital_gain')), 0) AS plain,
  coalesce((SELECT sum(v) FROM side s WHERE s.user_id = k.user_id AND s.tax_year = k.tax_year AND role = CASE WHEN lr IS NULL THEN 'source' ELSE 'return' END AND category IN ('short_term_capital_gain', 'long_term_capital_gain')), 0) AS gain,
  (SELECT sum(v) FROM tside s WHERE s.user_id = k.user_id AND s.tax_year = k.tax_year AND role = 'source' AND category = 'federal_income_tax_withheld') AS sfed,
  (SELECT sum(v) FROM tside s WHERE s.user_id = k.user_id AND s.tax_year = k.tax_year AND role = 'return' AND category = 'federal_income_tax_withheld') AS rfed,
  (SELECT sum(v) FROM tside s WHERE s.user_id = k.user_id AND s.tax_year = k.tax_year AND role = 'return' AND category = 'total_federal_tax') AS total_tax,
  (SELECT sum(v) FROM tside s WHERE s.user_id = k.user_id AND s.tax_year = k.tax_year AND role = 'return' AND category = 'total_payments') AS paid
  FROM keys k LEFT JOIN ret r ON r.user_id = k.user_id AND r.tax_year = k.tax_year)"""


@_query("tax_year_summary")
def _(s, d):
    out = tax.year_summary(view(s, d, "tax_forms"), view(s, d, "income_items"), view(s, d, "tax_items"))
    return out.select("user_id", "tax_year", "basis", "total_income_minor", "carryover_minor", "federal_income_tax_withheld", "total_federal_tax", "payments_minor", "refund_minor", "amount_owed_minor")


SQL["tax_year_summary"] = with_views("", "tax_forms", "income_items", "tax_items") + f""", {_YEAR}
SELECT user_id, tax_year, CASE WHEN lr IS NOT NULL THEN 'return' WHEN src THEN 'source_documents' ELSE 'none' END AS basis,
  CAST(plain + CASE WHEN lr IS NULL THEN greatest(gain, -300000) ELSE gain END AS BIGINT) AS total_income_minor,
  CAST(CASE WHEN lr IS NULL THEN greatest(-gain - 300000, 0) ELSE 0 END AS BIGINT) AS carryover_minor,
  CAST(coalesce(sfed, CASE WHEN lr IS NOT NULL THEN rfed END, 0) AS BIGINT) AS federal_income_tax_withheld, CAST(total_tax AS BIGINT) AS total_federal_tax, CAST(paid AS BIGINT) AS payments_minor,
  CAST(CASE WHEN paid IS NOT NULL AND total_tax IS NOT NULL THEN greatest(paid - total_tax, 0) END AS BIGINT) AS refund_minor,
  CAST(CASE WHEN paid IS NOT NULL AND total_tax IS NOT NULL THEN greatest(total_tax - paid, 0) END AS BIGINT) AS amount_owed_minor FROM p"""

# A bracket table (lower bound in cents, rate in basis points); single filers, 2022, Rev. Proc. 2021-45.
SINGLE_2022 = [(0, 1000), (1_027_500, 1200), (4_177_500, 2200), (8_907_500, 2400), (17_005_000, 3200), (21_595_000, 3500), (53_990_000, 3700)]
_TAX_SQL = " + ".join(
    f"greatest({'amount_minor' if i == len(SINGLE_2022) - 1 else f'least(amount_minor, {SINGLE_2022[i + 1][0]})'} - {low}, 0) * {rate}" for i, (low, rate) in enumerate(SINGLE_2022)
)


@_query("bracket_tax", f"SELECT id, amount_minor, CAST((({_TAX_SQL}) * 2 + 10000) // 20000 AS BIGINT) AS tax_minor FROM transactions WHERE amount_minor >= 0", "transactions")
def _(s, d):
    rows = view(s, d, "transactions").where("amount_minor >= 0")
    return rows.select("id", "amount_minor", tax.bracket_tax(F.col("amount_minor"), SINGLE_2022).alias("tax_minor"))


@_query("dedupe_hashes", "SELECT statement_id, ordinal, CAST(row_number() OVER w - 1 AS INTEGER) AS occurrence_index, sha256(concat_ws('|', account_id, posted_date, amount_minor, description_raw, row_number() OVER w - 1)) AS dedupe_hash FROM raw_txns WINDOW w AS (PARTITION BY statement_id, account_id, posted_date, amount_minor, description_raw ORDER BY ordinal)", "raw_txns")
def _(s, d):
    return ledger.hashed(view(s, d, "raw_txns")).select("statement_id", "ordinal", "occurrence_index", "dedupe_hash")


@_query("dedupe_new_rows", "WITH n AS (SELECT *, CAST(row_number() OVER (PARTITION BY statement_id, account_id, posted_date, amount_minor, description_raw ORDER BY ordinal) - 1 AS INTEGER) AS occurrence_index FROM raw_txns) SELECT DISTINCT account_id, posted_date, amount_minor, description_raw, occurrence_index FROM n i ANTI JOIN (SELECT * FROM n WHERE statement_id % 2 = 0) e USING (account_id, posted_date, amount_minor, description_raw, occurrence_index) WHERE statement_id % 2 = 1", "raw_txns")
def _(s, d):
    rows = ledger.hashed(view(s, d, "raw_txns"))
    fresh = ledger.new_rows(rows.where("statement_id % 2 = 1"), rows.where("statement_id % 2 = 0"))
    return fresh.select("account_id", "posted_date", "amount_minor", "description_raw", "occurrence_index")


# Rows of few accounts, days and amounts, so that a statement has equal ones.
_EQUAL = "SELECT l_orderkey AS statement_id, l_suppkey % 5 AS account_id, CAST(concat(year(l_shipdate), '-01-01') AS DATE) AS posted_date, CAST(l_quantity AS BIGINT) % 3 * 100 AS amount_minor, concat('LINE ', l_linestatus) AS description_raw, l_linenumber AS ordinal FROM {lineitem}"
_NUMBERED = f"SELECT statement_id, account_id, posted_date, amount_minor, description_raw, CAST(row_number() OVER (PARTITION BY statement_id, account_id, posted_date, amount_minor, description_raw ORDER BY ordinal) - 1 AS INTEGER) AS occurrence_index FROM ({_EQUAL.format(lineitem='lineitem')})"


@_query("dedupe_new_rows_numbered", f"WITH n AS ({_NUMBERED}) SELECT DISTINCT i.* EXCLUDE (statement_id) FROM n i ANTI JOIN (SELECT * FROM n WHERE statement_id % 10 = 0) e USING (account_id, posted_date, amount_minor, description_raw, occurrence_index) WHERE i.statement_id % 10 <> 0")
def _(s, d):
    rows = ledger.hashed(s.sql(_EQUAL, lineitem=s.read.parquet(f"{d}/lineitem.parquet")))
    fresh = ledger.new_rows(rows.where("statement_id % 10 <> 0"), rows.where("statement_id % 10 = 0"))
    return fresh.select("account_id", "posted_date", "amount_minor", "description_raw", "occurrence_index")


_STATEMENTS = """SELECT o_orderkey AS statement_id, CASE WHEN o_orderkey % 3 = 0 THEN 'checking' ELSE 'credit' END AS account_type,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(1000 AS BIGINT) END AS opening_balance_minor, CASE WHEN o_orderkey % 4 <> 0 THEN 1000 + o_orderkey % 7 * 100 END AS closing_balance_minor,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 9 * 100 END AS stated_total_minor FROM {orders}"""


@_query("statement_reconciliation", "SELECT statement_id, coalesce(sum_minor, 0) AS sum_minor, coalesce(sum_minor, 0) - coalesce(CASE WHEN account_type = 'credit' THEN closing_balance_minor - opening_balance_minor ELSE opening_balance_minor - closing_balance_minor END, stated_total_minor) AS delta_minor FROM (" + _STATEMENTS.format(orders="orders") + ") LEFT JOIN (SELECT statement_id, CAST(sum(amount_minor) AS BIGINT) AS sum_minor FROM raw_txns GROUP BY statement_id) USING (statement_id)", "raw_txns")
def _(s, d):
    statements = s.sql(_STATEMENTS, orders=s.read.parquet(f"{d}/orders.parquet"))
    return ledger.reconciled(statements, view(s, d, "raw_txns")).select("statement_id", "sum_minor", "delta_minor")


# Days of transfers and of payments are matched in the order of their distance; how many are left of each day goes along from step to step.
_PAIRED = """WITH RECURSIVE l AS (SELECT DISTINCT id, user_id, amount_minor AS amount, posted_date - DATE '1970-01-01' AS day FROM settlements WHERE kind = 'transfer' AND account_type <> 'credit' AND id IS NOT NULL AND user_id IS NOT NULL AND amount_minor IS NOT NULL AND posted_date IS NOT NULL),
r AS (SELECT DISTINCT id, user_id, -amount_minor AS amount, posted_date - DATE '1970-01-01' AS day FROM settlements WHERE kind = 'payment' AND account_type = 'credit' AND id IS NOT NULL AND user_id IS NOT NULL AND amount_minor IS NOT NULL AND posted_date IS NOT NULL),
ln AS (SELECT *, row_number() OVER (PARTITION BY user_id, amount, day ORDER BY id) - 1 AS nth FROM l), rn AS (SELECT *, row_number() OVER (PARTITION BY user_id, amount, day ORDER BY id) - 1 AS nth FROM r),
lc AS (SELECT user_id, amount, day, count(*) AS n FROM l GROUP BY ALL), rc AS (SELECT user_id, amount, day, count(*) AS n FROM r GROUP BY ALL),
st AS (SELECT lc.user_id, lc.amount, lc.day AS td, rc.day AS pd, lc.n AS tn, rc.n AS pn, row_number() OVER (PARTITION BY lc.user_id, lc.amount ORDER BY abs(lc.day - rc.day), least(lc.day, rc.day), lc.day > rc.day) AS s FROM lc JOIN rc ON rc.user_id = lc.user_id AND rc.amount = lc.amount AND abs(lc.day - rc.day) <= 5),
w AS (SELECT DISTINCT user_id, amount, CAST(0 AS BIGINT) AS s, CAST(MAP([], []) AS MAP(BIGINT, BIGINT)) AS ut, CAST(MAP([], []) AS MAP(BIGINT, BIGINT)) AS up, CAST(0 AS BIGINT) AS td, CAST(0 AS BIGINT) AS pd, CAST(0 AS BIGINT) AS t0, CAST(0 AS BIGINT) AS p0, CAST(0 AS BIGINT) AS n FROM st
  UNION ALL SELECT user_id, amount, s, map_concat(ut, MAP([td], [t0 + n])), map_concat(up, MAP([pd], [p0 + n])), td, pd, t0, p0, n FROM (
    SELECT w.user_id, w.amount, st.s, ut, up, CAST(st.td AS BIGINT) AS td, CAST(st.pd AS BIGINT) AS pd, coalesce(ut[CAST(st.td AS BIGINT)], 0) AS t0, coalesce(up[CAST(st.pd AS BIGINT)], 0) AS p0, least(tn - coalesce(ut[CAST(st.td AS BIGINT)], 0), pn - coalesce(up[CAST(st.pd AS BIGINT)], 0)) AS n FROM w JOIN st ON st.user_id = w.user_id AND st.amount = w.amount AND st.s = w.s + 1)),
k AS (SELECT user_id, amount, td, pd, t0 + i AS tr, p0 + i AS pr FROM w, range(0, 100000) g(i) WHERE i < n)
SELECT ln.id AS transfer_id, rn.id AS payment_id FROM k JOIN ln ON ln.user_id = k.user_id AND ln.amount = k.amount AND ln.day = td AND ln.nth = tr JOIN rn ON rn.user_id = k.user_id AND rn.amount = k.amount AND rn.day = pd AND rn.nth = pr"""


@_query("transfer_pairing", _PAIRED, "settlements")
def _(s, d):
    return ledger.paired(view(s, d, "settlements"))


# The shapes of T.REDACTIONS and T.TRAILING_REFERENCE as RE2 has them.
_SHAPES = [
    ("[EMAIL]", r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}.+\-]+@[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\-]+\.[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+"), ("[AMOUNT]", r"\$[\s\x0B]?\d[\d,]*(?:\.\d+)?"), ("[CARD]", r"\d{12,19}"), ("[NUM]", r"\d{6,}"),
    ("[PHONE]", r"\+?\d[\d\-\(\) ]{8,}\d"),
]
_REFERENCE = r"(?i)(?:^|[\s\x0B])(?:REF#|AUTH|TRACE|ID:|INV)[^\s\x0B]*[\s\x0B]*$"


def _replaced(text: str, shapes: list[tuple[str, str]]) -> str:
    for token, shape in shapes:
        text = f"regexp_replace({text}, '{shape}', '{token}', 'g')"
    return text


@_query("redaction", f"SELECT doc_id, {_replaced('text', _SHAPES)} AS redacted FROM documents")
def _(s, d):
    """The shapes alone; redaction_full takes references at the end away too."""
    out = F.col("text")
    for token, shape in T.REDACTIONS:
        out = F.regexp_replace(out, shape, token)
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", out.alias("redacted"))


def _redacted(text: str) -> str:
    return f"rtrim({_replaced(text, [*_SHAPES, ('', _REFERENCE)])}, ' ')"


def _squeezed(text: str) -> str:
    return rf"trim(regexp_replace({text}, '[\s\x0B]+', ' ', 'g'), ' ')"


@_query("redaction_full", f"SELECT doc_id, {_redacted('text')} AS redacted FROM documents")
def _(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", T.redacted(F.col("text")).alias("redacted"))


_COUNTS = [(token.strip("[]").lower(), f"CAST(len(regexp_extract_all({_replaced('text', _SHAPES[:i])}, '{shape}')) AS INTEGER)") for i, (token, shape) in enumerate(_SHAPES)]


@_query("redaction_counts", f"SELECT doc_id, {', '.join(f'{c} AS {name}' for name, c in _COUNTS)} FROM documents")
def _(s, d):
    rows = s.read.parquet(f"{d}/documents.parquet").select("doc_id", T.redaction_counts(F.col("text")).alias("_n"))
    return rows.select("doc_id", *(F.col("_n")[name].alias(name) for name, _ in _COUNTS))


# Descriptions as statements have them: a processor's prefix, a merchant with its store, and what must not be shown.
_RAW = """SELECT l_orderkey AS statement_id, l_linenumber AS ordinal, concat(CASE l_orderkey % 4 WHEN 0 THEN 'SQ *' WHEN 1 THEN '  pos debit ' WHEN 2 THEN 'RECURRING PAYMENT ' ELSE '' END,
  CASE l_suppkey % 5 WHEN 0 THEN 'Blue Cafe' WHEN 1 THEN 'CORNER  SHOP' WHEN 2 THEN 'A1' WHEN 3 THEN 'Store' ELSE 'Dry-Clean & Co' END, CASE l_linenumber WHEN 1 THEN ' #12' WHEN 2 THEN ' store 77' WHEN 3 THEN ' 415' WHEN 4 THEN ' no. 9' ELSE '' END,
  CASE l_partkey % 6 WHEN 0 THEN ' +1 (555) 123-4567' WHEN 1 THEN ' a.b@shop.org' WHEN 2 THEN ' $12.50' WHEN 3 THEN ' 4111111111111111' WHEN 4 THEN ' 1234567' ELSE '' END,
  CASE WHEN l_orderkey % 3 = 0 THEN ' REF#99A' WHEN l_orderkey % 3 = 1 THEN ' inv77 ' ELSE '' END) AS raw FROM {lineitem}"""
_PREFIX = r"(?i)^[\s\x0B]*(?:" + "|".join(p.replace("*", r"\*") for p in sorted(T.PREFIXES, key=len, reverse=True)) + ")"
_SPACED = _squeezed(r"regexp_replace(regexp_replace(raw, '[\s\x0B]', ' ', 'g'), '[\p{Cc}\p{Cf}]', '', 'g')")
_DESCRIPTION = _squeezed(f"trim(regexp_replace({_redacted(_SPACED)}, '{_PREFIX}', ''), ' ')")


@_query("description", f"SELECT statement_id, ordinal, {_DESCRIPTION} AS description FROM ({_RAW.format(lineitem='lineitem')})")
def _(s, d):
    rows = s.sql(_RAW, lineitem=s.read.parquet(f"{d}/lineitem.parquet"))
    return rows.select("statement_id", "ordinal", T.description(F.col("raw")).alias("description"))


_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
_PLAIN = lambda text: _squeezed(rf"regexp_replace({text}, '[^{_WORD}\s\x0B]', ' ', 'g')")
_TOKENS = _squeezed(r"regexp_replace(cut, '\[(?:email|amount|card|num|phone|name|redacted)\]', ' ', 'g')")


# RE2 has no lookahead: that all is not digits is asked for by itself.
@_query("merchant_key", rf"""WITH clean AS (SELECT statement_id, ordinal, lower({_DESCRIPTION}) AS low FROM ({_RAW.format(lineitem='lineitem')})),
bare AS (SELECT *, {_squeezed(rf"regexp_replace({_squeezed(r"regexp_replace(low, '#[\s\x0B]*\d+', ' ', 'g')")}, '\b(?:store|no\.?)[\s\x0B]*#?\d+', ' ', 'g')")} AS key FROM clean),
numbered AS (SELECT *, CASE WHEN regexp_matches(key, '[^\d\s]') AND regexp_matches(key, '^.*\S \d+$') AND regexp_matches(key, '(?:^|\s)\S*\D\S*\s') THEN regexp_replace(key, ' \d+$', '') ELSE key END AS cut FROM bare),
short AS (SELECT *, {_PLAIN(_TOKENS)} AS short FROM numbered)
SELECT statement_id, ordinal, CASE WHEN length(replace(short, ' ', '')) < 3 THEN {_PLAIN('low')} ELSE short END AS merchant_key FROM short""")  # fmt: skip
def _(s, d):
    rows = s.sql(_RAW, lineitem=s.read.parquet(f"{d}/lineitem.parquet"))
    return rows.select("statement_id", "ordinal", T.merchant_key(T.description(F.col("raw"))).alias("merchant_key"))


@_query("money_parsing", "SELECT id, amount_minor, CAST(amount_minor AS BIGINT) AS parsed FROM transactions", "transactions")
def _(s, d):
    rows = view(s, d, "transactions").select("id", "amount_minor")
    plain = F.format_number(F.abs(F.col("amount_minor")).cast("decimal(20,0)") / 100, 2)
    text = F.when(F.col("amount_minor") < 0, F.when(F.col("id") % 3 == 0, F.concat(F.lit("("), plain, F.lit(")"))).when(F.col("id") % 3 == 1, F.concat(F.lit("-$"), plain)).otherwise(F.concat(plain, F.lit(" CR")))).otherwise(F.concat(F.lit("$"), plain))
    return rows.select("id", "amount_minor", T.money_minor(text).alias("parsed"))


def _rules(s, source: str):
    rows = {
        "user": [(1, 50, "exact", "building-7", "travel", "hotel", True), (2, 100, "contains", "auto", "dining", "bar", True), (3, 1, "regex", "^mach", "travel", "train", False)],
        "builtin": [(10, 100, "contains", "machinery", "groceries", "market", True), (11, 90, "regex", "^(house|auto).*-1\\d$", "online_shopping", "toys", True)],
    }[source]
    return s.createDataFrame(rows, "id int, priority int, match_type string, pattern string, category string, subcategory string, enabled boolean")


@_query("classification_cascade")
def _(s, d):
    known = s.createDataFrame([("furniture-3", "groceries", "bakery", 1.0, "user"), ("furniture-4", "dining", "bar", 0.6, "llm"), ("household-5", "travel", "flight", 0.9, "issuer")], "merchant_key string, category string, subcategory string, confidence double, source string")
    out = classify.cascade(view(s, d, "transactions"), _rules(s, "user"), known, _rules(s, "builtin"))
    return out.select("id", "category", "subcategory", "confidence", "classified_by", "needs_review")


SQL["classification_cascade"] = with_views("", "transactions") + """, c AS (SELECT id, merchant_key AS k, CASE
  WHEN kind IN ('payment', 'transfer') THEN ['others', 'payments_transfers', '1.0', 'kind'] WHEN merchant_key = '' THEN ['others', 'uncategorized', '0.0', 'llm']
  WHEN merchant_key = 'building-7' THEN ['travel', 'hotel', '1.0', 'user_rule'] WHEN contains(merchant_key, 'auto') THEN ['dining', 'bar', '1.0', 'user_rule']
  WHEN merchant_key = 'furniture-3' THEN ['groceries', 'bakery', '1.0', 'user']
  WHEN regexp_matches(merchant_key, '^(house|auto).*-1[0-9]$') THEN ['online_shopping', 'toys', '1.0', 'builtin_rule'] WHEN contains(merchant_key, 'machinery') THEN ['groceries', 'market', '1.0', 'builtin_rule']
  WHEN merchant_key = 'furniture-4' THEN ['dining', 'bar', '0.6', 'cache'] WHEN merchant_key = 'household-5' THEN ['travel', 'flight', '0.9', 'cache'] ELSE ['others', 'uncategorized', '0.0', 'llm'] END AS x FROM transactions)
SELECT id, x[1] AS category, x[2] AS subcategory, CAST(x[3] AS DOUBLE) AS confidence, x[4] AS classified_by, CAST(x[3] AS DOUBLE) < 0.7 AS needs_review FROM c"""


@_query("evaluation_confusion", "SELECT quality AS label, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL")
def _(s, d):
    return classify.confusion(s.read.parquet(f"{d}/labels.parquet").select(F.col("quality").alias("label"), F.col("toxic").alias("predicted")))


@_query("evaluation_accuracy", "SELECT quality AS label, count(*) AS total, CAST(sum(CASE WHEN quality = toxic THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM labels GROUP BY ALL")
def _(s, d):
    return classify.accuracy(s.read.parquet(f"{d}/labels.parquet").select(F.col("quality").alias("label"), F.col("toxic").alias("predicted")))


from hearthledger.plans import changes, forms, lists, models, statements, tax_pages, taxes, texts  # noqa: E402, F401 - they enter their queries
