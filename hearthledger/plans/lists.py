"""Queries of lists, dashboards, accounts and balances."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthledger.operators import accounts, balances, corrections, dashboard, ledger, networth, spend
from hearthledger.operators.spend import SpendQuery
from hearthledger.plans.registry import query
from hearthledger.sources import words
from hearthledger.sources.export import exported
from hearthledger.sources.fixtures import frame, view

_SPEND = "kind IN ('purchase', 'fee', 'interest', 'refund') AND currency = 'USD'"


def _spend(s, d, **of):
    return spend.spend(view(s, d, "transactions_core"), view(s, d, "categories"), view(s, d, "subcategories"), SpendQuery(**of))


@query("list_with_keys", "SELECT t.id, c.key AS category, s.key AS subcategory FROM transactions t LEFT JOIN categories c ON category_id = c.id LEFT JOIN subcategories s ON subcategory_id = s.id", "transactions", "categories", "subcategories")
def _(s, d):
    return accounts.with_keys(view(s, d, "transactions"), view(s, d, "categories"), view(s, d, "subcategories")).select("id", "category", "subcategory")


@query("list_of_category", "SELECT t.id FROM transactions t JOIN categories c ON category_id = c.id JOIN subcategories s ON subcategory_id = s.id WHERE c.key = 'dining' AND s.key = 'bar' AND user_id = 3", "transactions", "categories", "subcategories")
def _(s, d):
    rows = accounts.filtered(view(s, d, "transactions"), view(s, d, "categories"), view(s, d, "subcategories"), category="dining", subcategory="bar", user_id=3)
    return rows.select("id")


@query("list_unclassified", "SELECT id, count(*) OVER () AS total FROM transactions WHERE category_id IS NULL AND user_id = 2", "transactions")
def _(s, d):
    rows = accounts.filtered(view(s, d, "transactions"), view(s, d, "categories"), view(s, d, "subcategories"), unclassified=True, user_id=2)
    return rows.select("id").join(F.broadcast(accounts.page_total(rows)))


@query("list_of_statement", "SELECT statement_id, ordinal, amount_minor FROM raw_txns WHERE statement_id = 7", "raw_txns")
def _(s, d):
    none = s.createDataFrame([], "id int, key string")
    return accounts.filtered(view(s, d, "raw_txns"), none, none, statement_id=7).select("statement_id", "ordinal", "amount_minor")


@query("list_by_date", "SELECT id, posted_date FROM transactions WHERE kind = 'fee' ORDER BY posted_date, id LIMIT 500", "transactions")
def _(s, d):
    return spend.list_transactions(view(s, d, "transactions"), kinds=("fee",), sort="posted_date", size=500).select("id", "posted_date")


@query("statements_of_user", "SELECT s.id FROM statements s JOIN accounts a ON account_id = a.id WHERE a.user_id = 4", "statements", "accounts")
def _(s, d):
    return accounts.statements_of(view(s, d, "statements"), view(s, d, "accounts"), 4).select("id")


@query("previous_statement", "SELECT id, CASE WHEN status = 'parsed' THEN lag(id) OVER w END AS previous_id FROM statements WINDOW w AS (PARTITION BY account_id, status = 'parsed' ORDER BY ingested_at, id)", "statements")
def _(s, d):
    return accounts.before(view(s, d, "statements")).select("id", "previous_id")


@query("layout_drift", "SELECT id, warned OR coalesce(delta_minor <> 0, false) OR coalesce(abs(detect_score - lag(detect_score) OVER (PARTITION BY account_id ORDER BY ingested_at, id)) >= 0.15, false) AS drift FROM statements", "statements")
def _(s, d):
    rows = view(s, d, "statements").withColumnsRenamed({"id": "statement_id"}).withColumn("warnings", F.when(F.col("warned"), F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")))
    return ledger.drifted(rows).select(F.col("statement_id").alias("id"), "drift")


_SECTIONS = "SELECT l_orderkey AS statement_id, l_returnflag AS section, CAST(l_quantity AS BIGINT) * 100 AS amount_minor FROM lineitem"
_PRINTED = "SELECT o_orderkey AS statement_id, f AS section, o_orderkey % 3 * 1000 AS printed_minor FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'N' ELSE 'X' END AS f FROM orders) t"


@query("section_totals", f"SELECT p.statement_id, p.section, coalesce(CAST(s AS BIGINT), 0) - printed_minor AS delta_minor FROM ({_PRINTED}) p LEFT JOIN (SELECT statement_id, section, sum(amount_minor) AS s FROM ({_SECTIONS}) GROUP BY ALL) x ON x.statement_id = p.statement_id AND x.section = p.section")
def _(s, d):
    return ledger.section_gaps(frame(s, d, _PRINTED), frame(s, d, _SECTIONS)).select("statement_id", "section", "delta_minor")


@query("accounts_resolved", "WITH k AS (SELECT user_id, issuer_id, mask, account_type, min(id) AS account_id FROM accounts WHERE id % 2 = 0 GROUP BY ALL) SELECT a.id, account_id, concat(i.name, ' ', a.account_type, CASE WHEN a.mask <> '' THEN concat(' ...', a.mask) ELSE '' END) AS display_name FROM accounts a JOIN issuers i ON issuer_id = i.id LEFT JOIN k ON a.user_id = k.user_id AND a.issuer_id = k.issuer_id AND a.mask = k.mask AND a.account_type = k.account_type", "accounts", "issuers")
def _(s, d):
    every = view(s, d, "accounts")
    return accounts.resolved(every, every.where("id % 2 = 0"), view(s, d, "issuers")).select("id", "account_id", "display_name")


@query("accounts_to_add", "SELECT user_id, issuer_id, mask, account_type, min(currency) AS currency FROM accounts GROUP BY ALL HAVING count(*) FILTER (id % 2 = 0) = 0", "accounts")
def _(s, d):
    every = view(s, d, "accounts")
    return accounts.new_accounts(accounts.resolved(every, every.where("id % 2 = 0"), view(s, d, "issuers"))).drop("display_name")


@query("other_currencies", "SELECT DISTINCT currency FROM accounts WHERE currency <> 'USD'", "accounts")
def _(s, d):
    return accounts.other_currencies(view(s, d, "accounts"), "USD")


@query("integrity_checks", "SELECT 'kind' AS check, (SELECT count(*) FROM transactions WHERE kind NOT IN ('purchase', 'refund', 'payment', 'transfer', 'fee', 'interest')) AS rows UNION ALL SELECT 'category pair', (SELECT count(*) FROM transactions WHERE (category_id IS NULL) <> (subcategory_id IS NULL)) UNION ALL SELECT 'income sign', (SELECT count(*) FROM income_items WHERE amount_minor < 0 AND NOT contains(category, 'capital_gain')) UNION ALL SELECT 'tax sign', (SELECT count(*) FROM tax_lines WHERE amount_minor < 0) UNION ALL SELECT 'balance', (SELECT count(*) FROM balance_entries WHERE balance_minor < 0 OR month NOT BETWEEN 1 AND 12)", "transactions", "income_items", "tax_lines", "balance_entries")
def _(s, d):
    kinds = [k for k in spend.KINDS if k != "adjustment"]
    return accounts.violations(view(s, d, "transactions"), view(s, d, "income_items"), view(s, d, "tax_lines"), view(s, d, "balance_entries"), kinds)


@query("totals_by_user", f"SELECT user_id, CAST(sum(amount_minor) AS BIGINT) AS total_minor FROM transactions WHERE {_SPEND} GROUP BY user_id", "transactions")
def _(s, d):
    return dashboard.totals_by_user(_spend(s, d, group_by=("user",), grain="all"))


@query("trend_by_quarter", f"SELECT concat(year(posted_date), '-Q', quarter(posted_date)) AS period, CAST(sum(amount_minor) AS BIGINT) AS total_minor FROM transactions WHERE {_SPEND} GROUP BY 1", "transactions")
def _(s, d):
    return dashboard.trend(_spend(s, d, group_by=("period", "category"), grain="quarter"))


@query("latest_change", f"WITH t AS (SELECT strftime(posted_date, '%Y-%m') AS period, CAST(sum(amount_minor) AS BIGINT) AS total_minor FROM transactions WHERE {_SPEND} GROUP BY 1 ORDER BY 1 DESC LIMIT 2), a AS (SELECT * FROM t ORDER BY period DESC LIMIT 1), b AS (SELECT * FROM t ORDER BY period LIMIT 1) SELECT a.period AS current_period, b.period AS previous_period, a.total_minor AS current_minor, b.total_minor AS previous_minor, a.total_minor - b.total_minor AS delta_minor, CASE WHEN b.total_minor <> 0 THEN (a.total_minor - b.total_minor) / abs(b.total_minor) END AS delta_pct FROM a, b", "transactions")
def _(s, d):
    return dashboard.latest_change(dashboard.trend(_spend(s, d, group_by=("period",))))


@query("month_report", f"SELECT strftime(posted_date, '%Y-%m') AS period, coalesce(c.key, 'uncategorized') AS category, currency, CAST(CAST(sum(amount_minor) / 100 AS DECIMAL(20,2)) AS VARCHAR) AS total, count(*) AS txn_count FROM transactions LEFT JOIN categories c ON category_id = c.id WHERE {_SPEND} GROUP BY ALL", "transactions", "categories")
def _(s, d):
    return dashboard.report(_spend(s, d))


@query("change_of_months", f"WITH t AS (SELECT strftime(posted_date, '%Y-%m') AS period, CAST(sum(amount_minor) AS BIGINT) AS total_minor FROM transactions WHERE {_SPEND} GROUP BY 1), p AS (SELECT *, lag(total_minor) OVER (ORDER BY period) AS previous_minor FROM t) SELECT period, total_minor, previous_minor, total_minor - previous_minor AS change_minor, CASE WHEN previous_minor <> 0 THEN CAST(sign(total_minor - previous_minor) * (abs(total_minor - previous_minor) * 10000 // abs(previous_minor)) AS BIGINT) END AS change_bp FROM p", "transactions")
def _(s, d):
    return spend.change_by_month(_spend(s, d, group_by=("period",))).select("period", "total_minor", "previous_minor", "change_minor", "change_bp")


@query("balance_list", "SELECT user_id, year, month, category, account_name FROM balance_entries WHERE lower(account_name) = 'acct3' AND year = 1996", "balance_entries")
def _(s, d):
    return balances.listed(view(s, d, "balance_entries"), name=" ACCT3 ", year=1996).select("user_id", "year", "month", "category", "account_name")


_SPELLED = "SELECT user_id, category, year, month, CASE WHEN month % 2 = 0 THEN upper(account_name) ELSE concat(account_name, ' ') END AS account_name, balance_minor, currency FROM balance_entries"


@query("balance_suggestions", f"WITH e AS ({_SPELLED}), k AS (SELECT category, lower(trim(account_name)) AS k, max((year, month, account_name)) AS w FROM e GROUP BY ALL) SELECT category, w[3] AS account_name, CAST(row_number() OVER (PARTITION BY category ORDER BY w DESC, k) AS INTEGER) AS place FROM k", "balance_entries")
def _(s, d):
    return balances.suggestions(frame(s, d, _SPELLED))


_INCOMING = "SELECT user_id, category, year, month, upper(account_name) AS account_name, balance_minor + 1 AS balance_minor, 'GBP' AS currency, 'new' AS note, month AS seq FROM balance_entries WHERE month <= 3"


@query("balance_upsert", "SELECT user_id, category, year, month, CASE WHEN year % 2 = 0 AND month <= 3 THEN upper(account_name) ELSE account_name END AS account_name, CASE WHEN month <= 3 THEN balance_minor + 1 ELSE balance_minor END AS balance_minor, CASE WHEN month <= 3 THEN 'GBP' ELSE currency END AS currency, CASE WHEN month <= 3 THEN 'new' END AS note FROM balance_entries WHERE NOT (year % 2 = 0 AND month > 3)", "balance_entries")
def _(s, d):
    stored = view(s, d, "balance_entries").where("year % 2 = 1").withColumn("note", F.lit(None).cast("string"))
    return balances.upserted(stored, frame(s, d, _INCOMING))


@query("balance_shares", "WITH s AS (SELECT category, CAST(sum(b) AS BIGINT) AS balance_minor FROM (SELECT category, arg_max(balance_minor, year * 12 + month) AS b FROM balance_entries WHERE currency = 'USD' AND year * 12 + month - 1 <= 1998 * 12 + 5 GROUP BY user_id, category, account_name) WHERE category <> 'credit_card' GROUP BY category) SELECT category, balance_minor, balance_minor / (SELECT sum(balance_minor) FROM s) * 100 AS percent FROM s", "balance_entries")
def _(s, d):
    return balances.shares(networth.snapshot(view(s, d, "balance_entries"), 1998, 6))


@query("net_worth_capped", "WITH e AS (SELECT *, year * 12 + month - 1 AS m FROM balance_entries WHERE currency = 'USD'), cal AS (SELECT unnest(range((SELECT max(m) FROM e) - 11, (SELECT max(m) FROM e) + 1)) AS mm) SELECT user_id, category, account_name, CAST(mm AS INTEGER) AS month_number, arg_max(balance_minor, m) AS balance_minor FROM e JOIN cal ON m <= mm GROUP BY ALL", "balance_entries")
def _(s, d):
    return balances.account_series(networth.monthly(view(s, d, "balance_entries"), max_months=12)).drop("carried")


@query("export_of_user", "SELECT t.id, account_id, posted_date, description_clean, amount_minor, currency, kind, c.key AS category_key, s.key AS subcategory_key, merchant_key, needs_review FROM transactions t LEFT JOIN categories c ON category_id = c.id LEFT JOIN subcategories s ON subcategory_id = s.id WHERE user_id = 1", "transactions", "categories", "subcategories")
def _(s, d):
    rows = accounts.with_keys(view(s, d, "transactions"), view(s, d, "categories"), view(s, d, "subcategories"))
    return exported(rows.withColumnsRenamed({"category": "category_key", "subcategory": "subcategory_key"}).withColumn("mask", F.lit("1234")), 1)


# Words of documents as pages of a hundred words.
_WORDS = """SELECT CAST(doc_id AS VARCHAR(20)) AS file_sha256, CAST(pos DIV 100 + 1 AS INT) AS page_number, w AS text FROM (SELECT doc_id, posexplode(split(text, ' ')) AS (pos, w) FROM documents WHERE text IS NOT NULL) t"""
_WORDS_SQL = "SELECT CAST(doc_id AS VARCHAR) AS file_sha256, CAST((pos - 1) // 100 + 1 AS INTEGER) AS page_number, w AS text FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents WHERE text IS NOT NULL)"


@query("page_selection", f"WITH w AS ({_WORDS_SQL}), h AS (SELECT file_sha256, bool_or(page_number IN (2, 3)) AS has FROM w GROUP BY file_sha256) SELECT file_sha256, page_number, count(*) AS n FROM w JOIN h USING (file_sha256) WHERE page_number IN (2, 3) OR NOT has GROUP BY ALL")
def _(s, d):
    chosen = words.select_pages(frame(s, d, _WORDS), words.page_numbers("2-3"))
    return chosen.groupBy("file_sha256", "page_number").agg(F.count("*").alias("n"))


@query("text_layers", f"WITH c AS (SELECT file_sha256, page_number, sum(length(text) + 1) AS c FROM ({_WORDS_SQL}) GROUP BY ALL) SELECT file_sha256, median(c) >= 50 AS has_text_layer FROM c GROUP BY file_sha256")
def _(s, d):
    return words.has_text_layer(frame(s, d, _WORDS))


_SPECS = "SELECT o_orderkey AS id, o_custkey % 5 AS issuer_id, CASE o_orderkey % 3 WHEN 0 THEN 'credit' WHEN 1 THEN 'checking' END AS account_type, o_orderkey % 17 AS version, o_orderkey % 4 > 0 AS approved FROM orders"


@query("layout_versions", f"SELECT id, version FROM ({_SPECS}) WHERE approved AND issuer_id = 2 AND (account_type IS NULL OR account_type = 'credit') ORDER BY version DESC, id DESC LIMIT 1")
def _(s, d):
    return accounts.versions(frame(s, d, _SPECS), 2, "credit").select("id", "version")


_NOTED = "SELECT row_number() OVER (ORDER BY user_id, category, account_name, year, month, currency) AS id, balance_minor, CAST(NULL AS VARCHAR(9)) AS note FROM balance_entries"
_PATCHES = "SELECT id, CASE WHEN id % 4 = 0 THEN CAST(5 AS BIGINT) END AS balance_minor, 'seen' AS note, id % 6 = 0 AS set_note FROM ({noted}) n WHERE id % 2 = 0"


@query("balance_patch", f"WITH n AS ({_NOTED}) SELECT id, CASE WHEN id % 4 = 0 THEN 5 ELSE balance_minor END AS balance_minor, CASE WHEN id % 6 = 0 THEN 'seen' END AS note FROM n WHERE id % 5 <> 0", "balance_entries")
def _(s, d):
    rows = frame(s, d, _NOTED)
    changed = balances.patched(rows, frame(s, d, _PATCHES.format(noted=_NOTED)))
    return balances.deleted(changed, rows.where("id % 5 = 0").select("id"))


@query("unknown_taxonomy_pairs", "SELECT t.id, c.key AS category, s.key AS subcategory FROM transactions t JOIN categories c ON category_id = c.id JOIN subcategories s ON subcategory_id = s.id WHERE (c.key, s.key) NOT IN (('groceries', 'supermarket'), ('dining', 'bar'), ('travel', 'hotel'))", "transactions", "categories", "subcategories")
def _(s, d):
    rows = accounts.with_keys(view(s, d, "transactions"), view(s, d, "categories"), view(s, d, "subcategories")).where("category is not null")
    known = s.createDataFrame([("groceries", "supermarket"), ("dining", "bar"), ("travel", "hotel")], "category string, subcategory string")
    return corrections.unknown_pairs(rows, known).select("id", "category", "subcategory")
