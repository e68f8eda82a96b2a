"""Household-finance tables derived from the star-schema test tables.

Each view is one SQL text that Spark and DuckDB both run, so queries and their oracles start from the
same rows. Money is a whole number of minor units throughout.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "transactions": """
SELECT o_orderkey AS id, o_custkey AS account_id, o_custkey % 7 AS user_id, CAST(o_orderdate AS DATE) AS posted_date,
       CASE o_orderkey % 10 WHEN 0 THEN 'refund' WHEN 1 THEN 'payment' WHEN 2 THEN 'transfer' WHEN 3 THEN 'fee'
            WHEN 4 THEN 'interest' WHEN 5 THEN 'adjustment' ELSE 'purchase' END AS kind,
       CASE WHEN o_orderkey % 10 IN (0, 1) THEN -1 ELSE 1 END * CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS amount_minor,
       CASE WHEN o_custkey % 11 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
       CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 END AS category_id,
       CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(substring(o_orderpriority, 1, 1) AS INT) * 10 + CAST(o_orderkey % 3 AS INT) END AS subcategory_id,
       CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat(lower(c_mktsegment), '-', CAST(o_orderkey % 50 AS VARCHAR(20))) END AS merchant_key,
       CASE WHEN o_orderkey % 4 = 0 THEN concat(c_mktsegment, ' ', CAST(o_orderkey % 50 AS VARCHAR(20))) END AS merchant_canonical,
       CASE WHEN o_orderkey % 17 = 0 THEN 'Save 100%_OFF now' ELSE concat('POS ', c_mktsegment) END AS description_clean,
       o_orderkey % 6 = 0 AS needs_review
FROM orders JOIN customer ON o_custkey = c_custkey""",
    # The same rows without merchants and texts, for which customers are not needed.
    "transactions_core": """
SELECT o_orderkey AS id, o_custkey AS account_id, o_custkey % 7 AS user_id, CAST(o_orderdate AS DATE) AS posted_date,
       CASE o_orderkey % 10 WHEN 0 THEN 'refund' WHEN 1 THEN 'payment' WHEN 2 THEN 'transfer' WHEN 3 THEN 'fee'
            WHEN 4 THEN 'interest' WHEN 5 THEN 'adjustment' ELSE 'purchase' END AS kind,
       CASE WHEN o_orderkey % 10 IN (0, 1) THEN -1 ELSE 1 END * CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS amount_minor,
       CASE WHEN o_custkey % 11 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
       CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 END AS category_id,
       CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(substring(o_orderpriority, 1, 1) AS INT) * 10 + CAST(o_orderkey % 3 AS INT) END AS subcategory_id,
       o_orderkey % 6 = 0 AS needs_review
FROM orders""",
    "categories": """
SELECT * FROM (VALUES (1, 'groceries'), (2, 'dining'), (3, 'travel'), (4, 'online_shopping')) AS t(id, key)""",
    "subcategories": """
SELECT s.id, s.key, s.status, s.merged_into FROM (VALUES
  (10, 'supermarket', 'active', NULL), (11, 'bakery', 'merged', 10), (12, 'market', 'active', NULL),
  (20, 'restaurant', 'active', NULL), (21, 'bar', 'active', NULL), (22, 'takeaway', 'merged', 99),
  (30, 'flight', 'active', NULL), (31, 'hotel', 'active', NULL), (32, 'train', 'merged', 31),
  (40, 'books', 'active', NULL), (41, 'music', 'merged', 40), (42, 'toys', 'pending_approval', NULL)) AS s(id, key, status, merged_into)""",
    "balance_entries": """
SELECT user_id, category, account_name, year, month, max(balance_minor) AS balance_minor, currency FROM (
  SELECT o_custkey % 5 AS user_id,
         CASE o_custkey % 4 WHEN 0 THEN 'checking' WHEN 1 THEN 'savings' WHEN 2 THEN 'investment' ELSE 'credit_card' END AS category,
         concat('acct', CAST(o_custkey AS VARCHAR(20))) AS account_name, year(o_orderdate) AS year, month(o_orderdate) AS month,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS balance_minor,
         CASE WHEN o_custkey % 23 = 0 THEN 'EUR' ELSE 'USD' END AS currency
  FROM orders WHERE o_custkey % 3 = 0) b
GROUP BY user_id, category, account_name, year, month, currency""",
    "tax_forms": """
SELECT l_suppkey * 100 + year(l_shipdate) - 1990 AS id, l_suppkey % 13 AS document_id, l_suppkey % 6 AS user_id, year(l_shipdate) AS tax_year,
       CASE l_suppkey % 9 WHEN 0 THEN 'w2' WHEN 1 THEN '1099-int' WHEN 2 THEN '1099-div' WHEN 3 THEN '1099-b' WHEN 4 THEN '1099-nec'
            WHEN 5 THEN '1099-misc' WHEN 6 THEN '1099-consolidated' WHEN 7 THEN '1040' ELSE 'state-return' END AS form_type,
       CASE WHEN l_suppkey % 9 IN (7, 8) THEN 'return' ELSE 'source' END AS role,
       CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE concat('Payer ', CAST(l_suppkey % 20 AS VARCHAR(20))) END AS payer_name,
       CASE WHEN l_suppkey % 8 = 0 THEN 1 ELSE 0 END AS is_corrected
FROM lineitem GROUP BY l_suppkey, year(l_shipdate)""",
    "income_items": """
SELECT l_suppkey * 100 + year(l_shipdate) - 1990 AS form_id, l_suppkey % 6 AS user_id, year(l_shipdate) AS tax_year,
       CASE l_linenumber WHEN 1 THEN 'salary_wages' WHEN 2 THEN 'interest' WHEN 3 THEN 'ordinary_dividends' WHEN 4 THEN 'qualified_dividends'
            WHEN 5 THEN 'short_term_capital_gain' WHEN 6 THEN 'long_term_capital_gain' ELSE 'other' END AS category,
       CASE WHEN l_linenumber IN (5, 6) THEN -1 ELSE 1 END * CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS amount_minor,
       l_linenumber = 4 OR l_orderkey % 29 = 0 AS is_memo
FROM lineitem""",
    "tax_items": """
SELECT l_suppkey * 100 + year(l_shipdate) - 1990 AS form_id, l_suppkey % 6 AS user_id, year(l_shipdate) AS tax_year,
       CASE l_linenumber WHEN 1 THEN 'federal_income_tax_withheld' WHEN 2 THEN 'state_income_tax_withheld' WHEN 3 THEN 'social_security_tax'
            WHEN 4 THEN 'medicare_tax' WHEN 5 THEN 'total_federal_tax' WHEN 6 THEN 'total_payments' ELSE 'local_income_tax_withheld' END AS category,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT) AS amount_minor
FROM lineitem WHERE l_tax > 0""",
    "raw_txns": """
SELECT l_orderkey AS statement_id, l_suppkey AS account_id, CAST(l_shipdate AS DATE) AS posted_date,
       CAST(l_quantity AS BIGINT) * 100 AS amount_minor, concat('LINE ', l_returnflag, l_linestatus) AS description_raw, l_linenumber AS ordinal
FROM lineitem""",
    "settlements": """
SELECT event_id AS id, user_id % 50 AS user_id, CAST(ts AS DATE) AS posted_date,
       CASE event_type WHEN 'purchase' THEN 'checking' ELSE 'credit' END AS account_type,
       CASE event_type WHEN 'purchase' THEN 'transfer' ELSE 'payment' END AS kind,
       CASE event_type WHEN 'purchase' THEN 1 ELSE -1 END * (CAST(floor(value) AS BIGINT) % 40 + 1) * 100 AS amount_minor
FROM events WHERE event_type IN ('purchase', 'click')""",
    "tax_lines": """
SELECT form_id, user_id, tax_year, category, amount_minor, CASE WHEN category = 'state_income_tax_withheld' THEN 'CA' END AS jurisdiction,
       CASE form_id % 4 WHEN 0 THEN 'llm' WHEN 1 THEN 'manual' ELSE 'parser' END AS origin FROM (
  SELECT l_suppkey * 100 + year(l_shipdate) - 1990 AS form_id, l_suppkey % 6 AS user_id, year(l_shipdate) AS tax_year, l_partkey % 16 AS k,
         CASE l_partkey % 16 WHEN 0 THEN 'federal_income_tax_withheld' WHEN 1 THEN 'state_income_tax_withheld' WHEN 2 THEN 'local_income_tax_withheld'
              WHEN 3 THEN 'social_security_tax' WHEN 4 THEN 'medicare_tax' WHEN 5 THEN 'total_federal_tax' WHEN 6 THEN 'federal_tax_ordinary_est'
              WHEN 7 THEN 'federal_tax_preferential_est' WHEN 8 THEN 'net_investment_income_tax' WHEN 9 THEN 'additional_medicare_tax' WHEN 10 THEN 'self_employment_tax'
              WHEN 11 THEN 'state_income_tax_liability' WHEN 12 THEN 'estimated_tax_payments' WHEN 13 THEN 'total_payments' WHEN 14 THEN 'refund' ELSE 'amount_owed' END AS category,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) % 1000000 AS amount_minor
  FROM lineitem) t
WHERE NOT (k IN (14, 15) AND (user_id + tax_year) % 2 = 0) AND NOT (k = 5 AND (user_id + tax_year) % 5 = 0) AND NOT (k = 13 AND (user_id + tax_year) % 7 = 0)
  AND NOT (k NOT IN (5, 13, 14, 15) AND (user_id + tax_year + k) % 4 = 0)""",
    "accounts": """
SELECT c_custkey AS id, c_custkey % 7 AS user_id, CAST(c_nationkey % 5 AS BIGINT) AS issuer_id, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE lpad(CAST(c_custkey % 40 AS VARCHAR(10)), 4, '0') END AS mask,
       CASE c_custkey % 3 WHEN 0 THEN 'checking' WHEN 1 THEN 'savings' ELSE 'credit' END AS account_type, CASE c_custkey % 11 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' ELSE 'USD' END AS currency
FROM customer""",
    "issuers": """
SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'North Bank'), (1, 'Alder Card'), (2, 'Fern Savings'), (3, 'Quay Credit'), (4, 'Vale Trust')) AS t(id, name)""",
    "statements": """
SELECT o_orderkey AS id, o_custkey AS account_id, o_orderdate AS ingested_at, CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'parsed' END AS status,
       CASE WHEN o_orderkey % 9 <> 0 THEN CAST((o_orderkey % 21) / 20.0 AS DOUBLE) END AS detect_score, o_orderkey % 12 = 0 AS warned, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 3 - 1 END AS delta_minor
FROM orders""",
}


BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "pages", "conversations")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of SQL over base tables and views; the same text runs in DuckDB, where tables are views of these names."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    used = set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql))
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used if t in BASE} | {v: view(spark, sf_dir, v) for v in used if v in VIEWS}
    text = re.sub(r"\b(FROM|JOIN)\s+(\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in frames else m[0], sql)
    return spark.sql(text, **frames)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view as a DataFrame; its base tables are read from sf_dir."""
    return frame(spark, sf_dir, VIEWS[name])


def with_views(sql: str, *names: str) -> str:
    """An oracle's SQL, preceded by the views that it needs."""
    needed: dict[str, str] = {}

    def need(name: str) -> None:
        for used in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", VIEWS[name]):
            if used in VIEWS and used not in needed:
                need(used)
        needed[name] = VIEWS[name]

    for n in names:
        need(n)
    start = "WITH RECURSIVE " if sql.startswith("WITH RECURSIVE ") else "WITH "
    if sql.startswith(start):
        sql = ", " + sql[len(start) :]
    return start + ",\n".join(f"{n} AS ({v})" for n, v in needed.items()) + "\n" + sql
