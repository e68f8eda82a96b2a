"""Queries of what changes tables: classification, corrections, the merchant map, moving statements, pairing."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthledger.operators import accounts, classify, corrections, ledger
from hearthledger.plans.registry import query
from hearthledger.sources import reference
from hearthledger.sources.fixtures import frame, view

# Transactions as they come in: some with an issuer's label, in any spelling.
_INCOMING = """SELECT id, user_id, merchant_key, description_clean, kind, CASE id % 9 WHEN 0 THEN 'gas  stations' WHEN 1 THEN 'Dining' WHEN 2 THEN ' MERCHANDISE ' WHEN 3 THEN 'Phone' END AS issuer_category, CASE WHEN id % 2 = 0 THEN 'layout-b' ELSE 'layout-c' END AS parser_id FROM transactions"""
_LABELS = "[('dining', '*', 'restaurant', 'dine_in'), ('gas stations', '*', 'fuel', 'gasoline'), ('phone', '*', 'utilities', 'phone'), ('phone', 'layout-c', 'electronics', 'devices')]"


def _labels(s):
    own = s.createDataFrame([("layout-c", "phone", "electronics", "devices")], "parser_id string, label string, category string, subcategory string")
    return classify.issuer_labels(s).unionByName(own)


@query("issuer_category", f"WITH t AS ({_INCOMING}), x AS (SELECT id, parser_id, lower(trim(regexp_replace(issuer_category, '\\s+', ' ', 'g'))) AS l FROM t) SELECT id, CASE WHEN l = 'phone' AND parser_id = 'layout-c' THEN 'electronics/devices' WHEN l = 'phone' THEN 'utilities/phone' WHEN l = 'dining' THEN 'restaurant/dine_in' WHEN l = 'gas stations' THEN 'fuel/gasoline' END AS pair FROM x", "transactions")
def _(s, d):
    rows = classify.issuer_category(frame(s, d, _INCOMING), _labels(s))
    return rows.select("id", F.when(F.col("_issuer").isNotNull(), F.concat_ws("/", "_issuer.category", "_issuer.subcategory")).alias("pair"))


_RULE = "id int, user_id bigint, priority int, match_type string, pattern string, category string, subcategory string, kind_override string, enabled boolean"


def _user_rules(s):
    return s.createDataFrame([(1, None, 50, "exact", "Building-7", "travel", "hotel", None, True), (2, 3, 10, "contains", "AUTO", "dining", "bar", "fee", True), (3, None, 1, "regex", "^mach", "travel", "train", None, False), (4, 5, 50, "exact", "building-8", "travel", "flight", None, True)], _RULE)


def _builtin(s):
    return s.createDataFrame([(10, None, 100, "contains", "machinery", "groceries", "market", None, True), (11, None, 90, "regex", "^(house|auto).*-1\\d$", "online_shopping", "toys", None, True)], _RULE)


def _known(s):
    return s.createDataFrame([("furniture-3", "groceries", "bakery", 1.0, "user", 4), ("furniture-4", "dining", "bar", 0.6, "llm", 0), ("household-5", "travel", "flight", 0.9, "issuer", 1)], "merchant_key string, category string, subcategory string, confidence double, source string, hit_count bigint")


def _run(s, d):
    return classify.cascade(frame(s, d, _INCOMING), _user_rules(s), _known(s), _builtin(s))


_CASCADE = f"""t AS ({_INCOMING}), l AS (SELECT *, lower(trim(regexp_replace(issuer_category, '\\s+', ' ', 'g'))) AS label FROM t), c AS (SELECT id, merchant_key, kind, CASE
  WHEN kind IN ('payment', 'transfer') THEN ['others', 'payments_transfers', '1.0', 'kind', ''] WHEN merchant_key <> '' AND contains(merchant_key, 'auto') AND user_id = 3 THEN ['dining', 'bar', '1.0', 'user_rule', 'fee']
  WHEN merchant_key = 'building-7' THEN ['travel', 'hotel', '1.0', 'user_rule', ''] WHEN merchant_key = 'building-8' AND user_id = 5 THEN ['travel', 'flight', '1.0', 'user_rule', ''] WHEN merchant_key = 'furniture-3' THEN ['groceries', 'bakery', '1.0', 'user', '']
  WHEN regexp_matches(merchant_key, '^(house|auto).*-1[0-9]$') THEN ['online_shopping', 'toys', '1.0', 'builtin_rule', ''] WHEN contains(merchant_key, 'machinery') THEN ['groceries', 'market', '1.0', 'builtin_rule', '']
  WHEN label = 'gas stations' THEN ['fuel', 'gasoline', '0.9', 'issuer', ''] WHEN label = 'dining' THEN ['restaurant', 'dine_in', '0.9', 'issuer', ''] WHEN label = 'phone' THEN ['utilities', 'phone', '0.9', 'issuer', '']
  WHEN merchant_key = 'furniture-4' THEN ['dining', 'bar', '0.6', 'cache', ''] WHEN merchant_key = 'household-5' THEN ['travel', 'flight', '0.9', 'cache', ''] ELSE ['others', 'uncategorized', '0.0', 'llm', ''] END AS x FROM l),
r AS (SELECT id, merchant_key, CASE WHEN x[5] <> '' THEN x[5] ELSE kind END AS kind, x[1] AS category, x[2] AS subcategory, CAST(x[3] AS DOUBLE) AS confidence, x[4] AS classified_by, CAST(x[3] AS DOUBLE) < 0.7 AS needs_review FROM c)"""  # fmt: skip


@query("cascade_with_issuer", f", {_CASCADE} SELECT id, kind, kind IN ('purchase', 'fee', 'interest') AS is_spend, category, subcategory, confidence, classified_by, needs_review FROM r", "transactions")
def _(s, d):
    return _run(s, d).select("id", "kind", "is_spend", "category", "subcategory", "confidence", "classified_by", "needs_review")


@query("cascade_audit", f", {_CASCADE} SELECT id AS transaction_id, category AS category_key, subcategory AS subcategory_key, confidence, classified_by AS method FROM r", "transactions")
def _(s, d):
    return classify.audit(_run(s, d))


@query("cascade_counters", f", {_CASCADE} SELECT count(*) AS total, count(*) FILTER (classified_by <> 'llm') AS classified, count(*) FILTER (needs_review) AS needs_review, {', '.join(f"count(*) FILTER (classified_by = '{b}') AS by_{b}" for b in ('kind', 'user_rule', 'user', 'builtin_rule', 'issuer', 'cache', 'llm'))} FROM r", "transactions")
def _(s, d):
    return classify.counters(_run(s, d))


@query("cascade_hits", f", {_CASCADE}, m(merchant_key, source, hit_count) AS (VALUES ('furniture-3', 'user', 4), ('furniture-4', 'llm', 0), ('household-5', 'issuer', 1)) SELECT m.merchant_key, source, CAST(m.hit_count + count(r.id) AS BIGINT) AS hit_count FROM m LEFT JOIN r ON r.merchant_key = m.merchant_key AND classified_by IN ('user', 'cache') GROUP BY m.merchant_key, source, m.hit_count", "transactions")
def _(s, d):
    return classify.with_hits(_known(s), _run(s, d)).select("merchant_key", "source", "hit_count")


@query("representatives", "SELECT merchant_key, first(description_clean ORDER BY n DESC, length(description_clean), description_clean) AS description FROM (SELECT merchant_key, description_clean, count(*) AS n FROM transactions WHERE trim(merchant_key) <> '' GROUP BY ALL) GROUP BY merchant_key", "transactions")
def _(s, d):
    return classify.representatives(view(s, d, "transactions"))


@query("model_batches", "SELECT merchant_key, CAST((row_number() OVER (ORDER BY merchant_key) - 1) // 50 AS BIGINT) AS batch, CAST((row_number() OVER (ORDER BY merchant_key) - 1) % 50 + 1 AS INTEGER) AS row FROM (SELECT DISTINCT merchant_key FROM transactions WHERE trim(merchant_key) <> '')", "transactions")
def _(s, d):
    return classify.in_batches(classify.representatives(view(s, d, "transactions"))).select("merchant_key", "batch", "row")


@query("model_fallback", "SELECT DISTINCT merchant_key, 'others' AS category, 'uncategorized' AS subcategory, CAST(0 AS DOUBLE) AS confidence, true AS needs_review FROM transactions WHERE trim(merchant_key) <> ''", "transactions")
def _(s, d):
    return classify.ask(classify.representatives(view(s, d, "transactions"))).drop("merchant_canonical")


_LABELLED = "SELECT merchant_key, CASE WHEN id % 3 = 0 THEN 'groceries' ELSE 'others' END AS label FROM transactions"


@query("evaluation_of_rules", f", l AS ({_LABELLED}), p AS (SELECT label, CASE WHEN regexp_matches(merchant_key, '^(house|auto).*-1[0-9]$') THEN 'online_shopping' WHEN contains(merchant_key, 'machinery') THEN 'groceries' ELSE 'others' END AS predicted FROM l) SELECT label, predicted, count(*) AS n FROM p GROUP BY ALL", "transactions")
def _(s, d):
    return classify.confusion(classify.predicted_by_rules(frame(s, d, _LABELLED), _builtin(s)))


@query("evaluation_misses", f", l AS ({_LABELLED}), p AS (SELECT merchant_key, label, CASE WHEN regexp_matches(merchant_key, '^(house|auto).*-1[0-9]$') THEN 'online_shopping' WHEN contains(merchant_key, 'machinery') THEN 'groceries' ELSE 'others' END AS predicted FROM l) SELECT merchant_key, label, predicted, count(*) AS n FROM p WHERE label <> predicted GROUP BY ALL", "transactions")
def _(s, d):
    return classify.misclassified(classify.predicted_by_rules(frame(s, d, _LABELLED), _builtin(s))).groupBy("merchant_key", "label", "predicted").agg(F.count("*").alias("n"))


_MAP = "SELECT merchant_key, CASE WHEN min(id) % 2 = 0 THEN 'Old name' END AS merchant_canonical, CAST(1 AS INT) AS category_id, CAST(10 AS INT) AS subcategory_id, CASE min(id) % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'llm' ELSE 'issuer' END AS source, CAST(0.8 AS DOUBLE) AS confidence, min(id) AS hit_count FROM transactions WHERE merchant_key <> '' AND id % 4 < 2 GROUP BY merchant_key"
_OUTCOMES = "SELECT merchant_key, merchant_canonical, category_id, subcategory_id, 'llm' AS source, CAST(0.75 AS DOUBLE) AS confidence, id AS seq FROM transactions WHERE id % 5 > 1 AND category_id IS NOT NULL"


@query("merchant_map_upsert", f", m AS ({_MAP}), o AS (SELECT merchant_key, arg_max(struct_pack(n := merchant_canonical, c := category_id, s := subcategory_id), seq) AS x FROM ({_OUTCOMES}) WHERE trim(merchant_key) <> '' GROUP BY merchant_key) SELECT coalesce(m.merchant_key, o.merchant_key) AS merchant_key, CASE WHEN source = 'user' OR x IS NULL THEN merchant_canonical ELSE coalesce(x.n, merchant_canonical) END AS merchant_canonical, CASE WHEN source = 'user' OR x IS NULL THEN category_id ELSE x.c END AS category_id, CASE WHEN source = 'user' OR x IS NULL THEN subcategory_id ELSE x.s END AS subcategory_id, CASE WHEN source = 'user' OR x IS NULL THEN source ELSE 'llm' END AS source, CASE WHEN source = 'user' OR x IS NULL THEN confidence ELSE 0.75 END AS confidence, coalesce(hit_count, 0) AS hit_count FROM m FULL JOIN o ON m.merchant_key = o.merchant_key", "transactions")
def _(s, d):
    return corrections.upsert_map(frame(s, d, _MAP), frame(s, d, _OUTCOMES))


_FIXES = "SELECT id, CAST(2 AS INT) AS category_id, CAST(21 AS INT) AS subcategory_id, CASE WHEN id % 8 = 0 THEN 'adjustment' END AS kind, id % 6 = 0 AS create_rule FROM transactions WHERE id % 4 = 0"
_STORED = "SELECT id, user_id, merchant_key, merchant_canonical, kind, category_id, subcategory_id, CAST(0.5 AS DOUBLE) AS confidence, 'llm' AS classified_by, needs_review, kind IN ('purchase', 'fee', 'interest') AS is_spend FROM transactions"


@query("user_corrections", f", t AS ({_STORED}) SELECT id, CASE WHEN id % 4 = 0 THEN 2 ELSE category_id END AS category_id, CASE WHEN id % 4 = 0 THEN 21 ELSE subcategory_id END AS subcategory_id, CASE WHEN id % 8 = 0 THEN 'adjustment' ELSE kind END AS kind, CASE WHEN id % 8 = 0 THEN false ELSE is_spend END AS is_spend, CASE WHEN id % 4 = 0 THEN 1.0 ELSE confidence END AS confidence, CASE WHEN id % 4 = 0 THEN 'user' ELSE classified_by END AS classified_by, needs_review AND id % 4 <> 0 AS needs_review FROM t", "transactions")
def _(s, d):
    return corrections.corrected(frame(s, d, _STORED), frame(s, d, _FIXES)).select("id", "category_id", "subcategory_id", "kind", "is_spend", "confidence", "classified_by", "needs_review")


@query("corrected_map", f", m AS ({_MAP}), n AS (SELECT merchant_key, arg_max(struct_pack(n := merchant_canonical), id) AS x FROM transactions WHERE id % 4 = 0 AND trim(merchant_key) <> '' GROUP BY merchant_key) SELECT coalesce(m.merchant_key, n.merchant_key) AS merchant_key, coalesce(x.n, merchant_canonical) AS merchant_canonical, CASE WHEN x IS NULL THEN category_id ELSE 2 END AS category_id, CASE WHEN x IS NULL THEN source ELSE 'user' END AS source, CASE WHEN x IS NULL THEN confidence ELSE 1.0 END AS confidence FROM m FULL JOIN n ON m.merchant_key = n.merchant_key", "transactions")
def _(s, d):
    return corrections.corrected_map(frame(s, d, _MAP), view(s, d, "transactions"), frame(s, d, _FIXES)).select("merchant_key", "merchant_canonical", "category_id", "source", "confidence")


@query("rules_of_corrections", "SELECT user_id, 'exact' AS match_type, merchant_key AS pattern, 2 AS category_id, CASE WHEN id % 8 = 0 THEN 'adjustment' END AS kind_override, 50 AS priority, 'user' AS source FROM transactions WHERE id % 12 = 0 AND trim(merchant_key) <> ''", "transactions")
def _(s, d):
    return corrections.rules_of(view(s, d, "transactions"), frame(s, d, _FIXES)).select("user_id", "match_type", "pattern", "category_id", "kind_override", "priority", "source")


_SUBS = "SELECT *, CASE WHEN id < 20 THEN 1 WHEN id < 30 THEN 2 WHEN id < 40 THEN 3 ELSE 4 END AS category_id FROM subcategories"


@query("subcategory_merge", "SELECT id, CASE WHEN subcategory_id = 20 THEN 3 ELSE category_id END AS category_id, CASE WHEN subcategory_id = 20 THEN 30 ELSE subcategory_id END AS subcategory_id FROM transactions", "transactions")
def _(s, d):
    return corrections.merged_subcategory(view(s, d, "transactions"), frame(s, d, _SUBS), 20, 30).select("id", "category_id", "subcategory_id")


# Subcategories that parts make: a key for each, some pending.
_MADE = "SELECT CAST(p_partkey AS BIGINT) AS id, concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS VARCHAR(9))) AS key, CASE WHEN p_size % 3 = 0 THEN 'pending_approval' ELSE 'active' END AS status, CAST(NULL AS BIGINT) AS merged_into FROM part"


@query("subcategory_states", f"SELECT id, CASE WHEN id = 20 THEN 'merged' WHEN id IN (5, 42, 60) THEN 'active' ELSE status END AS status, CASE WHEN id = 20 THEN 30 ELSE merged_into END AS merged_into FROM ({_MADE})")
def _(s, d):
    return corrections.approved(corrections.marked_merged(frame(s, d, _MADE), 20, 30), [5, 42, 60]).select("id", "status", "merged_into")


_SHOPS = "SELECT CASE o_orderkey % 6 WHEN 0 THEN 'Books' WHEN 1 THEN ' MUSIC' WHEN 2 THEN 'toys' WHEN 3 THEN 'Blue Lamp & Co' WHEN 4 THEN '***' ELSE concat('Shop ', CAST(o_custkey AS VARCHAR(20))) END AS store FROM orders"


@query("dynamic_subcategories", f", k AS (SELECT DISTINCT store, CASE WHEN trim(regexp_replace(lower(store), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'unknown' ELSE trim(regexp_replace(lower(store), '[^a-z0-9]+', '_', 'g'), '_') END AS key FROM ({_SHOPS})) SELECT store, CASE WHEN k.key = 'music' THEN 'books' ELSE k.key END AS key, CASE k.key WHEN 'books' THEN 40 WHEN 'music' THEN 40 WHEN 'toys' THEN 42 END AS subcategory_id, k.key NOT IN ('books', 'music') AS pending FROM k", "subcategories")
def _(s, d):
    return corrections.dynamic_subcategories(frame(s, d, _SHOPS), frame(s, d, _SUBS), 4)


@query("new_subcategories", f", k AS (SELECT trim(store) AS store, CASE WHEN trim(regexp_replace(lower(store), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'unknown' ELSE trim(regexp_replace(lower(store), '[^a-z0-9]+', '_', 'g'), '_') END AS key FROM ({_SHOPS})) SELECT key, min(store) AS label, 'pending_approval' AS status FROM k WHERE key NOT IN ('books', 'music', 'toys') GROUP BY key", "subcategories")
def _(s, d):
    found = corrections.dynamic_subcategories(frame(s, d, _SHOPS), frame(s, d, _SUBS), 4)
    return corrections.new_subcategories(found, 4).select("key", "label", "status")


_WANTED = f"SELECT key, 'active' AS status FROM ({_MADE}) m WHERE id % 2 = 0 UNION ALL SELECT concat('shop_', CAST(s_suppkey AS VARCHAR(9))) AS key, 'pending_approval' AS status FROM supplier"


@query("taxonomy_sync", f"SELECT coalesce(s.key, w.key) AS key, coalesce(w.status, s.status) AS status, s.id FROM ({_MADE}) s FULL JOIN ({_WANTED}) w ON s.key = w.key")
def _(s, d):
    return corrections.synced(frame(s, d, _MADE).select("key", "status", "id"), frame(s, d, _WANTED), ["key"], ["status"])


@query("taxonomy_refusals", "SELECT DISTINCT s.key FROM subcategories s JOIN transactions t ON t.subcategory_id = s.id WHERE s.key NOT IN ('bar', 'market')", "subcategories", "transactions")
def _(s, d):
    subs = view(s, d, "subcategories")
    used = view(s, d, "transactions").select(F.col("subcategory_id").alias("id")).distinct().join(subs, "id").select("key")
    return corrections.dropped_keys(subs, s.createDataFrame([("bar",), ("market",)], "key string"), used)


# Statements of two accounts that overlap in part.
_TWO = """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey % 3 AS statement_id, l_orderkey % 3 % 2 AS account_id, CAST(9 AS BIGINT) AS user_id, CAST(l_shipdate AS DATE) AS posted_date, CAST(l_quantity AS BIGINT) % 5 * 100 AS amount_minor, concat('LINE ', l_linestatus) AS description_raw FROM lineitem"""
_HASH = "sha256(concat_ws('|', account_id, posted_date, amount_minor, description_raw, occ))"


def _two(s, d):
    rows = ledger.hashed(frame(s, d, _TWO).withColumn("ordinal", F.col("id")))
    return rows.select("id", "statement_id", "account_id", "user_id", "posted_date", "amount_minor", "description_raw", "dedupe_hash")


@query("statement_reassigned", f"""WITH t AS ({_TWO}), o AS (SELECT *, row_number() OVER (PARTITION BY statement_id, account_id, posted_date, amount_minor, description_raw ORDER BY id) - 1 AS occ FROM t), h AS (SELECT *, {_HASH} AS h FROM o),
a AS (SELECT * REPLACE (1 AS account_id, 4 AS user_id) FROM o WHERE statement_id = 0), m AS (SELECT *, {_HASH} AS h FROM a)
SELECT id, account_id, user_id, h AS dedupe_hash FROM h WHERE statement_id <> 0 UNION ALL SELECT id, account_id, user_id, h FROM m WHERE h NOT IN (SELECT h FROM h WHERE statement_id <> 0 AND account_id = 1)""")  # fmt: skip
def _(s, d):
    return accounts.moved(_two(s, d), 0, 4, 1).select("id", "account_id", "user_id", "dedupe_hash")


@query("statement_reparsed", f"""WITH t AS ({_TWO}), n AS (SELECT * REPLACE (amount_minor + 100 AS amount_minor) FROM t WHERE statement_id = 1), k AS (SELECT * FROM t WHERE statement_id <> 1 UNION ALL SELECT * FROM n), o AS (SELECT *, row_number() OVER (PARTITION BY statement_id, account_id, posted_date, amount_minor, description_raw ORDER BY id) - 1 AS occ FROM k), h AS (SELECT *, {_HASH} AS h FROM o)
SELECT id, statement_id, h AS dedupe_hash FROM h WHERE statement_id <> 1 OR h NOT IN (SELECT h FROM h WHERE statement_id <> 1 AND account_id = 1)""")  # fmt: skip
def _(s, d):
    rows = _two(s, d)
    again = rows.where("statement_id = 1").withColumns({"amount_minor": F.col("amount_minor") + 100, "ordinal": F.col("id")}).drop("dedupe_hash")
    return accounts.reparsed(rows, 1, again).select("id", "statement_id", "dedupe_hash")


# Reference tables with faults in them: a pair for each part, a rule for each order.
_PAIRS = "SELECT concat(CASE WHEN p_size % 7 = 0 THEN 'Bad ' ELSE '' END, split_part(p_name, ' ', 1)) AS category, concat(split_part(p_name, ' ', 2), '_', CAST(p_partkey % 50 AS VARCHAR(9))) AS subcategory, CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE p_name END AS label FROM part UNION ALL SELECT 'others' AS category, 'uncategorized' AS subcategory, 'Other' AS label FROM region WHERE r_regionkey = 0"
_RULES = """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'contains' WHEN 2 THEN 'regex' WHEN 3 THEN 'prefix' ELSE 'fuzzy' END AS match_type, CASE o_orderkey % 8 WHEN 0 THEN ' ' WHEN 1 THEN concat('(a+)+', CAST(o_orderkey AS VARCHAR(20))) WHEN 2 THEN concat('shop(', CAST(o_orderkey AS VARCHAR(20))) WHEN 3 THEN repeat('x', 201) ELSE concat('Shop ', CAST(o_custkey AS VARCHAR(20))) END AS pattern,
  split_part(p_name, ' ', 1) AS category, concat(split_part(p_name, ' ', 2), '_', CAST(p_partkey % 60 AS VARCHAR(9))) AS subcategory, CAST(o_orderkey % 11 AS INT) - 1 AS priority FROM orders JOIN part ON p_partkey = o_custkey"""
_SOUND_PAIRS = f"SELECT DISTINCT category, subcategory FROM ({_PAIRS}) WHERE regexp_matches(category, '^[a-z][a-z0-9_]*$') AND trim(label) <> ''"


@query("reference_taxonomy", f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY category, subcategory) > 1 AS again FROM ({_PAIRS})) SELECT problem, count(*) AS n FROM (SELECT 'the category is no key' AS problem FROM p WHERE NOT regexp_matches(category, '^[a-z][a-z0-9_]*$') UNION ALL SELECT 'the label is empty' FROM p WHERE trim(label) = '' UNION ALL SELECT 'the pair is there twice' FROM p WHERE again) GROUP BY problem""")
def _(s, d):
    """What is wrong with a taxonomy."""
    return reference.taxonomy(frame(s, d, _PAIRS))[1].groupBy("problem").agg(F.count("*").alias("n"))


@query("reference_rules", f"""WITH k AS ({_SOUND_PAIRS}), r AS (SELECT *, row_number() OVER (PARTITION BY match_type, lower(pattern) ORDER BY priority, id) > 1 AS again, EXISTS (FROM k WHERE k.category = t.category AND k.subcategory = t.subcategory) AS known FROM ({_RULES}) t)
SELECT id, problem FROM (SELECT id, 'the kind of match is unknown' AS problem FROM r WHERE match_type = 'fuzzy' UNION ALL SELECT id, 'the pattern is empty' FROM r WHERE trim(pattern) = '' UNION ALL SELECT id, 'the pattern is too long' FROM r WHERE len(pattern) > 200
  UNION ALL SELECT id, 'the expression is not sound' FROM r WHERE match_type = 'regex' AND id % 8 IN (1, 2) UNION ALL SELECT id, 'the taxonomy lacks the pair' FROM r WHERE NOT known UNION ALL SELECT id, 'the priority is no number of 0 or more' FROM r WHERE priority < 0 UNION ALL SELECT id, 'another rule has the pattern' FROM r WHERE again)""")  # fmt: skip
def _(s, d):
    """What is wrong with rules, given the sound pairs of a taxonomy."""
    pairs = frame(s, d, _PAIRS)
    sound = pairs.where(F.col("category").rlike(reference.KEY) & (F.trim("label") != ""))
    return reference.rules(frame(s, d, _RULES), sound)[1]
