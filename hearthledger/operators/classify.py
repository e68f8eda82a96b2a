"""Classification: a cascade of rules and lookups over distinct merchant keys, a step for a model in batches, and its evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthledger.functions.names import label
from hearthledger.functions.text import is_spend
from hearthledger.sources.tables import kept

REVIEW_BELOW = 0.7
#: The parser's own score from which a statement of a known issuer needs no confirming.
SURE_SCORE = 0.8
#: Rules in one expression; more make further columns.
RULES_AT_ONCE = 200
#: Descriptions in a request to a model, and in the second one for what the first left out.
BATCH, RETRY = 50, 10

# Labels of issuers that leave no doubt, with category and subcategory.
ISSUER_LABELS = {
    "DINING": ("restaurant", "dine_in"),
    "RESTAURANTS": ("restaurant", "dine_in"),
    "GROCERIES": ("grocery", "grocery_stores"),
    "SUPERMARKETS": ("grocery", "grocery_stores"),
    "GASOLINE": ("fuel", "gasoline"),
    "GAS STATIONS": ("fuel", "gasoline"),
    "HOME IMPROVEMENT": ("maintenance", "home_improvement"),
    "AUTOMOTIVE": ("maintenance", "auto_repair"),
    "AIRFARE": ("travel", "flights"),
    "AIRLINES": ("travel", "flights"),
    "HOTELS": ("travel", "hotels"),
    "LODGING": ("travel", "hotels"),
    "RENTAL CARS": ("travel", "rental_cars"),
    "INTERNET": ("utilities", "internet"),
    "PHONE": ("utilities", "phone"),
    "ELECTRICITY": ("utilities", "electricity"),
    "MOVIES": ("entertainment", "movies_theater"),
    "ATM WITHDRAWAL": ("cash", "atm_withdrawal"),
    "CASH ADVANCE": ("cash", "cash_advance"),
}


def with_columns(df: DataFrame, **types: str) -> DataFrame:
    """df with columns that it lacks, as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def first_rule(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(merchant_key, user_id, rule_id, category, subcategory, kind_override): the first match by priority, then id.

    Rules meet distinct keys of users, never transactions. Users write rules by hand; they are read once here. exact ones are an
    equi-join; contains and regex become literal tests in order, of which the first that fits ends the search. A rule with a user holds for
    that user only. keys without user_id have rules for all.
    """
    keys = with_columns(keys, user_id="bigint")
    rules = with_columns(rules, user_id="bigint", kind_override="string")
    columns = ["id", "user_id", "match_type", "pattern", "category", "subcategory", "kind_override"]
    found = rules.where("enabled").orderBy("priority", "id").select(*columns).collect()
    distinct = keys.select("merchant_key", F.col("user_id").cast("bigint").alias("user_id")).where(F.trim("merchant_key") != "").distinct()
    numbered = [(i, *r) for i, r in enumerate(found)]
    types = dict(rules.select(*columns).dtypes)
    table = keys.sparkSession.createDataFrame(numbered, "_at int, " + ", ".join(f"{c} {types[c]}" for c in columns))
    exact = table.where("match_type = 'exact'").select(F.lower("pattern").alias("_low"), F.col("user_id").alias("_owner"), "_at")
    exact = exact.groupBy("_low", "_owner").agg(F.min("_at").alias("_exact"))
    low = distinct.withColumn("_low", F.lower("merchant_key"))
    own = exact.where("_owner is not null").select("_low", F.col("_owner").alias("user_id"), F.col("_exact").alias("_own"))
    low = low.join(exact.where("_owner is null").drop("_owner"), "_low", "left").join(own, ["_low", "user_id"], "left")

    def fits(r) -> Column:
        hit = F.contains(F.col("_low"), F.lit(r["pattern"].lower())) if r["match_type"] == "contains" else F.col("merchant_key").rlike("(?iu)" + r["pattern"])
        return hit if r["user_id"] is None else hit & (F.col("user_id") == r["user_id"])

    tests = [(i, r) for i, r in enumerate(found) if r["match_type"] in ("contains", "regex")]
    blocks = [tests[k : k + RULES_AT_ONCE] for k in range(0, len(tests), RULES_AT_ONCE)]
    names = [f"_tests{k}" for k in range(len(blocks))]
    for name, block in zip(names, blocks):
        low = low.withColumn(name, reduce(lambda case, t: case.when(fits(t[1]), t[0]), block[1:], F.when(fits(block[0][1]), block[0][0])))
    first = F.least(F.col("_exact"), F.col("_own"), F.coalesce(*[F.col(n) for n in names]) if names else F.lit(None).cast("int"))
    hits = low.withColumn("_at", first).where("_at is not null")
    return hits.join(F.broadcast(table.select("_at", F.col("id").alias("rule_id"), "category", "subcategory", "kind_override")), "_at").select(
        "merchant_key", "user_id", "rule_id", "category", "subcategory", "kind_override"
    )


def issuer_labels(spark, labels: dict[str, tuple[str, str]] = ISSUER_LABELS, parser_id: str = "*") -> DataFrame:
    """(parser_id, label, category, subcategory), labels as they are looked up."""
    return spark.createDataFrame([(parser_id, " ".join(k.split()).lower(), *v) for k, v in sorted(labels.items())], "parser_id string, label string, category string, subcategory string")


def issuer_category(txns: DataFrame, labels: DataFrame) -> DataFrame:
    """txns with `_issuer` (category, subcategory): that of the parser's own label, else of the label for all parsers (`*`)."""
    known = labels.groupBy("parser_id", "label").agg(F.min(F.struct("category", "subcategory")).alias("_pair"))
    own = known.where("parser_id <> '*'").select("parser_id", F.col("label").alias("_label"), F.col("_pair").alias("_own"))
    any_ = known.where("parser_id = '*'").select(F.col("label").alias("_label"), F.col("_pair").alias("_any"))
    rows = txns.withColumn("_label", label(F.col("issuer_category")))
    rows = rows.join(own, ["parser_id", "_label"], "left").join(any_, "_label", "left")
    return rows.withColumn("_issuer", F.coalesce("_own", "_any")).drop("_label", "_own", "_any")


def cascade(txns: DataFrame, user_rules: DataFrame, merchant_map: DataFrame, builtin_rules: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """txns with category, subcategory, confidence, classified_by, needs_review, kind and is_spend.

    The first that knows decides: kind, user rule, user correction, built-in rule, issuer's label, cache, fallback. A rule may set the
    kind. A repeated key of the map counts once.
    """
    keyed = lambda rules, name: first_rule(txns, rules).select(F.col("merchant_key").alias("_key"), F.col("user_id").alias("_owner"), F.struct("category", "subcategory", "kind_override").alias(name))
    pair = lambda name: F.min(F.struct("category", "subcategory", "confidence")).alias(name)
    mine = merchant_map.where("source = 'user'").groupBy("merchant_key").agg(pair("_mine"))
    cached = merchant_map.where("source in ('llm', 'issuer')").groupBy("merchant_key").agg(pair("_cached"))
    out = with_columns(txns, user_id="bigint", issuer_category="string", parser_id="string")
    for rules, name in ((user_rules, "_user"), (builtin_rules, "_built")):
        same = (F.col("merchant_key") == F.col("_key")) & F.col("user_id").eqNullSafe(F.col("_owner"))
        out = out.join(keyed(rules, name), same, "left").drop("_key", "_owner")
    out = out.join(mine, "merchant_key", "left").join(cached, "merchant_key", "left")
    out = issuer_category(out, issuer_labels(txns.sparkSession) if labels is None else labels)

    def step(when: Column, category: Column, sub: Column, confidence: Column, by: str, kind: Column | None = None) -> Column:
        return F.when(when, F.struct(
            category.alias("category"), sub.alias("subcategory"), confidence.cast("double").alias("confidence"), F.lit(by).alias("classified_by"),
            (F.lit(None).cast("string") if kind is None else kind).alias("_kind"),
        ))

    def known(name: str, by: str, confidence: Column, keyed: bool = True, kind: Column | None = None) -> Column:
        has = F.col(name).isNotNull() & ((F.trim("merchant_key") != "") if keyed else F.lit(True))
        return step(has, F.col(f"{name}.category"), F.col(f"{name}.subcategory"), confidence, by, kind)

    one = F.lit(1.0)
    steps = [
        step(F.col("kind").isin("payment", "transfer"), F.lit("others"), F.lit("payments_transfers"), one, "kind"),
        known("_user", "user_rule", one, kind=F.col("_user.kind_override")), known("_mine", "user", F.col("_mine.confidence")),
        known("_built", "builtin_rule", one, kind=F.col("_built.kind_override")), known("_issuer", "issuer", F.lit(0.9), keyed=False),
        known("_cached", "cache", F.col("_cached.confidence")), step(F.lit(True), F.lit("others"), F.lit("uncategorized"), F.lit(0.0), "llm"),
    ]
    made = ["category", "subcategory", "confidence", "classified_by"]
    rest = [c for c in txns.columns if c not in (*made, "needs_review", "kind", "is_spend")]
    out = out.withColumn("_out", F.coalesce(*steps)).withColumn("_kind", F.coalesce("_out._kind", "kind"))
    return out.select(
        *rest, F.col("_kind").alias("kind"), is_spend(F.col("_kind")).alias("is_spend"), *[F.col(f"_out.{c}") for c in made], (F.col("_out.confidence") < REVIEW_BELOW).alias("needs_review")
    )


def audit(classified: DataFrame) -> DataFrame:
    """The rows of the audit log that a run adds."""
    return classified.select(F.col("id").alias("transaction_id"), F.col("category").alias("category_key"), F.col("subcategory").alias("subcategory_key"), "confidence", F.col("classified_by").alias("method"))


def with_hits(merchant_map: DataFrame, classified: DataFrame) -> DataFrame:
    """The map with hit_count raised by the transactions that it has decided."""
    hits = classified.where("classified_by in ('user', 'cache')").groupBy("merchant_key").agg(F.count("*").alias("_hits"))
    return merchant_map.join(hits, "merchant_key", "left").withColumn("hit_count", F.coalesce("hit_count", F.lit(0)) + F.coalesce("_hits", F.lit(0))).drop("_hits")


def counters(classified: DataFrame) -> DataFrame:
    """One row of a run's counts."""
    of = lambda by: F.count(F.when(F.col("classified_by") == by, 1)).alias(f"by_{by}")
    return classified.agg(
        F.count("*").alias("total"), F.count(F.when(F.col("classified_by") != "llm", 1)).alias("classified"), F.count(F.when(F.col("needs_review"), 1)).alias("needs_review"),
        *[of(b) for b in ("kind", "user_rule", "user", "builtin_rule", "issuer", "cache", "llm")],
    )


def sure(score: Column, issuer: Column) -> Column:
    """Whether a statement can be stored without asking: its issuer is known and the parser is sure."""
    return issuer.isNotNull() & (score >= SURE_SCORE)


def representatives(txns: DataFrame) -> DataFrame:
    """(merchant_key, description): the commonest description, the shortest and then the first of equals."""
    counts = txns.where(F.trim("merchant_key") != "").groupBy("merchant_key", "description_clean").count()
    best = F.min_by("description_clean", F.struct(-F.col("count"), F.length("description_clean"), F.col("description_clean")))
    return counts.groupBy("merchant_key").agg(best.alias("description"))


def in_batches(wanted: DataFrame, size: int = BATCH) -> DataFrame:
    """wanted with `batch` and `row` (from 1 in a batch), by merchant key.

    Rows are sorted across partitions and numbered by the counts of the partitions before, so no task sees them all. What stands where is written before it is counted: numbers stay if a task runs again.
    """
    placed = wanted.repartitionByRange("merchant_key").sortWithinPartitions("merchant_key").withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id() % (1 << 33))
    placed = kept(placed, "batches")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    number = F.col("_from") + F.col("_nth")
    return placed.join(F.broadcast(starts), "_part").select(*wanted.columns, F.floor(number / size).alias("batch"), (number % size + 1).cast("int").alias("row"))


Answer = Callable[[list[str]], list[dict]]


def ask(wanted: DataFrame, model: Answer | None = None, size: int = BATCH, retry: int = RETRY) -> DataFrame:
    """(merchant_key, category, subcategory, merchant_canonical, confidence, needs_review) of rows (merchant_key, description).

    model gets the descriptions of a batch and answers with rows {id (from 1), category, subcategory, merchant_canonical, confidence}; a row
    whose id is unknown or answered twice does not count. What is missing is asked for once more, `retry` at a time; what is then still
    missing, or of a batch that failed, is others / uncategorized and to be reviewed. Without a model everything is. Answers are written, so that reading the result again does not ask again.
    """

    def answered(texts: list[str]) -> dict[int, dict]:
        try:
            rows = model(texts) if model else []
        except Exception:  # noqa: BLE001 - a failed request leaves its rows to the fallback
            return {}
        good = [r for r in rows if isinstance(r, dict) and r.get("id") in range(1, len(texts) + 1) and {"category", "subcategory", "confidence"} <= set(r)]
        ids = [r["id"] for r in good]
        return {r["id"] - 1: r for r in good if ids.count(r["id"]) == 1}

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            keys, texts = list(pdf["merchant_key"]), list(pdf["description"])
            for at in range(0, len(texts), size):
                chunk = texts[at : at + size]
                got = answered(chunk)
                left = [i for i in range(len(chunk)) if i not in got]
                for k in range(0, len(left) if got else 0, retry):
                    some = left[k : k + retry]
                    got |= {some[i]: r for i, r in answered([chunk[i] for i in some]).items()}
                rows = [(got[i]["category"], got[i]["subcategory"], got[i].get("merchant_canonical") or None, float(got[i]["confidence"]), False) if i in got else ("others", "uncategorized", None, 0.0, True) for i in range(len(chunk))]
                yield pd.DataFrame([(keys[at + i], *r) for i, r in enumerate(rows)], columns=["merchant_key", "category", "subcategory", "merchant_canonical", "confidence", "needs_review"])

    out = wanted.select("merchant_key", "description").mapInPandas(batches, "merchant_key string, category string, subcategory string, merchant_canonical string, confidence double, needs_review boolean")
    if model:
        out = kept(out, "model-answers")
    return out.withColumn("needs_review", F.col("needs_review") | (F.col("confidence") < REVIEW_BELOW))


def accuracy(labelled: DataFrame, by: str = "label") -> DataFrame:
    """(label, total, correct) of rows (label, predicted)."""
    return labelled.groupBy(by).agg(F.count("*").alias("total"), F.sum((F.col("label") == F.col("predicted")).cast("long")).alias("correct"))


def confusion(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def misclassified(labelled: DataFrame) -> DataFrame:
    return labelled.where(~F.col("label").eqNullSafe(F.col("predicted")))


def predicted_by_rules(labelled: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (merchant_key, label) with the category of the first rule that fits, else `others`."""
    found = first_rule(labelled, rules).select("merchant_key", F.col("category").alias("predicted"))
    return labelled.join(found, "merchant_key", "left").withColumn("predicted", F.coalesce("predicted", F.lit("others")))
