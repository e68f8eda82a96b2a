"""What users and runs change: the merchant map, corrections, subcategories, taxonomy. Tables are immutable: each returns the new one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthledger.functions.names import humanized, slug
from hearthledger.functions.text import is_spend

#: Priority of a rule that a correction makes: before rules of 100.
RULE_PRIORITY = 50


def upsert_map(merchant_map: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The map after a run's outcomes (merchant_key, merchant_canonical, category_id, subcategory_id, source, confidence).

    What a user has set stays; blank keys are not stored; a name that an outcome lacks is kept. Of several outcomes of one key the last by
    `at` counts.
    """
    values = ["merchant_canonical", "category_id", "subcategory_id", "source", "confidence"]
    new = outcomes.where(F.trim("merchant_key") != "").groupBy("merchant_key").agg(F.max_by(F.struct(*values), "seq").alias("_new"))
    both = merchant_map.join(new, "merchant_key", "full_outer")
    keep = F.col("source").eqNullSafe("user") | F.col("_new").isNull()
    pick = lambda c: F.when(keep, F.col(c)).otherwise(F.col(f"_new.{c}")).alias(c)
    name = F.when(keep, F.col("merchant_canonical")).otherwise(F.coalesce("_new.merchant_canonical", "merchant_canonical")).alias("merchant_canonical")
    return both.select("merchant_key", name, *[pick(c) for c in values[1:]], F.coalesce("hit_count", F.lit(0)).alias("hit_count"))


def corrected(txns: DataFrame, corrections: DataFrame) -> DataFrame:
    """txns after corrections (id, category_id, subcategory_id, kind): sure, by the user, not to be reviewed; a null kind leaves the kind."""
    fix = corrections.groupBy("id").agg(F.max(F.struct("category_id", "subcategory_id", "kind")).alias("_fix"))
    both = txns.join(fix, "id", "left")
    mine = F.col("_fix").isNotNull()
    kind = F.coalesce("_fix.kind", "kind")
    made = {
        "category_id": F.when(mine, F.col("_fix.category_id")).otherwise(F.col("category_id")), "subcategory_id": F.when(mine, F.col("_fix.subcategory_id")).otherwise(F.col("subcategory_id")),
        "kind": kind, "is_spend": is_spend(kind), "confidence": F.when(mine, 1.0).otherwise(F.col("confidence")),
        "classified_by": F.when(mine, "user").otherwise(F.col("classified_by")), "needs_review": F.when(mine, False).otherwise(F.col("needs_review")),
    }
    return both.withColumns(made).drop("_fix")


def corrected_map(merchant_map: DataFrame, txns: DataFrame, corrections: DataFrame) -> DataFrame:
    """The map after corrections: a corrected key is the user's, with confidence 1; its name is the transaction's, if that has one."""
    keys = txns.select("id", "merchant_key", F.col("merchant_canonical").alias("_name")).where(F.trim("merchant_key") != "")
    new = corrections.select("id", F.col("category_id").alias("_c"), F.col("subcategory_id").alias("_s")).join(keys, "id")
    new = new.groupBy("merchant_key").agg(F.max(F.struct("id", "_name", "_c", "_s")).alias("_new"))
    both = merchant_map.join(new, "merchant_key", "full_outer")
    has = F.col("_new").isNotNull()
    return both.select(
        "merchant_key", F.coalesce("_new._name", "merchant_canonical").alias("merchant_canonical"), F.coalesce("_new._c", "category_id").alias("category_id"),
        F.coalesce("_new._s", "subcategory_id").alias("subcategory_id"), F.when(has, "user").otherwise(F.col("source")).alias("source"),
        F.when(has, 1.0).otherwise(F.col("confidence")).alias("confidence"), F.coalesce("hit_count", F.lit(0)).alias("hit_count"),
    )


def rules_of(txns: DataFrame, corrections: DataFrame) -> DataFrame:
    """The exact rules that corrections with create_rule add, for the transaction's user."""
    wanted = corrections.where("create_rule").select("id", "category_id", "subcategory_id", F.col("kind").alias("kind_override"))
    rows = wanted.join(txns.select("id", "user_id", "merchant_key").where(F.trim("merchant_key") != ""), "id")
    return rows.select("user_id", F.lit("exact").alias("match_type"), F.col("merchant_key").alias("pattern"), "category_id", "subcategory_id", "kind_override", F.lit(RULE_PRIORITY).alias("priority"), F.lit(True).alias("enabled"), F.lit("user").alias("source"))


def approved(subcategories: DataFrame, ids: list[int]) -> DataFrame:
    return subcategories.withColumn("status", F.when(F.col("id").isin(ids), "active").otherwise(F.col("status")))


def merged_subcategory(rows: DataFrame, subcategories: DataFrame, source_id: int, into_id: int) -> DataFrame:
    """rows (transactions or map) of one subcategory moved to another and its category."""
    target = subcategories.where((F.col("id") == into_id) & (F.col("status") != "merged")).select("id", "category_id").head()
    if target is None:
        raise ValueError(f"subcategory {into_id} is missing or merged itself")
    here = F.col("subcategory_id") == source_id
    return rows.withColumns({"category_id": F.when(here, target["category_id"]).otherwise(F.col("category_id")), "subcategory_id": F.when(here, into_id).otherwise(F.col("subcategory_id"))})


def marked_merged(subcategories: DataFrame, source_id: int, into_id: int) -> DataFrame:
    here = F.col("id") == source_id
    return subcategories.withColumns({"status": F.when(here, "merged").otherwise(F.col("status")), "merged_into": F.when(here, into_id).otherwise(F.col("merged_into"))})


def dynamic_subcategories(stores: DataFrame, subcategories: DataFrame, category_id: int) -> DataFrame:
    """(store, key, subcategory_id, pending): the subcategory of each store's name in a category that grows by itself.

    An active one is used, a merged one followed; one that is new has no id yet and, like one still pending, is to be reviewed.
    """
    keyed = stores.select("store").distinct().withColumn("key", slug(F.trim("store")))
    own = subcategories.where(F.col("category_id") == category_id).select("key", "id", "status", "merged_into")
    target = subcategories.select(F.col("id").alias("merged_into"), F.col("key").alias("_key"), F.col("status").alias("_status"))
    found = keyed.join(own, "key", "left").join(target, "merged_into", "left")
    follow = (F.col("status") == "merged") & F.col("_key").isNotNull()
    status = F.when(follow, F.col("_status")).otherwise(F.coalesce("status", F.lit("pending_approval")))
    return found.select("store", F.when(follow, F.col("_key")).otherwise(F.col("key")).alias("key"), F.when(follow, F.col("merged_into")).otherwise(F.col("id")).alias("subcategory_id"), (status == "pending_approval").alias("pending"))


def new_subcategories(resolved: DataFrame, category_id: int) -> DataFrame:
    """Rows to add for stores whose subcategory is new; its label is the store's name, else the key in words."""
    rows = resolved.where("subcategory_id is null").groupBy("key").agg(F.min(F.trim("store")).alias("_name"))
    name = F.when(F.col("_name") != "", F.col("_name")).otherwise(humanized(F.col("key")))
    return rows.select(F.lit(category_id).alias("category_id"), "key", name.alias("label"), F.lit(True).alias("is_dynamic"), F.lit("pending_approval").alias("status"))


def synced(stored: DataFrame, wanted: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """stored with the rows of `wanted` added or their values set; nothing is removed."""
    new = wanted.select(*key, F.struct(*values).alias("_new"))
    both = stored.join(new, key, "full_outer")
    set_ = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in values]
    return both.select(*key, *set_, *[c for c in stored.columns if c not in (*key, *values)])


def dropped_keys(stored: DataFrame, wanted: DataFrame, used: DataFrame, key: str = "key") -> DataFrame:
    """Keys that the taxonomy no longer has but rows still use: a sync must refuse these."""
    return stored.select(key).join(wanted.select(key), key, "left_anti").join(used.select(key), key, "left_semi").distinct()


def unknown_pairs(rows: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Labelled rows whose (category, subcategory) the taxonomy does not have: a file with any is an error."""
    return rows.join(taxonomy.select("category", "subcategory").distinct(), ["category", "subcategory"], "left_anti")
