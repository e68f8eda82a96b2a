"""Balance entries: upsert, lists, suggestions, series of accounts, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthledger.functions.names import account_name
from hearthledger.operators.networth import CATEGORIES, LIABILITIES

ENTRY = ["user_id", "category", "year", "month"]


def upserted(entries: DataFrame, incoming: DataFrame) -> DataFrame:
    """entries after incoming rows: one of a month and account (whose name is compared without case) sets balance, currency and note, and the first spelling stays.

    Of several incoming rows of one entry the last by `seq` sets, the first spells. Blank names are refused before.
    """
    low = F.lower("account_name")
    new = incoming.withColumn("account_name", account_name(F.col("account_name"))).where("account_name is not null")
    values = F.struct("balance_minor", "currency", "note")
    new = new.groupBy(*ENTRY, low.alias("_low")).agg(F.min_by("account_name", "seq").alias("_name"), F.max_by(values, "seq").alias("_new"))
    both = entries.withColumn("_low", low).join(new, [*ENTRY, "_low"], "full_outer")
    set_ = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in ("balance_minor", "currency", "note")]
    return both.select(*ENTRY, F.coalesce("account_name", "_name").alias("account_name"), *set_)


def patched(entries: DataFrame, patches: DataFrame) -> DataFrame:
    """entries after patches (id, balance_minor, note, set_note): a null balance leaves the balance, and a note is set only where said."""
    fix = patches.groupBy("id").agg(F.max(F.struct("balance_minor", "note", "set_note")).alias("_fix"))
    both = entries.join(fix, "id", "left")
    note = F.when(F.coalesce("_fix.set_note", F.lit(False)), F.col("_fix.note")).otherwise(F.col("note"))
    return both.withColumns({"balance_minor": F.coalesce("_fix.balance_minor", "balance_minor"), "note": note}).drop("_fix")


def deleted(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids.select("id"), "id", "left_anti")


def listed(entries: DataFrame, name: str | None = None, user_id: int | None = None, category: str | None = None, year: int | None = None) -> DataFrame:
    """The latest months first, then by category and account; names are compared without case and outer or doubled blanks."""
    out = entries
    for column, value in (("user_id", user_id), ("category", category), ("year", year)):
        out = out if value is None else out.where(F.col(column) == value)
    if name is not None:
        out = out.where(F.lower("account_name") == " ".join(name.split()).lower())
    return out.orderBy(F.desc("year"), F.desc("month"), "category", "account_name")


def suggestions(entries: DataFrame) -> DataFrame:
    """(category, account_name, place): each account once, in its latest spelling, the latest first."""
    key = F.lower(F.trim("account_name"))
    when = F.struct("year", "month", F.col("account_name").alias("_tie"))
    latest = entries.where(key != "").groupBy("category", key.alias("_key")).agg(F.max_by("account_name", when).alias("account_name"), F.max(when).alias("_when"))
    order = Window.partitionBy("category").orderBy(F.desc("_when"), "_key")
    return latest.withColumn("place", F.row_number().over(order)).select("category", "account_name", "place")


def account_series(monthly: DataFrame) -> DataFrame:
    """monthly rows in the order of charts: category as declared, user, account, month."""
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    return monthly.orderBy(place, "user_id", "account_name", "month_number")


def shares(snapshot: DataFrame) -> DataFrame:
    """(category, balance_minor, percent): categories of assets with a positive sum, and their part of the sum of these."""
    sums = snapshot.where(~F.col("category").isin(*LIABILITIES)).groupBy("category").agg(F.sum("balance_minor").alias("balance_minor")).where("balance_minor > 0")
    all_ = F.sum("balance_minor").over(Window.partitionBy())  # four rows at most
    return sums.withColumn("percent", F.col("balance_minor") / all_ * 100)


def input_minor(raw: Column) -> Column:
    """What a user types as a balance, halves of a cent up by the third decimal alone; null if empty, negative or no number."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^\$", ""), ",", "")
    whole = F.coalesce(F.regexp_extract(bare, r"^(\d*)", 1).try_cast("bigint"), F.lit(0))
    digits = F.rpad(F.substring(F.regexp_extract(bare, r"\.(\d*)$", 1), 1, 3), 3, "0").cast("int")
    minor = whole * 100 + F.floor((digits + 5) / 10).cast("bigint")
    return F.when(bare.rlike(r"^\d*\.?\d+$|^\d+\.$"), minor)
