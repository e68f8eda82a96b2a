"""Net worth: monthly balances with carry-forward, totals, and the change to the month before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthledger.functions.periods import month_label, month_number

MAX_MONTHS = 1200
LIABILITIES = ("credit_card",)
CATEGORIES = ("checking", "savings", "investment", "credit_card")
ACCOUNT = ["user_id", "category", "account_name"]


def monthly(entries: DataFrame, currency: str = "USD", max_months: int = MAX_MONTHS) -> DataFrame:
    """A row for each account and month from its first entry to the last month of all.

    An account gets its own calendar by explode, so the only shuffle is by account; months before its
    first entry are not made up.
    """
    rows = entries.where(F.col("currency") == currency).withColumn("m", month_number())
    # One row of two numbers.
    span = rows.agg(F.max("m").alias("last"), F.greatest(F.min("m"), F.max("m") - max_months + 1).alias("first"))
    known = rows.groupBy(*ACCOUNT, "m").agg(F.max("balance_minor").alias("balance_minor"))
    ahead = F.lead("m").over(Window.partitionBy(*ACCOUNT).orderBy("m"))
    until = known.withColumn("_next", ahead).join(F.broadcast(span))
    until = until.withColumn("_to", F.coalesce(F.col("_next") - 1, F.col("last")))
    until = until.where(F.col("_to") >= F.col("first"))
    each = until.withColumn("month_number", F.explode(F.sequence(F.greatest("m", "first"), F.col("_to"))))
    return each.select(*ACCOUNT, "month_number", "balance_minor", (F.col("month_number") != F.col("m")).alias("carried"))


def totals(monthly_rows: DataFrame) -> DataFrame:
    """A row for each month: each category, assets, liabilities and net."""
    part = [F.sum(F.when(F.col("category") == c, F.col("balance_minor")).otherwise(0)).alias(f"{c}_minor") for c in CATEGORIES]
    sums = monthly_rows.groupBy("month_number").agg(*part)
    assets = sum((F.col(f"{c}_minor") for c in CATEGORIES if c not in LIABILITIES), F.lit(0))
    owed = sum((F.col(f"{c}_minor") for c in LIABILITIES), F.lit(0))
    out = sums.withColumn("assets_minor", assets).withColumn("liabilities_minor", owed)
    return out.withColumn("net_minor", F.col("assets_minor") - F.col("liabilities_minor")).withColumn("period", month_label("month_number"))


def with_change(month_totals: DataFrame) -> DataFrame:
    """The change of net worth to the month before; null for the first. One row a month, so one window is small."""
    return month_totals.withColumn("change_minor", F.col("net_minor") - F.lag("net_minor").over(Window.orderBy("month_number")))


def snapshot(entries: DataFrame, year: int, month: int, currency: str = "USD") -> DataFrame:
    """Each account's latest balance at or before the month."""
    at = year * 12 + month - 1
    rows = entries.where(F.col("currency") == currency).withColumn("m", month_number()).where(F.col("m") <= at)
    out = rows.groupBy(*ACCOUNT).agg(F.max_by("balance_minor", "m").alias("balance_minor"), F.max("m").alias("_m"))
    return out.select(*ACCOUNT, "balance_minor", month_label("_m").alias("as_of"), (F.col("_m") < at).alias("carried"))
