"""Spending: sums, counts and integer averages by any of six keys, with filters; lists and top merchants."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthledger.functions.periods import period
from hearthledger.functions.text import contains_literal

KINDS = ("purchase", "refund", "payment", "transfer", "fee", "interest", "adjustment")
SPEND_KINDS = ("purchase", "fee", "interest")
GRAINS = ("day", "week", "month", "quarter", "year", "all")
KEYS = ("period", "category", "subcategory", "user", "account", "merchant")


@dataclass(frozen=True)
class SpendQuery:
    """None filters nothing; an empty sequence matches nothing."""

    group_by: Sequence[str] = ("period", "category")
    grain: str = "month"
    currency: str = "USD"
    user_ids: Sequence[int] | None = None
    account_ids: Sequence[int] | None = None
    start: date | None = None
    end: date | None = None
    categories: Sequence[str] | None = None
    subcategories: Sequence[str] | None = None
    min_amount: int | None = None
    max_amount: int | None = None
    search: str | None = None
    kinds: Sequence[str] | None = None
    include_non_spend: bool = False
    net_refunds: bool = True

    def __post_init__(self):
        if self.grain not in GRAINS:
            raise ValueError(f"grain must be one of {GRAINS}")
        if bad := [k for k in self.group_by if k not in KEYS]:
            raise ValueError(f"unknown group keys {bad}")
        if bad := [k for k in self.kinds or () if k not in KINDS]:
            raise ValueError(f"unknown kinds {bad}")

    def wanted_kinds(self) -> Sequence[str] | None:
        if self.kinds is not None:
            return self.kinds
        if self.include_non_spend:
            return None
        return (*SPEND_KINDS, "refund") if self.net_refunds else SPEND_KINDS


def _among(col: Column, values: Sequence | None) -> Column:
    if values is None:
        return F.lit(True)
    return col.isin(list(values)) if len(values) else F.lit(False)


def _resolved(subcategories: DataFrame) -> DataFrame:
    """(subcategory_id, subcategory): a merged one is its target, one level, null if the target is missing."""
    target = subcategories.select(F.col("id").alias("_target"), F.col("key").alias("_target_key"))
    both = subcategories.join(target, subcategories["merged_into"] == target["_target"], "left")
    key = F.when(F.col("status") == "merged", F.col("_target_key")).otherwise(F.col("key"))
    return both.select(F.col("id").alias("subcategory_id"), key.alias("subcategory"))


def selected(txns: DataFrame, q: SpendQuery) -> DataFrame:
    """The filters that need no other table; they reach the scan."""
    out = txns.where(F.col("currency") == q.currency)
    out = out.where(_among(F.col("user_id"), q.user_ids)).where(_among(F.col("account_id"), q.account_ids))
    if q.start is not None:
        out = out.where(F.col("posted_date") >= F.lit(q.start))
    if q.end is not None:
        out = out.where(F.col("posted_date") <= F.lit(q.end))
    if q.min_amount is not None:
        out = out.where(F.col("amount_minor") >= q.min_amount)
    if q.max_amount is not None:
        out = out.where(F.col("amount_minor") <= q.max_amount)
    if q.search is not None:
        out = out.where(contains_literal("description_clean", q.search))
    return out.where(_among(F.col("kind"), q.wanted_kinds()))


def spend(txns: DataFrame, categories: DataFrame, subcategories: DataFrame, q: SpendQuery = SpendQuery()) -> DataFrame:
    """One row for each group: its keys in the order asked for, currency, total, count and average.

    The two reference tables are joined only where grouped or filtered by; they have a row for each category of
    the taxonomy, so Spark's own size estimate lets it broadcast them. The average truncates toward zero.
    """
    rows = selected(txns, q)
    if "category" in q.group_by or q.categories is not None:
        names = categories.select(F.col("id").alias("category_id"), F.col("key").alias("category"))
        rows = rows.join(names, "category_id", "left")
        if q.categories is not None:
            rows = rows.where(_among(F.col("category"), q.categories))
    if "subcategory" in q.group_by or q.subcategories is not None:
        rows = rows.join(_resolved(subcategories), "subcategory_id", "left")
        if q.subcategories is not None:
            rows = rows.where(_among(F.col("subcategory"), q.subcategories))
    columns = {
        "period": period("posted_date", q.grain), "category": F.col("category") if "category" in rows.columns else None,
        "subcategory": F.col("subcategory") if "subcategory" in rows.columns else None,
        "user": F.col("user_id"), "account": F.col("account_id"), "merchant": F.col("merchant_key"),
    }
    keys = [columns[k].alias(k) for k in q.group_by]
    sums = rows.groupBy(*keys, "currency").agg(F.sum("amount_minor").alias("total_minor"), F.count("id").alias("txn_count"))
    return sums.withColumn("avg_minor", F.expr("total_minor div txn_count"))


def merchant_names(txns: DataFrame) -> DataFrame:
    """(merchant_key, display_name): the commonest canonical name, else the commonest description.

    Ties: canonical names by text; descriptions by length, then text.
    """

    def commonest(col: str, order: list) -> DataFrame:
        counts = txns.where(F.trim(col) != "").groupBy("merchant_key", F.col(col).alias("name")).count()
        # (key, name) counts are few for a key next to its rows; max over a struct needs no sort of the group
        return counts.groupBy("merchant_key").agg(F.min_by("name", F.struct(-F.col("count"), *order)).alias(col))

    canonical = commonest("merchant_canonical", [F.col("name")])
    described = commonest("description_clean", [F.length("name"), F.col("name")])
    both = described.join(canonical, "merchant_key", "full_outer")
    return both.select("merchant_key", F.coalesce("merchant_canonical", "description_clean").alias("display_name"))


def top_merchants(txns: DataFrame, categories: DataFrame, subcategories: DataFrame, q: SpendQuery, limit: int = 10) -> DataFrame:
    """The largest totals; blank merchants are dropped after the limit, so there can be fewer rows."""
    from dataclasses import replace

    sums = spend(txns, categories, subcategories, replace(q, group_by=("merchant",), grain="all"))
    top = sums.orderBy(F.desc("total_minor"), "merchant").limit(min(100, max(1, limit))).where(F.trim("merchant") != "")
    # At most 100 merchants: only their rows are looked through for names.
    wanted = F.broadcast(top.select(F.col("merchant").alias("merchant_key")).distinct())
    names = merchant_names(txns.join(wanted, "merchant_key", "left_semi")).withColumnRenamed("merchant_key", "merchant")
    return top.join(names, "merchant", "left")


def list_transactions(
    txns: DataFrame, kinds: Sequence[str] | None = None, include_non_spend: bool = False, needs_review: bool | None = None,
    search: str = "", sort: str = "-posted_date", page: int = 1, size: int = 50,
) -> DataFrame:
    """A page of the list; ties are ordered by id."""
    wanted = kinds or (None if include_non_spend else (*SPEND_KINDS, "refund"))
    out = txns.where(_among(F.col("kind"), wanted))
    if needs_review is not None:
        out = out.where(F.col("needs_review") == needs_review)
    if search:
        out = out.where(contains_literal("description_clean", search))
    name = sort.lstrip("-")
    by = F.col(name if name in ("posted_date", "amount_minor") else "posted_date")
    size = min(500, max(1, size))
    return out.orderBy(by.desc() if sort.startswith("-") else by.asc(), "id").offset((max(1, page) - 1) * size).limit(size)


def change_by_month(monthly: DataFrame) -> DataFrame:
    """(period, total_minor) with the change to the period before that is present; null percent if that was 0."""
    # One row for each month: the window over all of them is small by nature.
    before = F.lag("total_minor").over(Window.orderBy("period"))
    out = monthly.withColumn("previous_minor", before).withColumn("change_minor", F.col("total_minor") - before)
    return out.withColumn("change_bp", F.expr("CASE WHEN previous_minor <> 0 THEN change_minor * 10000 div abs(previous_minor) END"))


def pivot_by_category(by_month: DataFrame, categories: Sequence[str]) -> DataFrame:
    """One column for each category; rows without one are `uncategorized`."""
    named = by_month.withColumn("category", F.coalesce("category", F.lit("uncategorized")))
    return named.groupBy("period").pivot("category", [*categories, "uncategorized"]).agg(F.sum("total_minor"))
