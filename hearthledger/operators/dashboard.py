"""What the screens work out of finished aggregates: trend, totals by user, headline tax, shares of income, payers, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthledger.functions.text import money_plain
from hearthledger.operators.tax import FICA, INCOME, MEMO


def trend(by_period: DataFrame) -> DataFrame:
    """(period, total_minor) of rows with a period, in order."""
    name = F.coalesce("period", F.lit("unknown"))
    return by_period.groupBy(name.alias("period")).agg(F.sum("total_minor").alias("total_minor")).orderBy("period")


def latest_change(points: DataFrame) -> DataFrame:
    """One row: the last period against the one before; no row with fewer than two. The change in percent is null after a zero."""
    last = points.orderBy(F.desc("period")).limit(2).agg(F.sort_array(F.collect_list(F.struct("period", "total_minor")), False).alias("_p")).where("size(_p) = 2")
    now, before = F.col("_p")[0], F.col("_p")[1]
    delta = now["total_minor"] - before["total_minor"]
    return last.select(
        now["period"].alias("current_period"), before["period"].alias("previous_period"), now["total_minor"].alias("current_minor"), before["total_minor"].alias("previous_minor"),
        delta.alias("delta_minor"), F.when(before["total_minor"] != 0, delta / F.abs(before["total_minor"])).alias("delta_pct"),
    )


def totals_by_user(by_user: DataFrame) -> DataFrame:
    sums = by_user.where("user is not null").groupBy(F.col("user").alias("user_id")).agg(F.sum("total_minor").alias("total_minor"))
    return sums.orderBy(F.desc("total_minor"), "user_id")


def headline_tax(summaries: DataFrame) -> DataFrame:
    """summaries with federal (liability, else withheld), FICA, state (liability, else state and local withheld) and their sum."""
    federal = F.coalesce("total_federal_tax", "federal_income_tax_withheld")
    state = F.coalesce("state_income_tax_liability", F.col("state_income_tax_withheld") + F.col("local_income_tax_withheld"))
    out = summaries.withColumns({
        "federal_minor": federal, "federal_kind": F.when(F.col("total_federal_tax").isNotNull(), "liability").otherwise("withheld"),
        "fica_minor": sum((F.col(c) for c in FICA), F.lit(0)), "state_minor": state,
    })
    return out.withColumn("total_tax_minor", F.col("federal_minor") + F.col("fica_minor") + F.col("state_minor"))


def year_over_year(summaries: DataFrame) -> DataFrame:
    return headline_tax(summaries).select("tax_year", "total_income_minor", "total_tax_minor").orderBy("tax_year")


def result_of(refund: Column, owed: Column) -> Column:
    """A struct (kind, amount_minor): refund, owed, even, or unknown where neither is known."""
    kind = F.when(refund.isNull() & owed.isNull(), "unknown").when(refund > 0, "refund").when(owed > 0, "owed").otherwise("even")
    amount = F.when(kind == "refund", refund).when(kind == "owed", owed).when(kind == "even", F.lit(0))
    return F.struct(kind.alias("kind"), amount.cast("bigint").alias("amount_minor"))


def income_shares(summaries: DataFrame, key: list[str]) -> DataFrame:
    """(key, category, amount_minor, share): categories that are not 0; the part of the positive ones in their sum, null for others."""
    named = [F.struct(F.lit(c).alias("category"), F.col(c).alias("amount_minor")) for c in INCOME if c not in MEMO]
    rows = summaries.select(*key, F.explode(F.array(*named)).alias("_i")).select(*key, "_i.*").where("amount_minor <> 0")
    positive = F.when(F.col("amount_minor") > 0, F.col("amount_minor"))
    return rows.withColumn("share", positive / F.sum(positive).over(Window.partitionBy(*key)))


def payers(by_payer: DataFrame) -> DataFrame:
    """(tax_year, payer, form_type, total_minor): users combined, the largest of a year first."""
    sums = by_payer.groupBy("tax_year", "payer", "form_type").agg(F.sum("amount_minor").alias("total_minor"))
    return sums.orderBy(F.desc("tax_year"), F.desc("total_minor"), "payer", "form_type")


def provenance(needs_review: Column, method: Column, edited: Column) -> Column:
    """How a form came to be, as it is shown."""
    return (
        F.when(needs_review, "Read by LLM — needs review").when(method == "manual", "Entered manually").when(edited, "Edited")
        .when(method == "llm", "Read by LLM — confirmed").otherwise("Parsed")
    )


def report(by_month_category: DataFrame) -> DataFrame:
    """Rows of the month and category report, amounts as text."""
    name = F.coalesce("category", F.lit("uncategorized"))
    return by_month_category.select("period", name.alias("category"), "currency", money_plain(F.col("total_minor")).alias("total"), "txn_count").orderBy("period", "category")
