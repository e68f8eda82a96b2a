"""Sinks: transactions and reports as CSV or JSON. The account mask is never written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of an export, in order.
COLUMNS = (
    "id", "statement_id", "account_id", "posted_date", "transaction_date", "description_raw", "description_clean", "amount_minor", "currency", "kind",
    "category_key", "subcategory_key", "merchant_key", "notes", "needs_review",
)


def exported(txns: DataFrame, user_id: int | None = None) -> DataFrame:
    """The columns of an export that the rows have, the oldest first."""
    rows = txns if user_id is None else txns.where(F.col("user_id") == user_id)
    return rows.select(*[c for c in COLUMNS if c in txns.columns]).orderBy("posted_date", "id")


def export(txns: DataFrame, path: str, fmt: str = "csv", user_id: int | None = None) -> None:
    if fmt not in ("csv", "json"):
        raise ValueError("csv or json")
    writer = exported(txns, user_id).write.mode("overwrite")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.json(path)


def tax_report(summary: DataFrame, sections: dict[str, list[str]]) -> DataFrame:
    """Long rows (tax_year, section, category, amount_minor) of a year summary."""
    parts = [F.struct(F.lit(s).alias("section"), F.lit(c).alias("category"), F.col(c).cast("long").alias("amount_minor")) for s, cs in sections.items() for c in cs]
    return summary.select("tax_year", F.explode(F.array(*parts)).alias("_p")).select("tax_year", "_p.*").where("amount_minor is not null")
