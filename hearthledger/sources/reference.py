"""Reference tables of one's own (taxonomy, rules, aliases of stores), checked when they are loaded: what is wrong is reported row by row and left out.

Tables are DataFrames, read from CSV, JSON or Parquet by `load`. Each check returns (sound rows, problems); problems has the table's key columns and `problem`, a row for each thing that is wrong.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = r"^[a-z][a-z0-9_]*$"
#: Where everything goes that nothing else fits; a taxonomy must have it.
FALLBACK = ("others", "uncategorized")
MATCHES = ("exact", "contains", "prefix", "regex")
PATTERN_CHARS = 200
_NESTED = re.compile(r"\([^()]*[+*][^()]*\)[+*{]")


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A reference table by its file's ending; columns that it lacks are null, others are left out."""
    kind = path.rstrip("/").rpartition(".")[2]
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"not a CSV, JSON or Parquet file: {path}")
    reader = spark.read.option("mode", "PERMISSIVE")
    if kind == "csv":
        found = reader.option("header", "true").csv(path)
        wanted = spark.createDataFrame([], schema).schema
        return found.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted])
    return reader.schema(schema).format(kind).load(path)


def _split(rows: DataFrame, key: list[str], checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    wrong = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in checks.items()]))
    told = rows.withColumn("_wrong", wrong)
    return told.where(F.size("_wrong") == 0).select(*rows.columns), told.select(*key, F.explode("_wrong").alias("problem"))


def _again(*columns: str) -> Column:
    """Whether an earlier row has these values: of equal rows one is sound. Rows have no order, so equal ones are told apart by nothing else."""
    return F.row_number().over(Window.partitionBy(*columns).orderBy(*columns)) > 1


def taxonomy(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: category, subcategory, label. Without the fallback pair the whole table is refused."""
    numbered = rows.withColumn("_again", _again("category", "subcategory"))
    good, problems = _split(numbered, ["category", "subcategory"], {
        "the category is no key": ~F.col("category").rlike(KEY), "the subcategory is no key": ~F.col("subcategory").rlike(KEY), "the label is empty": F.trim("label") == "", "the pair is there twice": F.col("_again"),
    })
    good = good.drop("_again")
    if good.where((F.col("category") == FALLBACK[0]) & (F.col("subcategory") == FALLBACK[1])).isEmpty():
        raise ValueError(f"a taxonomy needs {FALLBACK[0]} / {FALLBACK[1]}")
    return good, problems


def _sound(pattern: Column) -> Column:
    def fine(p) -> bool:
        try:
            re.compile(p)
        except (re.error, TypeError):
            return False
        return not _NESTED.search(p)

    @F.pandas_udf("boolean")
    def sound(patterns: pd.Series) -> pd.Series:
        return patterns.map(fine).astype(bool)

    return sound(pattern)


def rules(rows: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: id, match_type, pattern, category, subcategory, priority; pairs: a checked taxonomy. An expression must be valid, at most `PATTERN_CHARS` long and repeat no group that repeats itself."""
    known = pairs.select("category", "subcategory").distinct().withColumn("_known", F.lit(True))
    joined = rows.join(known, ["category", "subcategory"], "left").select(*rows.columns, F.coalesce("_known", F.lit(False)).alias("_known"))
    joined = joined.withColumns({"_again": F.row_number().over(Window.partitionBy("match_type", F.lower("pattern")).orderBy("priority", "id")) > 1, "_sound": _sound(F.col("pattern"))})
    good, problems = _split(joined, ["id"], {
        "the kind of match is unknown": ~F.col("match_type").isin(*MATCHES), "the pattern is empty": F.trim("pattern") == "", "the pattern is too long": F.length("pattern") > PATTERN_CHARS,
        "the expression is not sound": (F.col("match_type") == "regex") & ~F.col("_sound"), "the taxonomy lacks the pair": ~F.col("_known"), "the priority is no number of 0 or more": F.col("priority") < 0, "another rule has the pattern": F.col("_again"),
    })
    return good.select(*rows.columns), problems
