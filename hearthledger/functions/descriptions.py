"""A raw description made fit to be stored and shown: all steps in their order."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthledger.functions import names, privacy
from hearthledger.functions import text as T


def normalised(rows: DataFrame, own: Iterable[str] = (), raw: str = "description_raw", aliases: Sequence[tuple[str, str]] = names.STORE_ALIASES) -> DataFrame:
    """rows with description_clean, merchant_key and `replaced` (a map: how often each kind of private text was replaced).

    Compatibility characters become plain and control characters go; then a user's own entries and the shapes of private text are replaced, the
    processor's prefix and a reference at the end go, the store gets its name, and the key is made. Only rows with characters beyond ASCII go to a Python worker. A null stays null.
    """
    odd = F.coalesce(F.col(raw).rlike(r"[^\x00-\x7F]"), F.lit(False))
    wide = rows.where(odd).withColumn("_text", privacy.nfkc(F.col(raw)))
    out = rows.where(~odd).withColumn("_text", F.col(raw)).unionByName(wide)
    out = out.withColumn("_own", privacy.personal(privacy.printable(F.col("_text")), own))
    counts = F.map_concat(F.map_from_entries(F.transform(F.map_entries("_own.counts"), lambda e: F.struct(F.lower(F.regexp_replace(e["key"], r"[\[\]]", "")).alias("key"), e["value"].cast("bigint").alias("value")))), _shapes())
    clean = T.squeezed(names.store_alias(T.without_prefix(T.redacted(F.col("_own.text"))), aliases))
    return out.withColumns({"description_clean": clean, "replaced": F.when(F.col(raw).isNotNull(), counts)}).withColumn("merchant_key", T.merchant_key(F.col("description_clean"))).drop("_text", "_own")


def _shapes():
    """Counts of shapes; a phone that is a user's own entry has been counted already and goes by that name."""
    found = T.redaction_counts(F.col("_own.text"))
    return F.map_from_entries(F.transform(F.map_entries(found), lambda e: F.struct(F.when(e["key"] == "phone", "phone_shape").otherwise(e["key"]).alias("key"), e["value"].cast("bigint").alias("value"))))
