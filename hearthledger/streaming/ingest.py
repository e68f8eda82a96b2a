"""Incremental ingest: new files of rows are hashed and appended once, whatever is sent twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hearthledger.operators.ledger import hashed, new_rows


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Stream parquet files of raw rows into `target`; a row whose (account_id, dedupe_hash) is there is left out.

    History has no bound, so duplicates are found by an anti join with the table for each micro-batch and not in
    watermarked state. The hash holds the date, so the table is laid out by month and only the months of the batch are read.
    A batch writes folders of its own number, so a repeated one overwrites itself. A statement comes in one batch: its equal rows are numbered there.
    """
    places = {"month": F.date_format("posted_date", "yyyy-MM")}

    def append(batch: DataFrame, batch_id: int) -> None:
        rows = hashed(batch).withColumns(places).withColumn("batch", F.lit(batch_id).cast("long"))
        key = ["account_id", "dedupe_hash"]
        seen = rows.select(*key).limit(0)
        if batch_id > 0:
            months = [r["month"] for r in rows.select("month").distinct().collect()]  # of one batch
            stored = spark.read.schema(rows.schema).parquet(target)
            seen = stored.where(F.col("month").isin(months) & (F.col("batch") < batch_id)).select(*key)
        fresh = new_rows(rows, seen).select(*rows.columns)
        fresh.write.partitionBy("month", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(target)

    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = reader.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
