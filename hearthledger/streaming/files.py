"""Import of files by their content: a file that was read is a no-op when it is sent again, one that failed is read anew.

The ledger is a table (file_sha256, path, state, error, batch) below `target`/files, rows of files are below `target`/rows; both are laid out by micro-batch. A batch writes its rows first and its ledger
entries last, and both replace what an earlier try of the same batch has left. Rows count only once the ledger has their file as done in their batch, so a batch that dies in between leaves nothing to be seen,
and its repetition nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

LEDGER = "file_sha256 string, path string, state string, error string, batch long"
DONE, FAILED = "done", "failed"


def ledger(spark: SparkSession, target: str) -> DataFrame:
    """What is known of each file: a row for each batch that read it; empty before the first."""
    found = spark.read.option("pathGlobFilter", "*.parquet").option("ignoreMissingFiles", "true")
    return found.schema(LEDGER).parquet(f"{target}/files") if _exists(spark, f"{target}/files") else spark.createDataFrame([], LEDGER)


def states(spark: SparkSession, target: str) -> DataFrame:
    """(file_sha256, state, error, batch): the last state of each file; done stays done."""
    last = F.max_by(F.struct("state", "error", "batch"), F.struct((F.col("state") == DONE).alias("done"), "batch")).alias("_s")
    return ledger(spark, target).groupBy("file_sha256").agg(last).select("file_sha256", "_s.*")


def imported(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The rows of all files that are done."""
    if not _exists(spark, f"{target}/rows"):
        return spark.createDataFrame([], schema)
    done = states(spark, target).where(F.col("state") == DONE).select("file_sha256", "batch")
    full = StructType(schema.fields).add("batch", "long")
    return spark.read.schema(full).parquet(f"{target}/rows").join(done, ["file_sha256", "batch"], "left_semi").select(*schema.names)


def import_files(spark: SparkSession, source: str, target: str, checkpoint: str, read: Callable[[DataFrame], DataFrame], once: bool = True, files_per_batch: int = 1000, pattern: str = "*") -> StreamingQuery:
    """Stream the files of a folder into `target`.

    read: files (file_sha256, path, content) to rows with file_sha256 and error; a file with a row whose error is set, or without rows, has failed and keeps none of its rows. Only files that the ledger does not have as done get to it. Two
    files of one content are one.
    """

    def batch(files: DataFrame, batch_id: int) -> None:
        known = states(spark, target).where((F.col("state") == DONE) & (F.col("batch") != batch_id)).select("file_sha256")
        sent = files.select(F.sha2("content", 256).alias("file_sha256"), "path", "content")
        fresh = sent.join(known, "file_sha256", "left_anti").dropDuplicates(["file_sha256"])
        rows = read(fresh).withColumn("batch", F.lit(batch_id).cast("long"))
        place = f"{target}/rows/batch={batch_id}"
        rows.drop("batch").write.mode("overwrite").parquet(place)
        written = spark.read.schema(rows.drop("batch").schema).parquet(place)
        outcome = written.groupBy("file_sha256").agg(F.first("error", True).alias("error"), F.count("*").alias("n"))
        entries = fresh.drop("content").join(outcome, "file_sha256", "left")
        error = F.coalesce("error", F.when(F.col("n").isNull(), "no rows were found"))
        entries = entries.select("file_sha256", "path", F.when(error.isNull(), DONE).otherwise(FAILED).alias("state"), error.alias("error"))
        entries.write.mode("overwrite").parquet(f"{target}/files/batch={batch_id}")

    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).load(source)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
