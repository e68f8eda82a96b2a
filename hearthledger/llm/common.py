"""Shared helpers: bounded Arrow batches, tables in the shared folder, packed word arrays."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a text column that go to a Python worker at once, and their bytes (a longer text goes alone).
TEXT_ROWS_PER_BATCH = 500
TEXT_BYTES_PER_BATCH = 16 << 20

#: The white space of the word rule `[^\x20\x09-\x0D]+`.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shipped(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_hearthledger_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="hearthledger-")) / "hearthledger_workers.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent).as_posix())
    sc.addPyFile(str(to))
    sc._hearthledger_shipped = True


def bounded_batches(spark: SparkSession, rows: int = TEXT_ROWS_PER_BATCH) -> None:
    """Before Python work on texts: ship the package and lower the session's Arrow batches to `rows` and to TEXT_BYTES_PER_BATCH.

    The limits stay lowered, as the work is lazy; a session whose limits are lower keeps its own.
    """
    shipped(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = spark.conf.get(key, "1g").rstrip("Bb")
    if not (found.isdigit() and 0 < int(found) <= TEXT_BYTES_PER_BATCH):
        spark.conf.set(key, str(TEXT_BYTES_PER_BATCH))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on one machine whose session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="hearthledger-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    A lost executor costs no more than the tasks it was running, and the rows
    are the same at each later read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: str | Column, mod: int) -> Column:
    """crc32 of doc_id as text, modulo `mod` (null for a null id)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % F.lit(mod)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ALNUM = bytes(
    (c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    r"""Lower-case A-Z, then the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_ALNUM).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    r"""The words `[^\x20\x09-\x0D]+`, as UTF-8 (bytes.split() knows just this white space)."""
    return text.encode("utf-8", "replace").split() if text else []


_LINE = re.compile("\n")


def ngram_ids(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for each window of n consecutive ids: equal windows have equal numbers."""
    if len(ids) < n:
        return np.empty(0, np.int64)
    top = int(ids.max()) + 1
    windows = ids[: len(ids) - n + 1].astype(np.int64)
    size = top
    for k in range(1, n):
        if size * top >= 2**62:
            windows = np.unique(windows, return_inverse=True)[1]
            size = int(windows.max()) + 1
        windows = windows * top + ids[k : len(ids) - n + 1 + k]
        size *= top
    return windows


def word_ids(words: list[bytes]) -> np.ndarray:
    """Numbers by first occurrence."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
