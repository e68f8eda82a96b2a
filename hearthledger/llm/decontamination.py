"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Benchmark items become windows of `N` words (an item with fewer words is one shorter
window). Their hashes, sorted, go to each worker as a broadcast variable, with the
words of each window for verifying. A document's words are mapped to
numbers of the benchmark's vocabulary; the hashes of all its windows are worked out with
numpy, looked up, and each hit is verified word by word. What is found can remove the hit
spans or the whole document.

The broadcast's size is checked first: a benchmark of more than `max_windows` words in
all is split by a hash of the item into blocks under that size, and the documents go
through one narrow pass a block, each written before the next. No pass shuffles documents.

Defined cases: null and empty texts have no words and no hits; items without words have
no windows; an item with a null id still marks words, but is not counted; items
that are repeated or share windows are all named, each id once. Extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, bounded_batches, table, written

N = 10
#: Words of benchmark text in one broadcast; about 300 bytes each in a worker.
MAX_WINDOWS = 500_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "n_words long, spans array<struct<first:int,last:int>>, items array<string>"


def build_index(items: list[tuple], n: int = N) -> dict:
    """Windows of all items: vocabulary, sorted hashes by length, and hash -> [(words, items)]."""
    vocab: dict[bytes, int] = {}
    windows: dict[int, dict[tuple, set]] = {}
    for item_id, text in items:
        ids = [vocab.setdefault(w, len(vocab)) for w in alnum_words(text)]
        size = min(n, len(ids))
        for at in range(len(ids) - size + 1 if size else 0):
            windows.setdefault(size, {}).setdefault(tuple(ids[at : at + size]), set()).add(item_id)
    hashes = {}
    for size, found in windows.items():
        hashes[size] = np.unique(_hashes(np.array(list(found), np.int64).reshape(-1, size).T))
    return {"vocab": vocab, "windows": windows, "hashes": hashes}


def _hashes(columns) -> np.ndarray:
    """One hash for each position, from the arrays of its first, second, ... word number."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def scan(text: str | None, index: dict) -> tuple[int, list, list]:
    """Words of a text; the spans (first and last word) of verified windows, merged; their items."""
    words = alnum_words(text)
    get = index["vocab"].get
    ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    unknown = np.concatenate(([0], np.cumsum(ids < 0)))
    hit = np.zeros(len(words) + 1, np.int64)
    items: set = set()
    for size, hashes in index["hashes"].items():
        if len(ids) < size:
            continue
        at = np.flatnonzero(unknown[size:] == unknown[:-size])
        if not len(at):
            continue
        h = _hashes([ids[at + k] for k in range(size)])
        near = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        for p in at[hashes[near] == h].tolist():
            found = index["windows"][size].get(tuple(ids[p : p + size].tolist()))
            if found is not None:
                items |= found
                hit[p] += 1
                hit[p + size] -= 1
    inside = np.concatenate(([False], np.cumsum(hit[:-1]) > 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    spans = [{"first": int(a), "last": int(b) - 1} for a, b in edges.reshape(-1, 2)]
    return len(words), spans, sorted(str(x) for x in items if x is not None)


def _merged(a: list, b: list) -> list:
    """The union of two lists of spans."""
    out: list = []
    for s in sorted([*a, *b], key=lambda x: x["first"]):
        if out and s["first"] <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], s["last"])
        else:
            out.append(dict(s))
    return out


def _scanner(shared):
    """The scan of one block of the benchmark, a broadcast index, as a column function."""

    @F.pandas_udf(SCHEMA)
    def scanned(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            yield pd.DataFrame([scan(x, shared.value) for x in t], columns=["n_words", "spans", "items"])

    return scanned


def _joiner():
    """What two blocks have found, in one."""

    @F.pandas_udf(SCHEMA)
    def joined(rows: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        spans = [_merged(list(a), list(b)) for a, b in zip(rows["spans"], more["spans"])]
        both = [sorted({*a, *b}) for a, b in zip(rows["items"], more["items"])]
        return pd.DataFrame({"n_words": rows["n_words"], "spans": spans, "items": both})

    return joined


def find(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    n: int = N, max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """docs with n_words, spans (of word positions) and items."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks = max(1, -(-size // (4 * max_windows)))  # a word takes two bytes at least, commonly six
    names = [c for c in docs.columns if c in ("n_words", "spans", "items")]
    out = docs.drop(*names)
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(build_index([(r["item"], r["text"]) for r in part.toLocalIterator()], n))

        found = _scanner(shared)(F.col(text_col))
        if k:
            out = out.withColumn("_more", found)
            found = _joiner()(F.col("_found"), F.col("_more"))
        out = out.withColumn("_found", found).drop("_more")
        if k < blocks - 1:
            out = written(out, "decontamination")
    return out.select("*", "_found.*").drop("_found")


def n_hit(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)


def remove_documents(found: DataFrame) -> DataFrame:
    """What has no verified window."""
    return found.where(F.size("spans") == 0).drop("n_words", "spans", "items")


def remove_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The texts without their hit spans; all else, between and around them, stays as it is."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, hits in zip(texts, spans):
            if isinstance(text, str) and len(hits):
                places, kept, at = [m.span() for m in _WORD.finditer(text)], [], 0
                for s in hits:
                    kept.append(text[at : places[s["first"]][0]])
                    at = places[s["last"]][1]
                text = "".join(kept) + text[at:]
            out.append(text)
        return pd.Series(out, dtype=object)

    return found.withColumn(text_col, cut(F.col(text_col), F.col("spans"))).drop("n_words", "spans", "items")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), windows AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT DISTINCT k FROM grams) WHERE len(w) >= k)
), hits AS (
  SELECT doc_id, i, k, item_id FROM windows JOIN grams USING (k, g)
), marked AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(m.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(m.n, 0) > 0 AS contaminated
FROM words LEFT JOIN marked m USING (doc_id) LEFT JOIN named i USING (doc_id)
"""
