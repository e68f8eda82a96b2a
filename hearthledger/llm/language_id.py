"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting and scoring both turn a batch of texts into one array of normalised
code points (letters lower-cased, every run of other characters one space) and
hash its 1- to 3-grams into `BUCKETS` buckets with numpy. Counts are summed in
each task first and then by Spark; what is shuffled is, for each language and task, the buckets that occur and
their counts. The log-probability matrix (languages x buckets) is broadcast in groups of at most
`GROUP_LANGS` languages, 128 KB each; a text's score is a sparse row of bucket counts times that matrix, and the best
and the sum over groups are combined by column expressions, so there is no limit on languages.

Defined cases: a text that is null, empty or has no letter gets `und` and score 0; rows whose
language or doc_id is null are not learned from; ties go to the language that sorts first;
without any row to learn from every text gets `und`. Texts are read whole, in
blocks of `BLOCK` code points. Extra columns pass through untouched.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, remainder, table

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
BLOCK = 1 << 18
#: Rows learned from, for each language, at most: a bounded sample by a hash of doc_id.
TRAIN_ROWS_PER_LANG = 8_000
#: Languages in one broadcast matrix: 64 MB at most.
GROUP_LANGS = 500
UND = "und"

_TABLE: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point to lower-case letter, or 0 for what is no letter."""
    global _TABLE
    if _TABLE is None:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                out[c] = ord(ch.lower()[0])
        _TABLE = out
    return _TABLE


def _normalised(text: str) -> np.ndarray:
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    codes = np.concatenate(([0], codes, [0])).astype(np.uint32)
    return codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]


def _buckets(codes: np.ndarray, buckets: int, starts: int | None = None) -> np.ndarray:
    """Hashed n-grams that begin at the first `starts` places of a text; those that are a space alone are left out."""
    out, c = [], codes.astype(np.uint64)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            take = (mixed >> np.uint64(64 - buckets.bit_length() + 1))[:starts]
            out.append(take[c[: len(take)] != 0] if n == 1 else take)
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def bucket_blocks(text: str, buckets: int) -> Iterator[np.ndarray]:
    """The hashed n-grams of a whole text, by blocks; each n-gram is in the block where it begins."""
    codes = _normalised(text)
    for at in range(0, len(codes), BLOCK):
        yield _buckets(codes[at : at + BLOCK + max(ORDERS) - 1], buckets, BLOCK)


def count_ngrams(docs: DataFrame, lang_col: str, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(lang, docs, at, counts): the buckets that occur in the given rows (int32) and their counts (int64), packed little-endian."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def rows(totals: dict[str, np.ndarray], docs_of: dict[str, int]) -> pd.DataFrame:
        used = {k: np.flatnonzero(v) for k, v in totals.items()}
        return pd.DataFrame({
            "lang": list(totals), "docs": [docs_of[k] for k in totals], "at": [used[k].astype("<i4").tobytes() for k in totals],
            "counts": [v[used[k]].astype("<i8").tobytes() for k, v in totals.items()],
        })

    def in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                if not isinstance(text, str):
                    continue
                sums = totals.setdefault(lang, np.zeros(buckets, np.int64))
                docs_of[lang] = docs_of.get(lang, 0) + 1
                for found in bucket_blocks(text, buckets):
                    sums += np.bincount(found, minlength=buckets)
            if len(totals) >= GROUP_LANGS:
                yield rows(totals, docs_of)
                totals, docs_of = {}, {}
        if totals:
            yield rows(totals, docs_of)

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(buckets, np.int64)
        for at, n in zip(pdf["at"], pdf["counts"]):
            total[np.frombuffer(at, "<i4")] += np.frombuffer(n, "<i8")
        lang = pdf["lang"].iloc[0]
        return rows({lang: total}, {lang: int(pdf["docs"].sum())})

    schema = "lang string, docs long, at binary, counts binary"
    partial = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInPandas(in_task, schema)
    for_group = partial.withColumn("part", F.spark_partition_id() % 64)
    first = for_group.groupBy("lang", "part").applyInPandas(summed, schema)
    return first.groupBy("lang").applyInPandas(summed, schema)


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_lang: int = TRAIN_ROWS_PER_LANG,
    buckets: int = BUCKETS,
    smoothing: float = 0.5,
) -> dict:
    """The model, from at most about `rows_per_lang` rows of each language (by a hash of the id)."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = known.groupBy(F.col(lang_col).alias("lang")).count().collect()  # a row for each language
    # A fixed part of each language by hash, so that the sample is the same at each run.
    share = {r["lang"]: min(1.0, rows_per_lang / r["count"]) for r in sizes}
    unit = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000))
    part = F.from_json(F.lit(json.dumps({k: int(v * 1_000_000) for k, v in sorted(share.items())})), "map<string,int>")[F.col(lang_col)]
    counted = count_ngrams(known.where(unit < part), lang_col, text_col, buckets).collect() if share else []
    counted = sorted(counted, key=lambda r: r["lang"])
    langs = [r["lang"] for r in counted]
    if not langs:
        return {"langs": [], "prior": np.zeros(0), "logp": np.zeros((buckets, 0), np.float32)}
    logp = np.empty((buckets, len(langs)), np.float32)
    for k, r in enumerate(counted):
        counts = np.full(buckets, smoothing)
        counts[np.frombuffer(r["at"], "<i4")] += np.frombuffer(r["counts"], "<i8")
        logp[:, k] = np.log(counts) - np.log(counts.sum())
    total = {r["lang"]: r["count"] for r in sizes}
    prior = np.log(np.array([total[x] for x in langs], float) / sum(total[x] for x in langs))
    return {"langs": langs, "prior": prior, "logp": logp}


def score_texts(texts: list, langs: list[str], prior: np.ndarray, logp: np.ndarray) -> list[tuple]:
    """(best language, its log score, sum of exp(score - best)) of each text; the name is null where a text has no letter."""
    out: list[tuple] = []
    for text in texts:
        total, letters = prior.copy(), False
        for found in bucket_blocks(text, len(logp)) if isinstance(text, str) and langs else ():
            hit = np.bincount(found)
            used = np.flatnonzero(hit)
            letters = letters or bool(len(used))
            total += hit[used] @ logp[used].astype(np.float64)
        if not letters:
            out.append((None, None, None))
            continue
        best = int(np.argmax(total))
        out.append((langs[best], float(total[best]), float(np.exp(total - total[best]).sum())))
    return out


def predict(docs: DataFrame, model: dict, text_col: str = "text", group: int = GROUP_LANGS) -> DataFrame:
    """docs with lang_pred and score; narrow passes, one for each group of languages, no shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    langs = model["langs"]

    def scored(shared):
        @F.pandas_udf("lang string, best double, sum double")
        def of_group(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for part in texts:
                yield pd.DataFrame(score_texts(list(part), *shared.value), columns=["lang", "best", "sum"])

        return of_group(F.col(text_col))

    parts = [slice(at, at + group) for at in range(0, len(langs), group)] or [slice(0, 0)]
    names = [f"_group{k}" for k in range(len(parts))]
    out = docs
    for name, part in zip(names, parts):
        shared = spark.sparkContext.broadcast((langs[part], model["prior"][part], np.ascontiguousarray(model["logp"][:, part])))
        out = out.withColumn(name, scored(shared))
    best = F.greatest(*[F.col(f"{n}.best") for n in names], F.lit(float("-inf")))
    # Groups are in the order of names: the first that has the best score has the language that sorts first.
    lang = F.coalesce(*[F.when(F.col(f"{n}.best") == best, F.col(f"{n}.lang")) for n in names], F.lit(UND))
    total = sum((F.col(f"{n}.sum") * F.exp(F.col(f"{n}.best") - best) for n in names[1:]), F.col(f"{names[0]}.sum") * F.exp(F.col(f"{names[0]}.best") - best))
    out = out.withColumn("_lang", lang).withColumn("_score", F.coalesce(1 / total, F.lit(0.0)))
    drop = [c for c in ("lang_pred", "score") if c in docs.columns]
    return out.drop(*drop, *names).withColumnsRenamed({"_lang": "lang_pred", "_score": "score"})


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(remainder(id_col, 5) == 0, F.lit(True))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )
