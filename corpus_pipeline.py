"""The corpus pipeline: quality, rules, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents;
the last returns the token ids of what is left.

Defined cases, of all stages: an empty table gives an empty one; a row with a null id is judged by its text like any other; a null or empty
text counts as one without words; texts are read whole; equal texts are judged alike; extra columns pass through as they are, also where an
operator has a result of that name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthledger.llm import byte_bpe, decontamination, jaccard_join, quality_classifier, quality_rules
from hearthledger.llm.common import table, written

#: Columns that operators add; documents that have some of their own keep these.
MADE = ("score", "predicted", "items", "spans", "n_words", *(x.split()[0] for x in quality_rules.SCHEMA.split(", ")))


def _kept(docs: DataFrame, choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What choose keeps of docs, with just their columns."""
    own = {c: f"_own_{c}" for c in docs.columns if c in MADE}
    out = choose(docs.withColumnsRenamed(own))
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones that are not held out.

    Texts without words score alike, by what the labels say of such. Without labelled rows all score 0.5 and go.
    """
    out = quality_classifier.held_out()
    model = quality_classifier.train(docs.where(~out), table(spark, sf_dir, "labels").where(~out))
    return _kept(docs, lambda d: quality_classifier.classify(d, model).where("predicted = 1"))


def rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the count rules or the compression bands go, those without words among them."""
    return _kept(docs, lambda d: quality_rules.quality_rules(d).where("kept"))


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links at five-word shingles and a similarity of 0.8, the smallest doc_id stays, once.

    A row without an id stays if none of its group has one; texts without words link with nothing and stay.
    """
    return _kept(docs, lambda d: jaccard_join.keep_one(d, jaccard_join.join(d)))


def benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verified window of a benchmark item go; those without words stay."""
    found = table(spark, sf_dir, "benchmark")
    return _kept(docs, lambda d: decontamination.remove_documents(decontamination.find(d, found)))


def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (packed), with digests of them and of what they decode to; none for a text that is null or empty."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN).select(
        "doc_id", "lang", "source", "n_tokens", "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality),
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("byte-level BPE encoding and decoding", tokens),
]

#: Neither the classifier nor zstandard can be expressed in SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
