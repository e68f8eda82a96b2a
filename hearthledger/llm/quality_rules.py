"""Quality rules with compression bands.

The zstandard ratio (compressed bytes / bytes) of the whole text and of its fixed
chunks must lie inside a band that depends on the length: repetitive text compresses too well,
random text not at all. Count rules (words, repeated 3-word windows) come first. All is
worked out from the whole text in one narrow pass; nothing is shuffled.

Defined cases: a null or empty text has no words, so it fails the base rules; texts
shorter than the first band's length have no ratio limits; a text of exactly a
band's length belongs to that band. Repeated rows are judged alike. Extra columns pass
through, and columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, bounded_batches, ngram_ids, space_words, table, word_ids

LEVEL = 3
CHUNK_BYTES = 4096
SYMBOLS = "#*$%&|<>"
#: (bytes from, least ratio, greatest ratio) of a whole text. Measured on sf0.1 at LEVEL: the middle text has 0.58 below 1,000 bytes, 0.49 below 4,000, 0.45 below
#: 20,000 and 0.42 beyond, 99 in 100 are at most at 0.71, 0.55, 0.47 and 0.43. Base64 has 0.80 at 1,000 bytes and 0.75 at 20,000, a looped sentence 0.04 and less.
#: The bands leave a margin on both sides, wider for short texts, where frames of a few bytes move the ratio.
WHOLE_BANDS = ((200, 0.20, 0.95), (1_000, 0.17, 0.80), (4_000, 0.15, 0.72), (20_000, 0.12, 0.68), (100_000, 0.10, 0.66))
#: The same of one chunk; the last, shorter chunk is judged by its own length.
CHUNK_BANDS = ((1_000, 0.10, 0.82), (4_000, 0.08, 0.76))
#: A text is rejected if more than this part of its judged chunks lies outside the band. Of the 10,000 documents of sf0.1 none has a chunk outside.
MAX_BAD_CHUNKS = 0.2
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean"
)
#: Columns that come after the others.
MORE = ("ratio", "n_chunks", "n_bad_chunks")


def in_band(size: int, ratio: float, bands: tuple) -> bool:
    """Whether the ratio fits the last band that begins at or below size."""
    fits = True
    for least, low, high in bands:
        if size >= least:
            fits = low <= ratio <= high
    return fits


def judge(text: str | None, packer: zstandard.ZstdCompressor) -> tuple:
    """The columns of SCHEMA for one text."""
    text = text if isinstance(text, str) else ""
    words = space_words(text)
    ids = word_ids(words)
    windows = ngram_ids(ids, 3)
    repeated = np.zeros(len(ids), bool)
    if len(windows) > 1:
        _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
        twice = counts[back] > 1
        for k in range(3):
            repeated[k : k + len(twice)] |= twice
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    n_repeat = int(repeated.sum())
    base_failed = len(words) < 50 or 100 * n_repeat > 50 * len(words)

    raw = text.encode("utf-8", "replace")
    ratio = len(packer.compress(raw)) / len(raw) if raw else 0.0
    n_chunks = n_bad = 0
    for at in range(0, len(raw), CHUNK_BYTES):
        part = raw[at : at + CHUNK_BYTES]
        if len(part) >= CHUNK_BANDS[0][0]:
            n_chunks += 1
            n_bad += not in_band(len(part), len(packer.compress(part)) / len(part), CHUNK_BANDS)
    fits = in_band(len(raw), ratio, WHOLE_BANDS) and n_bad <= MAX_BAD_CHUNKS * n_chunks
    return (
        len(words), len(text) - sum(text.count(c) for c in ASCII_SPACE), sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)), n_repeat, ratio, n_chunks, n_bad, base_failed, fits and not base_failed,
    )


def quality_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns of SCHEMA."""
    bounded_batches(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    @F.pandas_udf(SCHEMA)
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for part in texts:
            yield pd.DataFrame([judge(x, packer) for x in part], columns=names)

    out = docs.withColumn("_judged", judged(F.col(text_col))).drop(*[c for c in docs.columns if c in names])
    more = [n for n in names if n not in MORE]
    return out.select("*", *(F.col(f"_judged.{n}") for n in [*more, *MORE])).drop("_judged")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.drop("text")
