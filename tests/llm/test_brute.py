"""Scores, bands and long words against plain ways of working them out."""

import bisect
import json
import math
import random

import pytest
import zstandard

from hearthledger.llm import quality_classifier, quality_rules, token_counts


def test_long_words_in_chunks_are_counted_like_the_library_does(monkeypatch, spark, sf_dir):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        parts = token_counts.checked(json.load(f))
    rng = random.Random(4)
    docs = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(40).collect()]
    words = ["".join(rng.choices("abcdefghij", k=3000)), "x" * 5000, "thequickbrownfox" * 200, "".join(chr(0x4E00 + rng.randrange(500)) for _ in range(900)), "=" * 2500, "ab" * 1025, *["".join((t or "").split()) for t in docs]]
    want = [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    assert token_counts.TokenCounter(*parts).count(words) == want
    for long, chunk, warm in ((8, 4, 1), (16, 16, 8), (600, 100, 0)):
        monkeypatch.setattr(token_counts, "LONG_WORD", long)
        monkeypatch.setattr(token_counts, "WORD_CHUNK", chunk)
        monkeypatch.setattr(token_counts, "WARM", warm)
        assert token_counts.TokenCounter(*parts).count(words) == want


def test_scores_are_sums_of_tables(spark):
    """The score of each document from the model's tables, feature by feature."""
    docs = "/root/testdata/sf0.01"
    model = quality_classifier.production_model(spark, docs)
    rows = quality_classifier.classify(spark.read.parquet(f"{docs}/documents.parquet"), model).select("text", "score", "predicted").collect()
    for r in rows:
        x = quality_classifier.features(r["text"])
        at = [bisect.bisect_right(list(e), v) for e, v in zip(model["edges"], x)]
        total = model["bias"] + sum(float(t[k]) for t, k in zip(model["tables"], at)) + sum(float(values[at[i]][at[j]]) for i, j, values in model["pairs"])
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.7)


def test_bands_and_verdicts_of_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n))
    prose = max((r["text"] or "" for r in docs.collect()), key=len)
    made = [prose[:9000] + " " + noise(k) for k in (500, 3000, 9000, 40_000)] + [(prose[:300] + " ") * k for k in (3, 20, 200)] + ["é" * 5000, " ".join(noise(6) for _ in range(3000))]
    every = docs.unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(made)], docs.schema))
    packer = zstandard.ZstdCompressor(level=quality_rules.LEVEL)

    def outside(raw, bands):
        own = [b for b in bands if b[0] <= len(raw)]
        return bool(own) and not own[-1][1] <= len(packer.compress(raw)) / len(raw) <= own[-1][2]

    n_bad_seen = 0
    for r in quality_rules.quality_rules(every).collect():
        raw = (r["text"] or "").encode()
        chunks = [raw[i : i + quality_rules.CHUNK_BYTES] for i in range(0, len(raw), quality_rules.CHUNK_BYTES)]
        judged = [c for c in chunks if len(c) >= quality_rules.CHUNK_BANDS[0][0]]
        bad = sum(outside(c, quality_rules.CHUNK_BANDS) for c in judged)
        n_bad_seen += bad > 0
        assert (r["n_chunks"], r["n_bad_chunks"]) == (len(judged), bad)
        assert r["kept"] == (not r["base_failed"] and not outside(raw, quality_rules.WHOLE_BANDS) and bad <= quality_rules.MAX_BAD_CHUNKS * len(judged))
    assert n_bad_seen >= 5
