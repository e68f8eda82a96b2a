"""Against brute force, libraries, SQL and held-out labels."""

import hashlib
import random
from itertools import combinations

import duckdb
import numpy as np
import oracle
import public_tokenizers
import pytest
import zstandard

from hearthledger.llm import byte_bpe, html_extraction, jaccard_join, queries, quality_classifier, quality_rules, token_counts
from hearthledger.llm.common import ngram_ids


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.tables(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    assert oracle.differences(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(queries.SQL[name]).df()) == ""


@pytest.fixture(scope="module")
def texts(duck):
    rng = random.Random(5)
    letters = "abcdefghijstrvlmd'''  \n\t\u00a0\u0085éß日本1٣²!?.,-_🎉"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(500)]
    runs = [c * n for c in "a -=\n'" for n in (1, 2, 3, 50, 300)]
    return [r[0] for r in duck.execute("SELECT text FROM documents").fetchall()] + made + runs + ["", "x<|endoftext|>y", "we'll they've 'tis I'm"]


def test_merge_replay_is_tiktoken(texts):
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    mine = byte_bpe.MergeReplay(ranks, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text, packed in zip(texts, mine.encode(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == theirs.encode_ordinary(text)
        assert mine.decode(packed) == text.encode()
    words = [t for t in list(ranks)[::7] if b"\0" not in t]
    assert [mine.one_word(w) for w in words[:400]] == [np.frombuffer(x, "<u4").tolist() for x in mine.replay(words[:400])]


def test_op6_digests_are_those_of_tiktoken(spark, sf_dir, duck):
    import hashlib

    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    got = queries.QUERIES["op6_byte_bpe"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = theirs.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_transducers_count_as_the_library(texts):
    import json

    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    spec = json.load(open(path))
    mine = token_counts.TokenCounter([tuple(m) for m in spec["model"]["merges"]], ["<|endoftext|>"])
    theirs = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert mine.count(texts) == theirs
    assert [mine.count([t])[0] for t in texts[-40:]] == theirs[-40:]


def test_language_id_on_held_out_rows(spark, sf_dir, duck):
    got = queries.QUERIES["op1_language_id"](spark, sf_dir).toPandas().set_index("doc_id")
    lang = duck.execute("SELECT doc_id, lang FROM documents").df().set_index("doc_id")["lang"]
    held = got[got["held_out"]]
    assert (held["lang_pred"] == lang[held.index]).mean() > 0.95


def test_quality_on_held_out_rows(spark, duck):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op2_quality_classifier"](spark, sf).toPandas().set_index("doc_id")
    want = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").df().set_index("doc_id")["quality"]
    held = got[got["held_out"]].join(want, how="inner")
    assert (held["predicted"] == held["quality"]).mean() > 0.93


def test_pairs_beat_what_single_features_can():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    with_pairs, without = quality_classifier.fit(x, y), quality_classifier.fit(x, y, pairs=0)
    right = lambda m: ((quality_classifier.score(x, m) > 0.5) == y).mean()
    assert right(with_pairs) > 0.95 > 0.8 > right(without)


def _rules_plainly(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_rules_are_those_of_a_plain_count(texts):
    packer = zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    for text in [None, *texts[:60], *texts[200:400], "a b c a b c\n\na b c a b c\na b c a b c"]:
        assert quality_rules.judge(text, packer)[:5] == _rules_plainly(text)


def test_bands_reject_repetition_and_noise():
    packer = zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    rng = random.Random(2)
    noise = " ".join("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(40)) for _ in range(300))
    loop = "\n".join(f"item {i % 10} costs {i % 10} coins in shop {i % 10}" for i in range(400))
    for text in (noise, loop):
        assert not quality_rules.judge(text, packer)[-1]


def test_ngram_ids_do_not_overflow():
    ids = np.array([0, 2**40, 1, 2**40, 1, 2**40])
    got = ngram_ids(ids, 3)
    assert got[1] == got[3] and len(set(got.tolist())) == 3


def _components_plainly(sets):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(sets))]


def test_components_of_chains_and_copies(spark):
    """Chains whose ends are far apart, copies, boundary cases at exactly 0.8, and a passage that all share."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    shared = " ".join(vocab[:12])
    rows = []
    for g in range(12):
        words = [rng.choice(vocab) for _ in range(rng.choice((4, 5, 8, 9, 20, 60, 150)))]
        for step in range(9):
            rows.append(" ".join(words))
            if step % 3:
                words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append(" ".join(words) + " tail")
    rows += [f"{shared} own{i} text{i} here{i}" for i in range(40)] + ["a b c d e f g h", "a b c d e f g h i"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(df.repartition(5)).collect()}
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (r.lower().split() for r in rows)]
    want = _components_plainly(sets)
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(rows))}


def test_a_text_with_a_third_of_noise_or_loops_is_rejected():
    import base64

    packer = zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    rng = random.Random(7)
    vocab = ["".join(rng.choice("aeioustrnlmdk") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    noise = base64.b64encode(rng.randbytes(30_000)).decode()
    noise = " ".join(noise[i : i + 40] for i in range(0, len(noise), 40))
    loop = "the same line again. " * 2_000
    good = prose(14_000)
    assert quality_rules.judge(good, packer)[-1]
    assert not quality_rules.judge(good + " " + noise, packer)[-1]
    bad = quality_rules.judge(good + " " + loop, packer)
    assert bad[7] > 0 and not bad[-1]


def test_pipeline_stages(spark, sf_dir, duck):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packer = zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else {}
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), "test")
        kept[name] = {r["doc_id"] for r in docs.collect()}
        assert kept[name] <= set(before)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
        if name == "quality rules":
            assert kept[name] == {i for i, t in before.items() if quality_rules.judge(t, packer)[-1]}
        if name == "n-gram Jaccard join":
            ids = sorted(before)
            sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (before[i].encode().lower().decode().split() for i in ids)]
            want = _components_plainly(sets)
            assert kept[name] == {ids[c] for c in set(want)}
    assert len(kept["quality classifier"]) > 0.7 * duck.execute("SELECT count(*) FROM documents").fetchone()[0]
    texts = {r[0]: r[1] or "" for r in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    for r in docs.collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_sketches_never_hide_a_link():
    rng = np.random.default_rng(9)
    for n in (1, 5, 17, 64, 300, 5000):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for share in (0.0, 0.5, 0.9, 1.0):
            y = np.unique(np.concatenate((x[: int(len(x) * share)], rng.integers(0, 2**63, 1 + n // 8).astype(np.uint64))))
            low, total = jaccard_join.apart(jaccard_join.sketch(x), jaccard_join.sketch(y))
            assert total == len(x) + len(y)
            assert low <= len(np.setxor1d(x, y))


def test_every_page_of_a_host_has_its_main_text(spark):
    """More pages than a sample, with slugs and categories as words, and a second template without <article>."""
    def word(i):
        return "".join("abcdefghij"[int(d)] for d in f"{i:03}")

    menu, foot = "<nav><a href=/>Home</a></nav>", "<footer>same foot</footer>"
    rows = [(i, f"http://h.example/{i}", f'<html><body class="category-{word(i)}">{menu}<div id="{word(i)}"><article id="post-{word(i)}"><h1>Title {i}</h1><p>Body of {i}.</p></article></div>{foot}</body></html>') for i in range(200)]
    rows[:150] = [(i, f"http://h.example/{i}", f"<html><body>{menu}<div><article><h1>Title {i}</h1><p>Body of {i}.</p></article></div>{foot}</body></html>") for i in range(150)]
    rows += [(i, f"http://h.example/{i}", f'<html><body class="{word(i)}">{menu}<div class="story"><p>Other story {i}, told at length.</p></div>{foot}</body></html>') for i in range(200, 204)]
    want = {i: f"Title {i} Body of {i}." if i < 200 else f"Other story {i}, told at length." for i in range(204)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n in (1, 7):
        got = html_extraction.extract_text(pages.repartition(n)).collect()
        assert {r["page_id"]: r["text"] for r in got} == want
