"""Each operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from hearthledger.llm import byte_bpe, decontamination, html_extraction, jaccard_join, language_id, quality_classifier, quality_rules, sharding, token_counts, url_filters

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both(odd_docs, no_docs):
    return odd_docs, no_docs


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_language_id(both):
    docs, none = both
    model = language_id.train(docs)
    out = language_id.predict(docs, model)
    assert out.count() == 13 and "source" in out.columns
    got = by_id(out, "lang_pred", "score")
    assert got[4] == got[5] == got[6] == got[7] == ("und", 0.0)
    assert got[1] == got[2] and got[1][0] == "en" and 0 <= got[1][1] <= 1
    assert language_id.predict(none, language_id.train(none)).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.train(none)).collect()} == {"und"}


def test_quality_classifier(spark, both):
    docs, none = both
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (9, 0), (10, 0), (4, 0), (7, None), (None, 1), (9, 0)], "doc_id long, quality int")
    out = quality_classifier.classify(docs, quality_classifier.train(docs, labels))
    got = by_id(out, "score", "predicted")
    assert out.count() == 13 and all(0 <= s <= 1 and p == (s >= 0.7) for s, p in got.values())
    assert got[4] == got[5] == got[6]
    flat = quality_classifier.train(none, labels.limit(0))
    assert {r["score"] for r in quality_classifier.classify(docs, flat).collect()} == {0.5}
    assert quality_classifier.classify(none, flat).count() == 0


def test_quality_rules(both):
    docs, none = both
    got = by_id(quality_rules.quality_rules(docs), "n_words", "base_failed", "kept")
    assert got[4] == got[5] == got[6] == (0, True, False)
    assert got[11] == (1, True, False)
    assert quality_rules.quality_rules(none).count() == 0


def test_decontamination(spark, both):
    docs, none = both
    items = spark.createDataFrame([(1, " ".join(decontamination.alnum_words(docs.where("doc_id = 3").first()["text"])[i].decode() for i in range(20, 34))), (2, None), (3, "!!"), (None, "one two"), (1, "lazy zebra"), (5, "ONE two")], "item_id long, text string")
    out = decontamination.find(docs, items)
    got = by_id(out.withColumn("hit", decontamination.n_hit()), "n_words", "hit", "items")
    assert got[5] == got[4] == got[6] == (0, 0, [])
    assert got[3][1] >= 14 and got[3][2] == ["1"]
    assert got[9] == (2, 2, ["5"])
    split = decontamination.find(docs, items, max_windows=5)
    assert sorted(map(str, split.select("doc_id", "spans", "items").collect())) == sorted(map(str, out.select("doc_id", "spans", "items").collect()))
    assert by_id(decontamination.remove_spans(out), "text")[9] == ("",)
    left = decontamination.remove_documents(out)
    assert 9 not in by_id(left, "text") and 1 in by_id(left, "text")
    assert decontamination.find(none, items).count() == 0 and decontamination.find(docs, items.limit(0)).where("size(items) > 0").count() == 0


def test_sharding(both):
    docs, none = both
    out = sharding.shard(docs, 3)
    rows = out.collect()
    assert len(rows) == 13 and {r["size"] for r in rows if r["doc_id"] == 5} == {16}
    for k in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    assert sharding.shard(none, 3).count() == 0
    assert {r["shard"] for r in sharding.shard(docs, 1).collect()} == {0}


def test_byte_bpe(both):
    docs, none = both
    out = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    assert out.where("coalesce(text, '') <> decode(decoded, 'UTF-8')").count() == 0
    assert by_id(out, "n_tokens")[5] == (0,)
    assert byte_bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert out.select(byte_bpe.unpacked()).first()[0]


def test_token_counts(both):
    docs, none = both
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    for r in token_counts.count_tokens(docs, path).collect():
        assert r["n_tokens"] == len(t.encode(r["text"] or "", add_special_tokens=False).ids)
        assert r["n_bytes"] == len((r["text"] or "").encode())
    assert token_counts.count_tokens(none, path).count() == 0


def test_html_extraction(spark):
    page = "<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p>First  <b>bold</b>\n text<p>Second<script>x='</p>'</script></article><div class='comments'><p>me too</p></div><footer>foot</footer>"
    rows = [(1, "http://h.example/1", page), (1, "http://h.example/1", page), (2, "http://h.example/2", page.replace("Second", "Other")), (3, None, "<p>loose"), (4, "http://h.example/4", None), (5, "http://h.example/5", ""), (None, "bad", "text < only"), (6, "http://x.example/", "<main>" + "<p>long</p>" * 5000 + "</main>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old")).withColumn("host", F.lit("old"))
    out = {(r["page_id"], r["n_chars"]): r["text"] for r in html_extraction.extract_text(pages).collect()}
    texts = {k[0]: v for k, v in out.items()}
    assert texts[1] == "A & B First bold text Second" and texts[2] == "A & B First bold text Other"
    assert texts[3] == "loose" and texts[4] == texts[5] == "" and texts[None] == "text < only"
    assert len(texts[6]) == 5 * 5000 - 1
    assert html_extraction.extract_text(pages.limit(0)).count() == 0


def test_lists_of_links_in_an_article_stay():
    page = "<nav><a href=/>Home</a></nav><article><p>Text {0}.</p><ul>{1}</ul><ul class=related><li><a href=/r>see also</a></li></ul></article>"
    linked = [page.format(i, "".join(f"<li><a href=/{i}{k}>Source {i}{k}</a></li>" for k in range(9))) for i in range(5)]
    plain = page.format(9, "<li>one</li><li>two</li>")
    wrapper = html_extraction.infer(linked)
    assert html_extraction.extract(plain, wrapper) == "Text 9. one two"
    assert html_extraction.extract(linked[1], wrapper) == "Text 1. " + " ".join(f"Source 1{k}" for k in range(9))


def test_wrappers_are_union_free():
    one = "<ul><li>a</li><li>b</li></ul><h2>x</h2><p>1</p><h2>y</h2><p>2</p>"
    two = "<ul><li>c</li></ul><em>new</em><h2>z</h2><p>3</p>"
    w = html_extraction.merged(html_extraction.folded(html_extraction.parse(one)), html_extraction.folded(html_extraction.parse(two)))
    shape = [(k["s"], k["o"], k["r"]) for k in w["k"]]
    assert shape[0] == ("ul", False, False) and (w["k"][0]["k"][0]["s"], w["k"][0]["k"][0]["r"]) == ("li", True)
    assert ("em", True, False) in shape and any(r for _, _, r in shape)


def test_url_filters(spark):
    urls = [None, "", "no scheme", "http://", "https://EXAMPLE.org/es/1", "https://a.example.org/en/12?x#y", "https://example.org/en/2", "http://notexample.org/es/", "ftp://b.com/de/", "http://x.com/fr/?a", "http://x.com?/fr/", "http://spam-farm.example.net/en/", "a://b://c.org/", "http://x.net/pills"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(4, urls[4])], "page_id int, url string").withColumn("host", F.lit("old")).withColumn("verdict", F.lit(1))
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages).collect()}
    assert got[None] == got[""] == got["no scheme"] == got["http://"] == ("", "", None, "allow")
    assert got[urls[4]] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[urls[5]] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[urls[6]][2:] == ("org/", "allow") and got[urls[7]][2:] == ("org/", "allow")
    assert got[urls[8]][2:] == ("com/de/", "block") and got[urls[9]][2:] == ("com/fr/", "allow")
    assert got[urls[10]] == ("x.com", "", None, "allow") and got[urls[11]][2:] == (None, "block")
    assert got[urls[12]][0] == "b:" and got[urls[13]][3] == "allow"
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_native_operators_have_no_python(spark, sf_dir):
    for f in (url_filters.op4_url_filters, sharding.op5_sharding):
        plan = f(spark, sf_dir)._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_jaccard_join(both):
    docs, none = both
    got = by_id(jaccard_join.join(docs), "n_shingles", "component_id")
    assert got[4] == (0, 4) and got[5] == (0, 5) and got[6] == (0, 6)
    assert got[1][1] == got[2][1] == 1 and got[9] == (1, 9) and got[None][1] == 3
    kept = [r["doc_id"] for r in jaccard_join.keep_one(docs, jaccard_join.join(docs)).collect()]
    assert sorted(kept) == [1, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert jaccard_join.join(none).count() == 0


def test_rows_that_ids_do_not_tell_apart(spark, odd_docs):
    """Null ids with texts of their own, near copies and no words; one id with different texts, and with copies."""
    long = odd_docs.where("doc_id = 8").first()["text"].split()
    text_of = lambda k, n: " ".join(f"{w}{k}" for w in long[k * n : k * n + n])
    rows = [(1, text_of(1, 90)), (None, text_of(2, 90)), (None, text_of(2, 90) + " tail"), (None, text_of(1, 90)), (None, text_of(4, 90)), (None, ""), (None, ""), (None, None)]
    rows += [(7, text_of(6, 90)), (7, text_of(8, 90)), (7, text_of(8, 90)), (8, ""), (8, None), (9, text_of(6, 90) + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    joined = jaccard_join.join(docs)
    assert joined.count() == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in joined.collect()} == {(1, 1), (None, 1), (None, None), (7, 7), (8, 8), (9, 7)}
    kept = [(r["doc_id"], (r["text"] or "").removesuffix(" tail")) for r in jaccard_join.keep_one(docs, joined).collect()]
    want = [(1, text_of(1, 90)), (None, text_of(2, 90)), (None, text_of(4, 90)), (None, ""), (None, ""), (None, ""), (7, text_of(6, 90)), (7, text_of(8, 90)), (8, "")]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_html_of_any_depth_and_width():
    import time

    deep = "<html><body><nav>" + "<div>" * 60_000 + "menu" + "</div>" * 60_000 + "</nav><article>" + "<div>a <span>" * 30_000 + "core" + "</span> z</div>" * 30_000 + "</article></body></html>"
    spans = "<article><p>" + "<b><center>" * 20_000 + "inner" + "</p>outer</article>"
    wide = "<html><body>" + "".join(f"<x{i} class='w{i}'>t{i}</x{i}>" for i in range(20_000)) + "<article><p>core</p></article></body></html>"
    start = time.time()
    for pages, want in (([deep, deep.replace("core", "kern")], "a " * 30_000 + "core" + " z" * 30_000), ([spans, spans], "innerouter"), ([wide, wide.replace("t1", "u1")], "core")):
        wrapper = html_extraction.infer(pages)
        got = html_extraction.extract(pages[0], wrapper)
        assert "menu" not in got and got.replace(" ", "") == want.replace(" ", "")
        assert html_extraction.extract(pages[0], html_extraction.infer([])).replace(" ", "") == want.replace(" ", "")
    assert time.time() - start < 120


def test_language_blocks_count_each_ngram_once(monkeypatch):
    import numpy as np

    text = "".join(chr(0x61 + (i * i + i // 7) % 26) if i % 6 else " " for i in range(5_000)) + "\U00032100 \U0002070e"
    whole = np.bincount(np.concatenate(list(language_id.bucket_blocks(text, 1 << 15))), minlength=1 << 15)
    monkeypatch.setattr(language_id, "BLOCK", 64)
    assert (np.bincount(np.concatenate(list(language_id.bucket_blocks(text, 1 << 15))), minlength=1 << 15) == whole).all()
    assert language_id._normalised("\U000323af\U00020000").any()  # letters of any plane


def test_language_id_is_plain_bayes_in_groups_of_any_size(spark, odd_docs):
    import math

    import numpy as np

    rows = odd_docs.where("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang").dropDuplicates(["doc_id"]).collect()
    made = spark.createDataFrame([(r["doc_id"] * 10 + k, r["text"][k * 9 :], f"{r['lang']}{k % 3}") for r in rows for k in range(3)], "doc_id long, text string, lang string")
    model = language_id.train(made)
    # Plainly: n-grams one by one, over the letters of a text and single spaces.
    grams = {}
    for r in made.collect():
        for found in plain_grams(r["text"]):
            b = int(language_id._buckets(np.array(found, np.uint32), 1 << 15)[-1])
            grams.setdefault(r["lang"], {}).setdefault(b, 0)
            grams[r["lang"]][b] += 1
    langs = sorted(r["lang"] for r in made.select("lang").distinct().collect())
    n = {x: made.where(f"lang = '{x}'").count() for x in langs}
    want = {}
    for r in made.collect():
        found = [int(language_id._buckets(np.array(g, np.uint32), 1 << 15)[-1]) for g in plain_grams(r["text"])]
        if found:
            total = [math.log(n[x] / sum(n.values())) + sum(math.log((grams.get(x, {}).get(b, 0) + 0.5) / (sum(grams.get(x, {}).values()) + 0.5 * (1 << 15))) for b in found) for x in langs]
            best = max(range(len(langs)), key=lambda i: total[i])
            want[r["doc_id"]] = (langs[best], 1 / sum(math.exp(t - total[best]) for t in total))
        else:
            want[r["doc_id"]] = ("und", 0.0)
    for group in (500, 1, 2):
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(made, model, group=group).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(abs(got[k][1] - want[k][1]) < 1e-2 for k in want)


def plain_grams(text):
    out, last = [], 0
    codes = [0]
    for ch in text:
        c = ord(ch.lower()[0]) if ch.isalpha() else 0
        if c or last:
            codes.append(c)
        last = c
    if last:
        codes.append(0)
    for n in (1, 2, 3):
        out += [codes[i : i + n] for i in range(len(codes) - n + 1) if n > 1 or codes[i]]
    return out


def test_shards_do_not_depend_on_partitions_and_keep_groups(spark):
    rows = [(i, f"text {i * i} " + "x" * (i * 37 % 400)) for i in range(3_000)]
    rows += [(10_000 + i, "a group " * 40) for i in range(60)] + [(20_000 + i, "larger than a shard " * 5) for i in range(3_000)] + [(30_000 + i, None) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [sorted(map(tuple, sharding.shard(docs.repartition(n), 12).select("doc_id", "size", "text_crc32", "shard", "slot").collect())) for n in (1, 7)]
    assert out[0] == out[1] and len(out[0]) == len(rows)
    shards, load = {}, {}
    for doc_id, size, crc, shard, slot in out[0]:
        shards.setdefault(crc, {}).setdefault(shard, []).append(size)
        load[shard] = load.get(shard, 0) + size
    mean = sum(load.values()) / 12
    assert sorted(load) == list(range(12)) and all(abs(x - mean) < 0.03 * mean for x in load.values())
    for parts in shards.values():
        assert len(parts) == 1 or sum(map(sum, parts.values())) > mean
    for k in range(12):
        assert sorted(r[4] for r in out[0] if r[3] == k) == list(range(sum(r[3] == k for r in out[0])))


def test_shard_sizes_and_checksums_are_those_of_the_texts(spark, sf_dir):
    import zlib

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = sharding.op5_sharding(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {k: (len(t) + 16, zlib.crc32(t)) for k, t in texts.items()}
    assert all(0 <= r["shard"] < 40 for r in got)


@pytest.fixture(scope="module")
def small_tables(spark, tmp_path_factory, odd_docs):
    """A folder with labels of odd documents and a benchmark item that one of them has."""
    to = str(tmp_path_factory.mktemp("tables"))
    passage = " ".join(odd_docs.where("doc_id = 3").first()["text"].split()[5:25])
    spark.createDataFrame([(i, int(i not in (4, 7, 11)), 0) for i in range(1, 12)], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    spark.createDataFrame([(1, passage), (None, "zz"), (3, None)], "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return to


def test_pipeline_stages_on_odd_documents(spark, both, small_tables):
    import corpus_pipeline

    docs, none = both
    rows = lambda df: sorted(map(str, df.select("doc_id", "text", "score", "kept").collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small_tables)
        assert out.columns == docs.columns and set(rows(out)) <= set(rows(docs)) and {r["score"] for r in out.collect()} <= {"old"}, name
        assert stage(spark, none, small_tables).count() == 0
    left = rows(corpus_pipeline.benchmark(spark, docs, small_tables))
    assert left == sorted(str(r) for r in docs.select("doc_id", "text", "score", "kept").collect() if r["text"] is None or not (r["doc_id"] in (3, None)))
    ids = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, small_tables).collect()}
    assert ids == {1, 3, 4, 5, 6, 7, 8, 9, 10, 11}
    assert {r["doc_id"] for r in corpus_pipeline.rules(spark, docs, small_tables).collect()}.isdisjoint({4, 5, 6, 7, 9, 11})
    assert {r["n_tokens"] for r in corpus_pipeline.tokens(spark, docs, small_tables).where("doc_id in (4, 5)").collect()} == {0}


def test_tokenizers_of_another_kind_are_refused():
    good = {"model": {"type": "BPE", "merges": [["a", "b"]]}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "added_tokens": [], "normalizer": None}
    assert token_counts.checked(good) == ([("a", "b")], [])
    for bad in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {"type": "WordPiece"}}):
        with pytest.raises(ValueError):
            token_counts.checked(good | bad)


def test_both_sides_of_every_switch(spark, sf_dir, monkeypatch):
    """Other plans beyond a size give the same rows."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = lambda: sorted(map(str, html_extraction.extract_text(pages.select("page_id", "url", "html")).select("page_id", "text").collect()))
    rule = lambda: sorted(map(str, url_filters.judge(pages.select("page_id", "url")).collect()))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = lambda: sorted(r["doc_id"] for r in jaccard_join.keep_one(docs, jaccard_join.join(docs)).collect())
    before = text(), rule(), kept()
    monkeypatch.setattr(html_extraction, "MAX_HOSTS", 0)
    monkeypatch.setattr(url_filters, "MAX_RULES", 2)
    monkeypatch.setattr(jaccard_join, "MAX_BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard_join, "REGION_ROWS", 2)
    monkeypatch.setattr(jaccard_join, "COUNTERS", 64)
    assert (text(), rule(), kept()) == before


def test_ties_of_rules_and_very_long_urls(spark):
    rules = [url_filters.Rule("allow", "a", ("a",), "n/1", 3), url_filters.Rule("block", "a", ("a",), "n/2", 3), url_filters.Rule("allow", "zz", ("zz",), "zz", 2)]
    urls = spark.createDataFrame([(1, "http://a/"), (2, "http://zz/a"), (3, "http://b/" + "x/" * 200_000 + "zz"), (4, "http://q")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge(urls, rules, ()).collect()}
    assert got == {1: ("n/2", "block"), 2: ("n/2", "block"), 3: ("zz", "allow"), 4: (None, "allow")}


def test_language_ties_go_to_the_first_name(spark):
    docs = spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a"), (3, "same words", "c")], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    for group in (1, 2, 500):
        assert {r["lang_pred"] for r in language_id.predict(docs, model, group=group).collect()} == {"a"}


def test_a_text_of_exactly_a_bands_length_belongs_to_it():
    bands = ((10, 0.2, 0.9), (20, 0.5, 0.8))
    assert quality_rules.in_band(9, 0.0, bands) and not quality_rules.in_band(10, 0.1, bands)
    assert quality_rules.in_band(19, 0.3, bands) and not quality_rules.in_band(20, 0.3, bands) and quality_rules.in_band(20, 0.5, bands)
