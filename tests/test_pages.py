"""Words in rows, cells of columns and groups of rows, as the readers of large folders need them."""

import random

from pyspark.sql import functions as F

from hearthledger.operators import tax
from hearthledger.sources import tax_readers, words


def test_words_of_a_page_may_come_in_arrays(spark):
    rng = random.Random(4)
    flat = [("f", p, f"w{i}", x := rng.randrange(300) / 2, x + 9, t := rng.randrange(240) / 4, t + 8 + i % 3) for p in (1, 2) for i in range(90)]
    df = spark.createDataFrame(flat, "file_sha256 string, page_number int, text string, x0 double, x1 double, top double, bottom double")
    pieces = df.groupBy("file_sha256", "page_number", F.col("x0") % 5).agg(F.collect_list(F.struct("text", "x0", "x1", "top", "bottom")).alias("words")).select("file_sha256", "page_number", "words")
    read = lambda rows: sorted((r.page_number, r.row_number, r.top, r.text) for r in rows.collect())
    got = read(words.rows_of(pieces))
    assert got == read(words.rows_of(df))
    want = []
    for p in (1, 2):
        page = sorted((t, x, x1, w, b) for _, q, w, x, x1, t, b in flat if q == p)
        near, rows = sorted(b - t for t, _, _, _, b in page), []
        near = (near[44] + near[45]) / 4
        for word in page:  # crowded: rows whose words are each near the next, but not near the first
            if not rows or word[0] - rows[-1][0][0] > near:
                rows.append([])
            rows[-1].append(word)
        want += [(p, n, r[0][0], " ".join(w[3] for w in sorted(r, key=lambda w: w[1:4]))) for n, r in enumerate(rows)]
    assert got == want


def test_words_without_a_place_are_rows_of_their_own(spark):
    df = spark.createDataFrame([("f", 1, "a", 0.0, 5.0, None, 9.0), ("f", 1, "b", 0.0, 5.0, None, 9.0), ("f", 1, "c", 9.0, 12.0, 3.0, 13.0), ("f", 1, "d", 0.0, 5.0, 4.0, 14.0)], "file_sha256 string, page_number int, text string, x0 double, x1 double, top double, bottom double")
    assert [r.text for r in words.rows_of(df).orderBy("row_number").collect()] == ["a", "b", "d c"]


def test_cells_follow_their_columns(spark):
    df = spark.sql("SELECT array(named_struct('x0', -3D, 'x1', 1D, 'text', 'a'), named_struct('x0', 5D, 'x1', 7D, 'text', 'b'), named_struct('x0', 20D, 'x1', 24D, 'text', 'c'), named_struct('x0', 26D, 'x1', 29D, 'text', 'd')) AS w, array(0D, 5D, 10D, 20D) AS s")
    assert df.select(words.cells(F.col("w"), F.col("s")).alias("c")).first().c == ["a", "b", "", "c d"]


def test_texts_that_an_expression_needs():
    assert tax_readers.sure_texts(r"Add lines 1a|etc\.?\s*Attach Form\(s\) W-2") == ["add lines 1a", "attach form(s) w-2"]
    assert tax_readers.sure_texts(r"(?:^|\s)(?:25a|a)\s+Form\(s\) W-2") == ["form(s) w-2"] and tax_readers.sure_texts(r"ab{2}cd*") == ["a"]


def test_forms_have_their_items_without_their_documents(spark):
    forms = spark.createDataFrame([(1, 9, "w2", "source"), (2, 9, "w2", "source")], "id long, document_id long, form_type string, role string")
    items = spark.createDataFrame([(1, "wages", 5), (1, "wages", 3)], "form_id long, category string, amount_minor long")
    got = {r.id: (len(r.income_items or ()), r.tax_items) for r in tax.with_items(forms, items, items.limit(0)).collect()}
    assert got == {1: (2, None), 2: (0, None)}
