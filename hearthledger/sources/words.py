"""Statement words: rows by position, and transactions from dated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthledger.functions.columns import let
from hearthledger.functions.text import money_minor


def page_numbers(spec: str, limit: int = 100_000) -> list[int]:
    """`1-3,5` as sorted distinct page numbers; bounds are checked before anything is expanded."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, _, high = part.partition("-")
        if not low.strip().isdigit() or (high and not high.strip().isdigit()):
            raise ValueError(f"not a page range: {part!r}")
        a, b = int(low), int(high or low)
        if not 1 <= a <= b or b > limit:
            raise ValueError(f"pages out of range: {part!r}")
        out |= set(range(a, b + 1))
    return sorted(out)


PAGE, ROW = ["file_sha256", "page_number"], ["file_sha256", "page_number", "row_number"]
#: The fields of a word, in the order in which they are sorted.
WORD = ("top", "x0", "x1", "text", "bottom")
#: Points between two words that may part columns, and between two such gaps of one column.
MIN_GAP = 8.0


def rows_of(words: DataFrame) -> DataFrame:
    """(file_sha256, page_number, row_number, words, top, text): words of a page by rows, both from the top and from the left.

    words: (file_sha256, page_number) with a word in each row (text, x0, x1, top, bottom), or with an array `words` of some of a page's words. A word belongs to
    the row whose first word it is no further from than half the page's median height of words. A page is a bounded group: it holds what fits on a sheet.
    """
    if "words" in words.columns:
        fields = words.schema["words"].dataType.elementType.names
        own = F.col("words") if tuple(fields) == WORD else F.transform("words", lambda w: F.struct(*[w[c].alias(c) for c in WORD]))
        pieces = F.flatten(F.collect_list(own))
    else:
        pieces = F.collect_list(F.struct(*WORD))
    pages = words.groupBy(*PAGE).agg(F.sort_array(pieces).alias("_w")).withColumn("_t", F.col("_w.top"))
    heights = F.sort_array(F.filter(F.transform("_w", lambda w: w["bottom"] - w["top"]), lambda h: h > 0))
    near = F.coalesce(let(heights, lambda h: (F.get(h, F.floor((F.size(h) - 1) / 2).cast("int")) + F.get(h, F.floor(F.size(h) / 2).cast("int"))) / 2), F.lit(10.0)) / 2
    # Where a word is further than that from the one before it, a row begins in any case; mostly no row is wider, and no other begins.
    far = F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: (i == 0) | F.coalesce(F.get("_t", i) - F.get("_t", i - 1) > F.col("_near"), F.lit(True)))
    pages = pages.withColumn("_near", near).withColumn("_far", far)
    wide = F.exists(F.transform("_far", lambda at, n: F.get("_t", F.coalesce(F.get("_far", n + 1), F.size("_t")) - 1) - F.get("_t", at)), lambda h: F.coalesce(h > F.col("_near"), F.lit(False)))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def placed(acc: Column, top: Column) -> Column:
        """The anchor and the places of words that begin a row."""
        same = F.abs(top - acc["anchor"]) <= F.col("_near")
        return F.struct(F.when(same, acc["anchor"]).otherwise(top).alias("anchor"), (acc["i"] + 1).alias("i"), F.when(same, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["i"]))).alias("starts"))

    pages = pages.select(*PAGE, "_w", F.when(wide, F.aggregate("_t", start, placed)["starts"]).otherwise(F.col("_far")).alias("_s"))

    def row(at: Column, n: Column) -> Column:
        own = F.slice("_w", at + 1, F.coalesce(F.get("_s", n + 1), F.size("_w")) - at)
        from_left = F.sort_array(F.transform(own, lambda w: F.struct(w["x0"].alias("x0"), w["x1"].alias("x1"), w["text"].alias("text"))))
        return F.struct(n.alias("row_number"), from_left.alias("words"), F.get("_w", at)["top"].alias("top"))

    # A page has a row at least; a plain explode would work the rows out twice, for a filter of its own.
    out = pages.select(*PAGE, F.explode_outer(F.transform("_s", row)).alias("_r")).select(*PAGE, "_r.*")
    return out.withColumn("text", joined(F.col("words")))


def joined(words: Column) -> Column:
    return F.array_join(words["text"], " ")


def select_pages(words: DataFrame, pages: list[int]) -> DataFrame:
    """The words of these pages; of a file that has none of them, all."""
    has = F.max(F.col("page_number").isin(pages).cast("int")).over(Window.partitionBy("file_sha256"))
    return words.withColumn("_has", has).where(F.col("page_number").isin(pages) | (F.col("_has") == 0)).drop("_has") if pages else words


def has_text_layer(words: DataFrame, least: int = 50) -> DataFrame:
    """(file_sha256, has_text_layer): whether half the pages have this many characters or more."""
    chars = words.groupBy(*PAGE).agg(F.sum(F.length("text") + 1).alias("_c"))
    return chars.groupBy("file_sha256").agg((F.median("_c") >= least).alias("has_text_layer"))


def content_hash(files: DataFrame) -> DataFrame:
    """(path, file_sha256) of a binaryFile scan."""
    return files.select("path", F.sha2("content", 256).alias("file_sha256"))


def nested(rows: DataFrame, key: list[str], order: Sequence[str]) -> DataFrame:
    """(key, group): for each key its rows in an array, by `order`, which must tell them apart.

    Dealt out anew by file: the sorts and windows of many steps in one task would have to share its memory.
    """
    rest = [c for c in rows.columns if c not in (*key, *order)]
    return rows.repartition("file_sha256").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("group"))


def unnested(groups: DataFrame) -> DataFrame:
    """The rows of `nested`, with what was worked out for their groups meanwhile."""
    own = [c for c in groups.columns if c != "group"]
    return groups.select(*own, F.explode_outer("group").alias("group")).select(*own, "group.*")


def bands(rows: Column) -> Column:
    """The columns (x0, x1) that recurring gaps between the words of rows part, from the left."""

    def gaps(words: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.struct(words[i - 1]["x1"].alias("a"), F.get(words, i)["x0"].alias("b")))
        return F.transform(F.filter(pairs, lambda p: p["b"] - p["a"] >= MIN_GAP), lambda p: (p["a"] + p["b"]) / 2)

    none = F.array().cast("array<struct<mid: double, n: int>>")
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), none.alias("done"))
    closed = lambda acc: F.concat(acc["done"], F.array(F.struct((acc["sum"] / acc["n"]).alias("mid"), acc["n"].alias("n"))))

    def clustered(acc: Column, x: Column) -> Column:
        far = x - acc["last"] > MIN_GAP
        return F.struct(x.alias("last"), F.when(far, x).otherwise(acc["sum"] + x).alias("sum"), F.when(far, 1).otherwise(acc["n"] + 1).alias("n"), F.when(far, closed(acc)).otherwise(acc["done"]).alias("done"))

    def parted(rs: Column) -> Column:
        mids = F.sort_array(F.flatten(F.transform(rs, lambda r: gaps(r["words"]))))
        clusters = F.aggregate(mids, start, clustered, lambda acc: F.when(acc["n"] > 0, closed(acc)).otherwise(none))
        enough = F.greatest(F.lit(1), F.bround(F.size(rs) * 0.3))
        low, high = F.array_min(F.transform(rs, lambda r: r["words"][0]["x0"])), F.array_max(F.transform(rs, lambda r: F.array_max(r["words"]["x1"])))
        edges = F.concat(F.array(low), F.filter(clusters, lambda c: c["n"] >= enough)["mid"], F.array(high + 1))
        return let(edges, lambda e: F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda i: F.struct(e[i - 1].alias("x0"), e[i].alias("x1"))))

    return let(rows, lambda rs: F.when(F.size(rs) > 0, parted(rs)))


def header_starts(words: Column) -> Column:
    """Where the columns begin that one row of names tells: at its first word and in the middle of each wide gap."""

    def middles(ws: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - 1, F.lit(1))), lambda i: F.struct(ws[i - 1]["x1"].alias("a"), F.get(ws, i)["x0"].alias("b")))
        return F.concat(F.array(ws[0]["x0"]), F.transform(F.filter(pairs, lambda p: p["b"] - p["a"] >= MIN_GAP), lambda p: (p["a"] + p["b"]) / 2))

    return F.when(F.size(words) > 0, let(words, middles))


def cells(words: Column, starts: Column) -> Column:
    """The text of each column, an empty one where no word is; words are from the left, so that a column's follow each other."""
    bounds = F.sort_array(F.transform(starts, lambda s: F.coalesce(s, F.lit(float("inf")))))

    def cut(row: Column) -> Column:
        edges = F.transform(row["starts"], lambda s, i: F.when(i == 0, 0).otherwise(F.size(row["x"]) - F.size(F.filter(row["x"], lambda x: x >= s))))
        return let(edges, lambda e: F.transform(e, lambda a, i: F.array_join(F.slice(row["texts"], a + 1, F.coalesce(F.get(e, i + 1), F.size(row["x"])) - a), " ")))

    return let(F.struct(words["x0"].alias("x"), words["text"].alias("texts"), bounds.alias("starts")), cut)


DATE = r"\b\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?\b|(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-zA-Z]*\.?\s+\d{1,2}\b"


def has_money(text: Column) -> Column:
    return F.exists(F.split(text, " "), lambda t: money_minor(t).isNotNull())


def with_shape(rows: DataFrame) -> DataFrame:
    """rows with `dated` (a date in the left third of the row's extent) and `priced` (money in the right third)."""
    low, high = F.col("words")[0]["x0"], F.array_max("words.x1")
    third = (high - low) / 3
    left = joined(F.filter("words", lambda w: w["x0"] <= low + third))
    right = joined(F.filter("words", lambda w: w["x1"] >= high - third))
    return rows.withColumns({"dated": left.rlike(DATE), "priced": has_money(right)})


def tables_of(rows: DataFrame) -> DataFrame:
    """Rows of tables: `table` (its first row), `kind` (data, section, continuation, total) and `header` (the words of the row above with the columns' names).

    A table is a run of three rows or more with a date at the left and money at the right, of which two in a row may lack them and
    six in ten have them. Rows that follow belong to it while they start right of the first column and are no total or heading.
    """
    by_page = Window.partitionBy(*PAGE).orderBy("row_number")
    shaped = with_shape(rows).withColumn("bearing", F.col("dated") & F.col("priced"))
    capitals = (F.upper("text") == F.col("text")) & F.col("text").rlike(r"\p{L}")
    above = [F.lag(F.struct(F.trim("text").alias("text"), "priced", "words"), k).over(by_page) for k in (1, 2, 3)]
    shaped = shaped.withColumns({f"_above{k}": a for k, a in enumerate(above)})
    header = F.coalesce(*[F.when((F.col(f"_above{k}.text") != "") & ~F.col(f"_above{k}.priced"), F.col(f"_above{k}.words")) for k in range(3)])
    shaped = shaped.withColumn("header", header).drop("_above0", "_above1", "_above2")
    # Runs of a page's rows, without a join: a bearing row over three rows after the one before begins one.
    before = F.last(F.when(F.col("bearing"), F.col("row_number")), True).over(by_page.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.col("bearing") & F.coalesce(F.col("row_number") - before > 3, F.lit(True))
    shaped = shaped.withColumn("_begins", begins).withColumn("_run", F.sum(F.col("_begins").cast("int")).over(by_page))
    run = Window.partitionBy(*PAGE, "_run")
    shaped = shaped.withColumns({"_end": F.max(F.when(F.col("bearing"), F.col("row_number"))).over(run), "_n": F.count(F.when(F.col("bearing"), 1)).over(run)})
    length = F.col("_end") - F.col("row_number") + 1
    sound = F.col("_begins") & (length >= 3) & (F.col("_n") / length >= 0.6)
    table = F.when(sound, F.struct(F.col("row_number").alias("table"), "_end", F.col("header").alias("_header")))
    placed = shaped.withColumn("_t", F.last(table, True).over(by_page)).where("_t is not null").drop("header", "_end", "_n", "_begins", "_run")
    placed = placed.withColumns({"table": F.col("_t.table"), "header": F.col("_t._header"), "_end": F.col("_t._end")}).drop("_t")
    total = F.col("text").rlike(r"(?i)\btotal\b")
    wraps = (F.trim("text") != "") & ~total & ~capitals
    groups = nested(placed.withColumn("_wraps", wraps), [*PAGE, "table"], ["row_number"])
    groups = groups.withColumn("_first", bands(F.filter("group", lambda r: r["bearing"] & (r["row_number"] <= r["_end"])))[0]["x1"])
    ends = F.filter("group", lambda r: (r["row_number"] > r["_end"]) & ~(r["_wraps"] & (r["words"][0]["x0"] >= F.col("_first"))))
    placed = unnested(groups.withColumn("_stop", F.get(ends, F.lit(0))["row_number"])).where("row_number <= _end or _stop is null or row_number < _stop")
    kind = F.when(total, "total").when(F.trim("text") == "", "continuation").when(~F.col("priced"), F.when(capitals, "section").otherwise("continuation")).otherwise("data")
    return placed.withColumn("kind", kind).drop("_end", "_first", "_stop", "_wraps")


def date_of(text: Column, year: Column) -> Column:
    """A leading MM/DD of a row, in the given year."""
    month, day = F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})\b", 1), F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})\b", 2)
    return F.when(month != "", F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"))


def transactions_of(rows: DataFrame, year: int) -> DataFrame:
    """Dated rows that end in money; a row without a date goes on with the text of the one before."""
    at = rows.withColumn("posted_date", date_of(F.col("text"), F.lit(year))).withColumn("amount_minor", money_minor(F.regexp_extract("text", r"(\S+)$", 1)))
    starts = F.col("posted_date").isNotNull() & F.col("amount_minor").isNotNull()
    w = Window.partitionBy("file_sha256").orderBy("page_number", "row_number")
    grouped = at.withColumn("ordinal", F.sum(starts.cast("int")).over(w)).where("ordinal > 0")
    body = F.when(starts, F.regexp_replace("text", r"^\S+\s+|\s+\S+$", "")).otherwise(F.col("text"))
    out = grouped.groupBy("file_sha256", "ordinal").agg(
        F.min("posted_date").alias("posted_date"), F.min_by("amount_minor", F.struct("page_number", "row_number")).alias("amount_minor"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "row_number", body.alias("t")))), lambda x: x["t"]), " ").alias("description_raw"),
    )
    return out
