"""Where forms stand on a page: columns cut between forms side by side, parts by form, and the forms of a file in reading order.

A page is a bounded group (it holds what fits on a sheet) and a file one of some pages, so windows by page and by file are bounded. `laid_out` returns rows as it got
them, but with the columns of a page one after the other; every reader of rows then reads forms side by side like forms one below the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthledger.functions.columns import let
from hearthledger.functions.text import money_minor
from hearthledger.sources.words import PAGE, joined

# Fixed values, in points: what parts two texts of a row; how far apart two headings side by side begin; rows below a heading that show where columns part;
# the narrowest stripe between columns; how near a line above a heading belongs to it.
RUN_GAP, APART, SAMPLE_ROWS, STRIPE, PREAMBLE = 14.0, 100.0, 8, 4.0, 14.0
#: How far below a heading these rows may be, so that notes further down do not hide the columns.
SAMPLE_HEIGHT = 120.0
# Fixed values of columns without headings: the narrowest gap from an amount to the next label, how near gaps of rows must lie, rows that must agree, rows of a part that is cut.
GUTTER, GUTTER_NEAR, GUTTER_ROWS, GUTTER_LEAST = 12.0, 6.0, 3, 6
#: How often what is left above and below a cut is looked at again.
GUTTER_LEVELS = 2
#: Words of a heading at most; longer texts are running text.
HEADING_WORDS = 14
# What begins a form, and what only goes on with it.
FORM_1099 = r"^(?:20\d{2}\s+)?(?:Form\s*)?1099\s*-\s*([A-Z]{1,4})\b"
FORM_1040 = r"(?i)^(?:Form\s*1040\b|U\.S\.\s+Individual\s+Income\s+Tax\s+Return\b)"
W2_NUMBER, W2_WAGES, W2_TITLE = r"(?i)Employee'?s\s+social\s+security\s+number", r"(?i)Wages,?\s+tips,?\s+other\s+comp", r"(?i)wage\s+and\s+tax\s+statement"
CONTINUED = r"(?i)\bcont(?:inued|'d)\b|\bpage\s+(?:[2-9]|\d{2,})\s+of\s+\d+\b"
BOX_NUMBER = r"^\d{1,2}[A-Za-z]?$"

_middle = lambda w: (w["x0"] + w["x1"]) / 2


def runs(words: Column) -> Column:
    """The texts of a row: words with no wide gap between them."""

    def cut(ws: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: (i == 0) | (F.get(ws, i)["x0"] - F.get(ws, i - 1)["x1"] > RUN_GAP))

        def parts(at: Column) -> Column:
            return F.transform(at, lambda s, k: F.slice(ws, s + 1, F.coalesce(F.get(at, k + 1), F.size(ws)) - s))

        return let(begins, parts)

    return F.when(F.size(words) > 0, let(words, cut))


def with_anchors(rows: DataFrame) -> DataFrame:
    """rows with `anchors`: (family, x0, x1) of the headings in each, from the left.

    A W-2 begins at the label of the employee's number; on a page without one at that of box 1, or else at its title.
    """
    found = F.transform(runs(F.col("words")), lambda r: F.struct(joined(r).alias("text"), r[0]["x0"].alias("x0"), F.element_at(r, -1)["x1"].alias("x1"), F.size(r).alias("n")))
    rows = rows.withColumn("_runs", F.filter(found, lambda r: ~r["text"].rlike(CONTINUED)))
    page = Window.partitionBy(*PAGE)
    has = lambda shape: F.max(F.exists("_runs", lambda r: r["text"].rlike(shape)).cast("int")).over(page) == 1
    w2 = F.when(has(W2_NUMBER), W2_NUMBER).when(has(W2_WAGES), W2_WAGES).otherwise(W2_TITLE)
    rows = rows.withColumn("_w2", w2)

    def family(r: Column) -> Column:
        short = r["n"] <= HEADING_WORDS
        number = F.lower(F.regexp_extract(r["text"], FORM_1099, 1))
        is_w2 = F.coalesce(*[F.when(F.col("_w2") == shape, r["text"].rlike(shape)) for shape in (W2_NUMBER, W2_WAGES, W2_TITLE)])
        return F.when(short & (number != ""), F.concat(F.lit("1099-"), number)).when(short & r["text"].rlike(FORM_1040), "1040").when(is_w2, "w2")

    named = F.transform("_runs", lambda r: F.struct(family(r).alias("family"), r["x0"].alias("x0"), r["x1"].alias("x1")))
    return rows.withColumn("anchors", F.filter(named, lambda a: a["family"].isNotNull())).drop("_runs", "_w2")


def free_stripes(words: Column, low: Column, high: Column) -> Column:
    """(a, b) of the vertical stripes between low and high that no word covers: a sweep over the words' extents from the left."""
    spans = F.array_sort(F.filter(F.transform(words, lambda w: F.struct(w["x0"].alias("a"), w["x1"].alias("b"))), lambda s: (s["b"] > low) & (s["a"] < high)))
    start = F.struct(low.alias("upto"), F.array().cast("array<struct<a: double, b: double>>").alias("free"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.array(F.struct(acc["upto"].alias("a"), F.least(s["a"], high).alias("b")))
        return F.struct(F.greatest(acc["upto"], s["b"]).alias("upto"), F.when(s["a"] > acc["upto"], F.concat(acc["free"], gap)).otherwise(acc["free"]).alias("free"))

    def ended(acc: Column) -> Column:
        return F.when(acc["upto"] < high, F.concat(acc["free"], F.array(F.struct(acc["upto"].alias("a"), high.alias("b"))))).otherwise(acc["free"])

    return F.filter(let(F.aggregate(spans, start, step), ended), lambda g: g["b"] - g["a"] >= STRIPE)


def cuts(anchors: Column, sample: Column) -> Column:
    """Where the forms of one row of headings part: in the stripe with most words on its lighter side; one just before the right heading counts half as much again."""

    def between(left: Column, k: Column) -> Column:
        right, after = F.get(anchors, k + 1), F.get(anchors, k + 2)["x0"]
        from_ = F.when(k == 0, F.lit(float("-inf"))).otherwise(left["x0"] - RUN_GAP)
        upto = F.coalesce(after - 10.0, F.lit(float("inf")))

        def best(own: Column) -> Column:
            def score(g: Column) -> Column:
                cut = (g["a"] + g["b"]) / 2
                on_left = F.size(F.filter(own, lambda w: _middle(w) < cut))
                mass = F.least(on_left, F.size(own) - on_left) * F.when(cut >= right["x0"] - 14.0, 1.5).otherwise(1.0)
                return F.struct(mass.alias("mass"), cut.alias("cut"))

            top = F.array_max(F.transform(free_stripes(sample, left["x0"] + 10.0, right["x0"] + 1.0), score))
            return let(top, lambda t: F.when(t["mass"] > 0, t["cut"]))

        apart = right.isNotNull() & (right["x0"] - left["x0"] >= APART)
        return F.when(apart, let(F.filter(sample, lambda w: (_middle(w) >= from_) & (_middle(w) < upto)), best))

    return F.array_sort(F.array_compact(F.transform(anchors, between)))


def straddles(words: Column, at: Column) -> Column:
    """Whether a word lies across one of the cuts."""
    return F.exists(words, lambda w: F.exists(at, lambda c: (w["x0"] < c - 0.5) & (w["x1"] > c + 0.5)))


def in_columns(rows: DataFrame, when: Column, at: Column) -> DataFrame:
    """Rows cut into columns where `when` holds, one row for each column with words; `path` gets the column's number."""
    column = lambda w: F.size(F.filter(at, lambda c: c <= _middle(w)))
    own = F.transform(F.sequence(F.lit(0), F.size(at)), lambda k: F.struct(k.cast("int").alias("k"), F.filter("words", lambda w: column(w) == k).alias("w")))
    parts = F.when(F.coalesce(when, F.lit(False)), F.filter(own, lambda p: F.size(p["w"]) > 0)).otherwise(F.array(F.struct(F.lit(0).alias("k"), F.col("words").alias("w"))))
    out = rows.withColumns({"_cut": F.coalesce(when, F.lit(False)), "_p": F.explode(parts)})
    return out.withColumns({"words": F.col("_p.w"), "path": F.concat("path", F.array("_p.k")), "open": F.col("open") & ~F.col("_cut")}).withColumn("text", joined(F.col("words"))).drop("_p", "_cut")


def by_headings(rows: DataFrame) -> DataFrame:
    """Rows below two or more headings side by side, in columns, down to the first row that lies across or the next such headings."""
    page = Window.partitionBy(*PAGE).orderBy("row_number")
    below = F.collect_list(F.struct("top", "words")).over(page.rowsBetween(0, SAMPLE_ROWS))
    sample = F.flatten(F.transform(F.filter(below, lambda r: r["top"] <= F.col("top") + SAMPLE_HEIGHT), lambda r: r["words"]))
    own = with_anchors(rows).withColumn("_sample", sample)
    own = own.withColumn("_own", F.when(F.size("anchors") > 1, let(F.col("_sample"), lambda s: cuts(F.col("anchors"), s)))).drop("_sample", "anchors")
    band = F.last(F.when(F.size("_own") > 0, F.struct(F.col("row_number").alias("row"), F.col("_own").alias("cuts"))), True).over(page)
    own = own.withColumn("_band", band).withColumn("_row", F.coalesce("_band.row", F.lit(-1)))
    across = F.coalesce(straddles(F.col("words"), F.col("_band.cuts")) & (F.col("row_number") > F.col("_row")), F.lit(False))
    over = F.max(across.cast("int")).over(Window.partitionBy(*PAGE, "_row").orderBy("row_number"))
    own = own.withColumn("_in", F.col("_band").isNotNull() & (over == 0))
    own = own.withColumns({"path": F.array(F.col("_row") * 2 + F.when(F.col("_in"), 0).otherwise(1)), "open": F.lit(True)})
    return in_columns(own, F.col("_in"), F.coalesce("_band.cuts", F.array().cast("array<double>"))).drop("_own", "_band", "_row", "_in")


def by_gutters(rows: DataFrame) -> DataFrame:
    """Open parts of a page in which rows agree on a gap between an amount and the next label, in two columns; what is above and below stays open."""
    part = Window.partitionBy(*PAGE, "path")
    ordered = part.orderBy("row_number")
    priced = lambda t: money_minor(t).isNotNull() & t.rlike(r"\d") & t.rlike(r"[.,$]|^\(")

    def vote(w: Column, i: Column) -> Column:
        b, after = F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2)["text"]
        label = b["text"].rlike(r"\p{L}") | (b["text"].rlike(BOX_NUMBER) & F.coalesce(after.rlike(r"^\p{L}"), F.lit(False)))
        return F.when(b.isNotNull() & priced(w["text"]) & (b["x0"] - w["x1"] >= GUTTER) & label & ~priced(b["text"]), (w["x1"] + b["x0"]) / 2)

    votes = F.when(F.col("open"), F.array_compact(F.transform("words", vote)))
    each = F.transform(votes, lambda x: F.struct(F.col("row_number").alias("row"), x.alias("x")))
    rows = rows.withColumns({"_all": F.flatten(F.collect_list(F.coalesce(each, F.array().cast("array<struct<row: int, x: double>>"))).over(part)), "_n": F.count("*").over(part), "_first": F.row_number().over(ordered) == 1})

    def chosen(all_: Column) -> Column:
        def support(v: Column) -> Column:
            near = F.filter(all_, lambda o: F.abs(o["x"] - v["x"]) <= GUTTER_NEAR)
            own = F.array_distinct(F.transform(near, lambda o: o["row"]))
            cut = F.aggregate(near, F.lit(0.0), lambda acc, o: acc + o["x"]) / F.size(near)
            return F.struct(F.size(own).alias("n"), (-v["row"]).alias("row"), cut.alias("cut"), own.alias("rows"))

        return F.array_max(F.transform(all_, support))

    best = F.when(F.col("_first") & (F.col("_n") >= GUTTER_LEAST) & (F.size("_all") >= GUTTER_ROWS), let(F.col("_all"), chosen))
    rows = rows.withColumn("_best", F.first(best, True).over(part)).drop("_all", "_first", "_n")
    at = F.array("_best.cut")
    clear = F.coalesce(~straddles(F.col("words"), at), F.lit(False))
    rows = rows.withColumn("_clear", clear).withColumn("_island", F.sum((~F.col("_clear")).cast("int")).over(ordered))
    island = Window.partitionBy(*PAGE, "path", "_island")
    agree = F.sum((F.col("_clear") & F.array_contains("_best.rows", F.col("row_number"))).cast("int")).over(island)
    rows = rows.withColumn("_agree", F.coalesce(agree, F.lit(0)))
    top = F.max(F.struct("_agree", -F.col("_island"))).over(part)
    rows = rows.withColumn("_in", F.col("_clear") & (F.col("_agree") >= GUTTER_ROWS) & (F.struct("_agree", -F.col("_island")) == top))
    after = F.max(F.when(F.col("_in"), F.col("row_number"))).over(part)
    place = F.when(F.col("_in"), 1).when(F.col("row_number") > after, 2).otherwise(0)
    rows = rows.withColumn("path", F.concat("path", F.array(place)))
    return in_columns(rows, F.col("_in"), at).drop("_best", "_clear", "_island", "_agree", "_in")


def laid_out(rows: DataFrame) -> DataFrame:
    """(file_sha256, page_number, row_number, words, text, top, family, form): rows in reading order, columns one after the other, with the form that each belongs to.

    rows are those of `words.rows_of`, cleaned or not. `form` counts the forms of a file, from 1; `family` is its kind (w2, 1040, 1099-...). A part of a page without a heading goes on with the form before it, or begins with the next
    one on its page; a file without any heading has null in both.
    """
    rows = by_headings(rows.select(*PAGE, "row_number", "words", "text", "top"))
    for _ in range(GUTTER_LEVELS):
        rows = by_gutters(rows)
    # Within a part, a new kind of form begins a region; lines close above its heading go with it.
    path = Window.partitionBy(*PAGE, "path").orderBy("row_number")
    rows = anchored_parts(rows)
    before = F.last("_family", True).over(path.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_new": F.col("_family").isNotNull() & before.isNotNull() & (F.col("_family") != before), "_gap": F.coalesce(F.col("top") - F.lag("top").over(path) > PREAMBLE, F.lit(False))})
    rows = rows.withColumn("_block", F.sum(F.col("_gap").cast("int")).over(path))
    ahead = Window.partitionBy(*PAGE, "path", "_block").orderBy("row_number").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("_next", F.first(F.when(F.col("_family").isNotNull(), F.struct("row_number", F.col("_new").alias("new"))), True).over(ahead))
    own = F.when(F.col("_next.new"), F.col("_next.row_number")).otherwise(F.coalesce(F.max(F.when(F.col("_new"), F.col("row_number"))).over(path), F.lit(-1)))
    rows = rows.withColumn("_region", own).drop("_next", "_new", "_gap", "_block")
    region = Window.partitionBy(*PAGE, "path", "_region")
    order = ("page_number", "path", "_region", "row_number")
    rows = rows.withColumn("_kind", F.first("_family", True).over(region.orderBy("row_number").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # Regions without a heading find their owner by the last and the next region with one.
    file = Window.partitionBy("file_sha256").orderBy(*order)
    mark = F.when(F.col("_kind").isNotNull(), F.struct(F.col("_kind").alias("kind"), F.col("page_number").alias("page")))
    last, after = F.last(mark, True).over(file), F.first(mark, True).over(file.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumns({"_last": last, "_after": after})
    forward = F.col("_kind").isNull() & F.col("_after").isNotNull() & (F.col("_last").isNull() | ((F.col("_after.page") == F.col("page_number")) & (F.col("_last.kind") != F.col("_after.kind"))))
    # A return goes on over its pages, each of which may name it again.
    seen = F.last("_family", True).over(file.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_heading", F.col("_heading") & ~F.coalesce((F.col("_family") == "1040") & (seen == "1040"), F.lit(False)))
    rows = rows.withColumns({"_forward": forward, "_begins": F.sum(F.col("_heading").cast("int")).over(file)})
    # Lines of a region above its first heading begin its form.
    first = F.min(F.when(F.col("_heading"), F.col("row_number"))).over(region)
    form = F.col("_begins") + (F.col("_forward") | F.coalesce(F.col("row_number") < first, F.lit(False))).cast("int")
    family = F.coalesce(F.when(F.col("_forward"), F.col("_after.kind")), F.col("_kind"), F.col("_last.kind"))
    rows = rows.withColumns({"form": F.when(family.isNotNull(), form), "family": family})
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("path", "_region", "row_number"))
    return rows.withColumn("row_number", number.cast("int")).select(*PAGE, "row_number", "words", "text", "top", "family", "form")


def anchored_parts(rows: DataFrame) -> DataFrame:
    """rows with `_family` of the first heading in each and `_heading`: whether the row begins a form."""
    found = with_anchors(rows).withColumn("_family", F.get("anchors", F.lit(0))["family"])
    return found.withColumn("_heading", F.col("_family").isNotNull()).drop("anchors")
