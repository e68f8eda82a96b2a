"""Readers of tax forms: from rows of words to forms, boxes and items; 1099-B totals; what follows from the lines of a 1040.

A file holds a few forms one below the other; forms side by side on a page are not told apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthledger.functions import privacy
from hearthledger.functions.columns import let
from hearthledger.functions.text import money_minor, squeezed
from hearthledger.operators import tax_estimate
from hearthledger.sources import tax_layout
from hearthledger.sources.words import joined

SEGMENT = ["file_sha256", "segment"]
_ORDER = ("page_number", "row_number")

# What begins each form.
HEADINGS = {
    "w2": r"(?i)wage\s+and\s+tax\s+statement",
    "1099-int": r"(?i)form\s*1099-int\b",
    "1099-div": r"(?i)form\s*1099-div\b",
    "1099-nec": r"(?i)form\s*1099-nec\b",
    "1099-misc": r"(?i)form\s*1099-misc\b",
    "1099-b": r"(?i)form\s*1099-b\b",
    "1040": r"(?i)u\.?s\.?\s+individual\s+income\s+tax\s+return",
}
# Of each form the boxes that are read: box, words of its label, category, whether it is a tax, whether a memo, whether a 0 counts.
BOXES = {
    "w2": (
        ("1", r"wages,?\s+tips,?\s+other\s+comp\w*", "salary_wages", False, False, True), ("2", r"federal\s+income\s+tax\s+withheld", "federal_income_tax_withheld", True, False, False),
        ("4", r"social\s+security\s+tax\s+withheld", "social_security_tax", True, False, False), ("6", r"medicare\s+tax\s+withheld", "medicare_tax", True, False, False),
        ("17", r"state\s+income\s+tax", "state_income_tax_withheld", True, False, False), ("19", r"local\s+income\s+tax", "local_income_tax_withheld", True, False, False),
    ),
    "1099-int": (
        ("1", r"(?:1|box\s*1)\s*[-:.]?\s*interest\s+income", "interest", False, False, True), ("3", r"interest\s+on\s+u\.?\s?s\.?\s+savings\s+bonds(?:\s+and\s+treas(?:ury|\.)?\s+obligations)?", "interest", False, False, False),
        ("8", r"tax-?\s?exempt\s+interest", "other", False, True, False), ("4", r"federal\s+income\s+tax\s+withheld", "federal_income_tax_withheld", True, False, False), ("17", r"state\s+tax\s+withheld", "state_income_tax_withheld", True, False, False),
    ),
    "1099-div": (
        ("1a", r"(?:total\s+)?ordinary\s+dividends", "ordinary_dividends", False, False, True), ("1b", r"qualified\s+dividends", "qualified_dividends", False, True, False),
        ("2a", r"total\s+capital\s+gain\s+distr\w*\.?", "long_term_capital_gain", False, False, False), ("12", r"exempt-interest\s+dividends", "other", False, True, False),
        ("4", r"federal\s+income\s+tax\s+withheld", "federal_income_tax_withheld", True, False, False), ("16", r"state\s+tax\s+withheld", "state_income_tax_withheld", True, False, False),
    ),
    "1099-nec": (
        ("1", r"nonemployee\s+compensation", "self_employment", False, False, True), ("4", r"federal\s+income\s+tax\s+withheld", "federal_income_tax_withheld", True, False, False), ("5", r"state\s+tax\s+withheld", "state_income_tax_withheld", True, False, False),
    ),
    "1099-misc": (
        ("1", r"rents", "other", False, False, False), ("2", r"royalties", "other", False, False, False), ("3", r"other\s+income", "other", False, False, False),
        ("4", r"federal\s+income\s+tax\s+withheld", "federal_income_tax_withheld", True, False, False), ("16", r"state\s+tax\s+withheld", "state_income_tax_withheld", True, False, False),
    ),
    "1099-oid": (
        ("1", r"original\s+issue\s+discount", "interest", False, False, True), ("2", r"other\s+periodic\s+interest", "interest", False, False, True), ("8", r"oid\s+on\s+u\.?\s?s\.?\s+treasury\s+obligations", "interest", False, False, True),
        ("4", r"federal\s+income\s+tax\s+withheld", "federal_income_tax_withheld", True, False, False),
    ),
    "1099-b": (
        ("4", r"federal\s+income\s+tax\s+withheld", "federal_income_tax_withheld", True, False, False), ("16", r"state\s+income\s+tax\s+withheld", "state_income_tax_withheld", True, False, False),
    ),
}
# Fixed value: what begins an account of a broker's statement.
ACCOUNT = r"(?i)^Account\s+(?:number|no\.?)\b"
#: The box without which a form cannot be stored.
REQUIRED = {"w2": "1", "1099-int": "1", "1099-div": "1a", "1099-nec": "1"}


# Fixed values, in points: gaps within a heading printed letter by letter, at most; how much wider than the middle gap one between words is; how near a sign stands to its amount.
GLYPH_GAP, WORD_GAP, SIGN_GAP = 12.0, 1.5, 8.0
#: Single letters in a row that are a heading printed letter by letter.
GLYPHS = 4
_AMOUNT = r"^\$?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{1,2})?$"
INSTRUCTIONS = r"(?i)^(?:form\s+\S+\s+)?(?:general\s+)?(?:instructions?|notice)\s+(?:for|to)\s+(?:the\s+)?(?:recipient|employee|payer|filer)s?\b"


def _merged(words: Column, goes_on) -> Column:
    """Words of a row, with each for which goes_on(words, i) holds stuck to the one before."""

    def parts(ws: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: (i == 0) | ~F.coalesce(goes_on(ws, i), F.lit(False)))
        stuck = lambda p: F.struct(p[0]["x0"].alias("x0"), F.element_at(p, -1)["x1"].alias("x1"), F.array_join(F.transform(p, lambda w: w["text"]), "").alias("text"))
        return let(begins, lambda at: F.transform(at, lambda b, k: let(F.slice(ws, b + 1, F.coalesce(F.get(at, k + 1), F.size(ws)) - b), stuck)))

    return F.when(F.size(words) > 0, let(words, parts)).otherwise(words)


def despaced(words: Column) -> Column:
    """Words of a row, with runs of single letters as words: they part where a gap is wider than the run's middle one."""
    single = lambda w: F.length(w["text"]) == 1
    gap = lambda ws, i: F.get(ws, i)["x0"] - F.get(ws, i - 1)["x1"]

    def spelt(run: Column) -> Column:
        gaps = F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(F.size(run) - 1, F.lit(1))), lambda i: gap(run, i)))
        middle = let(gaps, lambda g: F.get(g, F.floor((F.size(g) - 1) / 2).cast("int")))
        letters = F.size(F.filter(run, lambda w: w["text"].rlike(r"^[\p{L}\d]$"))) * 2 > F.size(run)
        is_spelt = (F.size(run) >= GLYPHS) & letters & F.forall(run, single)
        return F.when(is_spelt, let(middle, lambda m: _merged(run, lambda ws, i: gap(ws, i) <= m * WORD_GAP))).otherwise(run)

    def runs(ws: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: (i == 0) | ~(single(F.get(ws, i)) & single(F.get(ws, i - 1)) & (gap(ws, i) <= GLYPH_GAP)))
        return let(begins, lambda at: F.flatten(F.transform(at, lambda b, k: let(F.slice(ws, b + 1, F.coalesce(F.get(at, k + 1), F.size(ws)) - b), spelt))))

    return F.when(F.size(words) > 0, let(words, runs)).otherwise(words)


def glued(words: Column) -> Column:
    """Words of a row, with signs and brackets at their amounts (`( 1,234.56 )`, `- 5.00`) and the letters of a 1099 at its number."""

    def goes_on(ws: Column, i: Column) -> Column:
        t = lambda k: F.get(ws, i + k)["text"]
        gap = lambda k: F.get(ws, i + k)["x0"] - F.get(ws, i + k - 1)["x1"]
        near = gap(0) < SIGN_GAP
        opened = (t(-1) == "(") & t(0).rlike(_AMOUNT) & (t(1) == ")") & (gap(1) < SIGN_GAP)
        closed = (t(0) == ")") & t(-1).rlike(_AMOUNT) & (t(-2) == "(") & (gap(-1) < SIGN_GAP)
        signed = t(-1).isin("-", "\u2212", "\u2013") & t(0).rlike(_AMOUNT) & ((i == 1) | (gap(-1) > gap(0) + 0.5))
        suffix = t(-1).endswith("1099") & (t(0).rlike(r"^-[A-Z]{1,4}$") | ((t(0) == "-") & t(1).rlike(r"^[A-Z]{1,4}$")))
        letters = t(0).rlike(r"^[A-Z]{1,4}$") & (t(-1) == "-") & t(-2).endswith("1099")
        return near & F.coalesce(opened | closed | signed | suffix | letters, F.lit(False))

    return _merged(words, goes_on)


def without_instructions(rows: DataFrame) -> DataFrame:
    """rows without instructions: from their heading to the next row with an amount or the end of the page, and later pages of a file that have no amount."""
    page = Window.partitionBy("file_sha256", "page_number")
    ordered = page.orderBy("row_number")
    priced = F.exists("words", lambda w: w["text"].rlike(r"\d[.,]\d") & money_minor(w["text"]).isNotNull())
    rows = rows.withColumns({"_i": F.col("text").rlike(INSTRUCTIONS), "_a": priced})
    rows = rows.withColumns({"_block": F.sum(F.col("_i").cast("int")).over(ordered), "_prose": F.max(F.col("_a").cast("int")).over(page) == 0})
    since = F.max(F.col("_a").cast("int")).over(Window.partitionBy("file_sha256", "page_number", "_block").orderBy("row_number"))
    told = F.max(F.col("_i").cast("int")).over(Window.partitionBy("file_sha256").orderBy("page_number").rangeBetween(Window.unboundedPreceding, -1)) == 1
    rows = rows.withColumn("_out", ((F.col("_block") > 0) & (since == 0)) | (F.coalesce(told, F.lit(False)) & F.col("_prose")))
    return rows.where("not _out").drop("_i", "_a", "_block", "_prose", "_out")


def normalised(rows: DataFrame) -> DataFrame:
    """rows as the readers of forms want them: letter-spaced headings as words, signs at their amounts, no instructions, cleaned."""
    own = rows.withColumn("words", glued(despaced(F.col("words")))).withColumn("text", joined(F.col("words")))
    return cleaned(without_instructions(own))


def cleaned(rows: DataFrame) -> DataFrame:
    """rows without unreadable glyphs, dotted leaders and the header that a page repeats from the one before, unless it begins a form."""
    text = F.regexp_replace(F.regexp_replace("text", r"\(cid:\d+\)", ""), r"(?:\s*\.){3,}\s*", " ")
    words = F.filter("words", lambda w: ~w["text"].rlike(r"^(?:\(cid:\d+\)|\.+)+$"))
    out = rows.withColumns({"text": squeezed(text), "words": words})
    top = F.row_number().over(Window.partitionBy("file_sha256", "page_number").orderBy("row_number")) == 1
    begins = F.col("text").rlike("|".join(f"(?:{shape})" for shape in (*HEADINGS.values(), tax_layout.W2_NUMBER, ACCOUNT)))
    sign = F.when(top & ~begins, F.regexp_replace("text", r"\d+", "#"))
    tops = out.withColumn("_sign", sign)
    before = F.last(F.when(F.col("_sign").isNotNull(), F.col("_sign")), True).over(Window.partitionBy("file_sha256").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1))
    return tops.withColumn("_again", F.col("_sign").isNotNull() & F.col("_sign").eqNullSafe(before)).where("not _again").drop("_sign", "_again")


def segments(rows: DataFrame) -> DataFrame:
    """rows with `segment` (a form's place in its file, from 1) and `form_type`; a heading that says it is continued begins none, and what stands before the first is left out."""
    heading = F.coalesce(*[F.when(F.col("text").rlike(shape), name) for name, shape in HEADINGS.items()])
    heading = F.when(~F.col("text").rlike(r"(?i)\bcont(?:inued|'d)\b|\bpage\s+(?:[2-9]|\d{2,})\s+of\s+\d+\b"), heading)
    w = Window.partitionBy("file_sha256").orderBy(*_ORDER)
    marked = rows.withColumn("_h", heading)
    return marked.withColumns({"segment": F.count("_h").over(w), "form_type": F.last("_h", True).over(w)}).where("segment > 0").drop("_h")


def years(rows: DataFrame) -> DataFrame:
    """(file_sha256, tax_year): the year printed most often in the first of two ways that is found at all, the earliest of equals."""
    year = r"(20\d{2})"
    tiers = (
        (rf"(?i)\btax\s+year\s*[:\-]?\s*{year}\b", rf"(?i)\bfor\s+(?:the\s+)?(?:calendar\s+)?year\s+(?:ending\s+)?(?:dec(?:ember)?\.?\s*31,?\s*)?{year}\b"),
        (rf"(?i)\b{year}\s+form\s+(?:w-?2|1099|1040)\b", rf"(?i)\bform\s+(?:w-?2|1099(?:-[a-z]{{1,4}})?|1040)\s*\(?\s*{year}\b", rf"(?i)\bwage\s+and\s+tax\s+statement\s*[:\-]?\s*{year}\b", rf"(?i)\bindividual\s+income\s+tax\s+return\s*[:\-]?\s*{year}\b"),
    )
    hits = [F.transform(F.regexp_extract_all("text", F.lit(p), 1), _tiered(i)) for i, tier in enumerate(tiers) for p in tier]
    each = rows.select("file_sha256", *_ORDER, F.explode(F.flatten(F.array(*hits))).alias("_y"))
    counts = each.groupBy("file_sha256", "_y.tier", "_y.year").agg(F.count("*").alias("n"), F.min(F.struct(*_ORDER)).alias("at"))
    return counts.groupBy("file_sha256").agg(F.min_by("year", F.struct("tier", -F.col("n"), "at")).cast("int").alias("tax_year"))


def _tiered(tier: int):
    return lambda y: F.struct(F.lit(tier).alias("tier"), y.alias("year"))


def amount_after(text: Column, label: str) -> Column:
    """The first amount behind a label in its row; the numbers of boxes do not count."""
    rest = F.split(F.trim(F.regexp_extract(text, f"(?i){label}(.*)$", 1)), " ")
    found = F.filter(rest, lambda t: ~t.rlike(r"^\d{1,2}[a-z]?$") & money_minor(t).isNotNull())
    return money_minor(F.get(found, F.lit(0)))


def boxes(rows: DataFrame, forms: Sequence[str] = tuple(BOXES)) -> DataFrame:
    """(file_sha256, segment, form_type, box, amount_minor): of each box the first amount in its label's row, else that of the row below nearest to the label.

    rows have segments; of `forms` all others are left out. All labels of a form are searched in one pass over its rows.
    """
    w = Window.partitionBy(*SEGMENT).orderBy(*_ORDER)
    below = F.lead("words").over(w)

    def at(form: str, box: str, label: str) -> Column:
        here = (F.col("form_type") == form) & F.col("text").rlike(f"(?i){label}")
        same = amount_after(F.col("text"), f"(?:{label})")
        # Where the label begins: as many words into the row as stand before it.
        place = F.size(F.split(F.regexp_extract("text", f"(?i)^(.*?)(?:{label})", 1), " ")) - 1
        x = F.get("words", place)["x0"]
        near = F.array_min(F.transform(F.filter("_below", lambda v: money_minor(v["text"]).isNotNull() & ~v["text"].rlike(r"^\d{1,2}$")), lambda v: F.struct(F.abs(v["x0"] - x).alias("d"), money_minor(v["text"]).alias("v"))))
        under = let(near, lambda n: F.when(n["d"] <= 60, n["v"]))
        return F.when(here, F.struct(F.lit(box).alias("box"), F.abs(F.coalesce(same, under)).alias("amount_minor")))

    marks = [at(form, box, label) for form in forms for box, label, *_ in BOXES[form]]
    found = rows.withColumn("_below", below).select(*SEGMENT, "form_type", *_ORDER, F.explode(F.array_compact(F.array(*marks))).alias("_b"))
    first = F.min_by("_b.amount_minor", F.struct(*_ORDER))
    return found.where("_b.amount_minor is not null").groupBy(*SEGMENT, "form_type", F.col("_b.box").alias("box")).agg(first.alias("amount_minor"))


def box_table(spark) -> DataFrame:
    rows = [(form, box, category, tax, memo, zero) for form, known in BOXES.items() for box, _, category, tax, memo, zero in known]
    return spark.createDataFrame(rows, "form_type string, box string, category string, is_tax boolean, is_memo boolean, keeps_zero boolean")


def items(read: DataFrame) -> DataFrame:
    """(…, category, is_tax, is_memo, box, amount_minor) of boxes; a 0 is dropped where it says nothing."""
    return read.join(F.broadcast(box_table(read.sparkSession)), ["form_type", "box"]).where("keeps_zero or amount_minor <> 0").drop("keeps_zero")


def identities(rows: DataFrame) -> DataFrame:
    """(file_sha256, segment, form_type, payer_name, payer_tin_last4, account_last4, is_corrected, is_copy) of forms."""
    said = lambda label: F.regexp_extract("text", rf"(?i){label}\s*[:#]?\s*(.+)$", 1)
    first = lambda value: F.min_by(value, F.when(value.isNotNull(), F.struct(*_ORDER)))
    name = privacy.payer_name(F.nullif(said(r"(?:payer|employer)'?s?\s+name"), F.lit("")))
    number = privacy.last_four(said(r"(?:payer'?s?\s+(?:federal\s+)?(?:tin|identification\s+number)|employer\s+identification\s+number)"))
    account = privacy.last_four(said(r"account\s+number"))
    return rows.groupBy(*SEGMENT, "form_type").agg(
        first(name).alias("payer_name"), first(number).alias("payer_tin_last4"), first(account).alias("account_last4"),
        F.max(F.col("text").rlike(r"(?i)\[x\]\s*corrected\b|^\s*corrected\s*$")).alias("is_corrected"), F.max(F.col("text").rlike(r"(?i)\bcopy\s+(?:a|b|c|d|1|2)\b")).alias("is_copy"),
    )


def incomplete(forms: DataFrame, read: DataFrame) -> DataFrame:
    """Forms whose required box has no value: they become warnings, and a file of nothing else an error (`alone`)."""
    need = F.create_map(*[F.lit(x) for kv in REQUIRED.items() for x in kv])[F.col("form_type")]
    wanted = forms.withColumn("box", need)
    bad = wanted.where("box is not null").join(read.select(*SEGMENT, "box"), [*SEGMENT, "box"], "left_anti").select(*SEGMENT, "form_type")
    sizes = forms.groupBy("file_sha256").agg(F.count("*").alias("_all"))
    here = F.count("*").over(Window.partitionBy("file_sha256"))
    return bad.withColumn("_bad", here).join(sizes, "file_sha256").select(*SEGMENT, "form_type", (F.col("_bad") == F.col("_all")).alias("alone"))


def detection(rows: DataFrame) -> DataFrame:
    """(file_sha256, form_type): the form that most headings of a file are of, null without any; of equals the first in order."""
    seen = segments(rows).select(*SEGMENT, "form_type").distinct()
    order = F.array_position(F.array(*[F.lit(k) for k in HEADINGS]), F.col("form_type"))
    counts = seen.groupBy("file_sha256", "form_type").agg(F.count("*").alias("n")).withColumn("_o", order)
    best = counts.groupBy("file_sha256").agg(F.min_by("form_type", F.struct(-F.col("n"), F.col("_o"))).alias("form_type"))
    return rows.select("file_sha256").distinct().join(best, "file_sha256", "left")


# Sources of a term's total, the most trusted first.
SOURCES = ("summary", "net", "subtotal", "recap", "trades")


def term_totals(rows: DataFrame) -> DataFrame:
    """(file_sha256, segment, term, gain_minor, source, off_minor) of 1099-B forms, from one source for each term.

    A summary row has proceeds, cost, wash sales and gain; then net lines, subtotals of categories, recaps, and last the trades (two dates and three
    amounts or more) below a term's heading. A label printed twice counts once, with its last value; different labels add up. off_minor is what
    gain differs by from proceeds - cost + wash sales, where these are known.
    """
    text = F.trim("text")
    tokens = F.split(text, " ")
    # Of a trade only what stands after its dates.
    tail = F.split(F.regexp_replace(text, r"^.*\d{1,2}/\d{1,2}/\d{2,4}\s+", ""), " ")
    amounts = F.filter(F.transform(tail, money_minor), lambda v: v.isNotNull())
    dated = F.size(F.filter(tokens, lambda t: t.rlike(r"^\d{1,2}/\d{1,2}/\d{2,4}$")))
    rows = rows.where("form_type = '1099-b'").withColumns({"_m": amounts, "_d": dated, "_label": F.lower(F.array_join(F.filter(tokens, lambda t: money_minor(t).isNull()), " "))})
    term = lambda shape: F.lower(F.regexp_extract(text, shape, 1))
    start, net, sub, recap = r"(?i)^(short|long)[- ]term\b", r"(?i)^net\s+(short|long)[- ]term\b", r"(?i)^(?:sub)?total\s+(short|long)[- ]term\b", r"(?i)^(?:total\s+)?realized\s+(short|long)[- ]term\b"
    n = F.size("_m")
    w = Window.partitionBy(*SEGMENT).orderBy(*_ORDER)
    heads = F.when((F.col("_d") == 0) & text.rlike(start) & (n < 4), term(start)).when((F.col("_d") == 0) & text.rlike(r"(?i)^(grand\s+total|supplementary)"), "")
    rows = rows.withColumn("_term", F.last(heads, True).over(w))
    last = F.try_element_at("_m", F.lit(-1))
    kind = (
        F.when((F.col("_d") == 0) & text.rlike(start) & (n >= 4), F.struct(F.lit(0).alias("k"), term(start).alias("term")))
        .when((F.col("_d") == 0) & text.rlike(net) & (n > 0), F.struct(F.lit(1).alias("k"), term(net).alias("term")))
        .when((F.col("_d") == 0) & text.rlike(sub) & (n > 0), F.struct(F.lit(2).alias("k"), term(sub).alias("term")))
        .when((F.col("_d") == 0) & text.rlike(recap) & (n == 1), F.struct(F.lit(3).alias("k"), term(recap).alias("term")))
        .when((F.col("_d") >= 2) & (n >= 3) & (F.col("_term") != ""), F.struct(F.lit(4).alias("k"), F.col("_term").alias("term")))
    )
    four = lambda i: F.when(F.size("_m") >= 4, F.try_element_at("_m", F.lit(i))).otherwise(F.lit(0))
    proceeds = F.when(F.col("_k.k") == 0, four(-4)).otherwise(F.get("_m", F.lit(0)))
    cost = F.when(F.col("_k.k") == 0, four(-3)).otherwise(F.get("_m", F.lit(1)))
    known = rows.withColumn("_k", kind).where("_k is not null").select(*SEGMENT, "_k.*", *_ORDER, "_label", last.alias("gain"), proceeds.alias("p"), cost.alias("c"), four(-2).alias("w"))
    # Labels of sums count once; summaries and trades are rows of their own.
    named = F.when(F.col("k").isin(1, 2, 3), F.col("_label")).otherwise(F.concat_ws("/", F.col("page_number").cast("string"), F.col("row_number").cast("string")))
    once = known.groupBy(*SEGMENT, "k", "term", named.alias("_l")).agg(F.max_by(F.struct("gain", "p", "c", "w"), F.struct(*_ORDER)).alias("v"))
    sums = once.groupBy(*SEGMENT, "term", "k").agg(F.sum("v.gain").alias("gain"), F.sum(F.col("v.p") - F.col("v.c") + F.col("v.w")).alias("told"))
    best = sums.groupBy(*SEGMENT, "term").agg(F.min_by(F.struct("k", "gain", "told"), "k").alias("b"))
    source = F.lit(list(SOURCES))[F.col("b.k")]
    return best.select(*SEGMENT, "term", F.col("b.gain").alias("gain_minor"), source.alias("source"), F.when(F.col("b.k").isin(0, 4), F.col("b.gain") - F.col("b.told")).alias("off_minor"))


# Lines of a 1040 that are used, as columns of minor units; null where a line was not read.
LINES = (
    "wages", "wages_1a", "taxable_interest", "ordinary_dividends", "qualified_dividends", "ira_taxable", "pension_taxable", "ss_taxable", "capital_gain", "other_income", "total_income", "d_short_term", "d_long_term",
    "d_combined", "business", "taxable_income", "income_tax", "total_tax", "withheld_total", "withheld_w2", "withheld_1099", "withheld_other", "estimated_payments", "total_payments", "overpaid", "refunded", "applied", "owed",
)
#: Differences of a dollar come from rounding.
DOLLAR = 100


def return_items(lines: DataFrame) -> DataFrame:
    """lines with the figures of a 1040: income by category, taxes, refund received, and warnings.

    Schedule D decides gains where it was read, else line 7 is long-term. A business loss does not count. Withholding is line 25d, else the sum of
    its parts. A refund is line 35a, else what line 34 leaves after line 36.
    """
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    has_d = F.col("d_short_term").isNotNull() | F.col("d_long_term").isNotNull()
    business = F.greatest(z("business"), F.lit(0))
    other = z("ira_taxable") + z("pension_taxable") + z("ss_taxable") + F.when(F.col("other_income").isNotNull(), F.greatest(F.col("other_income") - business, F.lit(0))).otherwise(0)
    wages = F.coalesce("wages", "wages_1a")
    parts = [F.col(c) for c in ("withheld_w2", "withheld_1099", "withheld_other")]
    withheld = F.coalesce("withheld_total", F.when(F.coalesce(*parts).isNotNull(), z("withheld_w2") + z("withheld_1099") + z("withheld_other")))
    refund = F.coalesce("refunded", F.greatest(F.col("overpaid") - z("applied"), F.lit(0)))
    reported = sum((z(c) for c in ("taxable_interest", "ordinary_dividends", "ira_taxable", "pension_taxable", "ss_taxable", "capital_gain", "other_income")), F.coalesce(wages, F.lit(0)))
    over = F.coalesce("overpaid", F.when(F.col("refunded").isNotNull() | F.col("applied").isNotNull(), z("refunded") + z("applied")))
    over0 = F.coalesce(over, F.lit(0))
    diff = F.col("total_payments") - F.col("total_tax")
    far = lambda x: F.coalesce(F.abs(x) > DOLLAR, F.lit(False))
    warnings = [
        F.when(F.col("business") < 0, "business loss reported; it is not included in income items"), F.when(far(reported - F.col("total_income")), "sum of income lines does not match the printed total income"),
        F.when((over0 > 0) & (z("owed") > 0), "both a refund and an amount owed are printed"),
        F.when(far(over - F.col("refunded") - z("applied")), "refund and amount applied to next year do not add up to the overpayment"),
        F.when(far(over0 - F.greatest(diff, F.lit(0))) & diff.isNotNull() | far(z("owed") - F.greatest(-diff, F.lit(0))) & diff.isNotNull(), "refund or amount owed does not match total payments minus total tax"),
    ]
    not_zero = lambda c: F.when(c != 0, c)
    return lines.withColumns({
        "salary_wages": not_zero(wages), "interest": not_zero(F.col("taxable_interest")), "short_term_capital_gain": F.when(has_d, not_zero(F.col("d_short_term"))),
        "long_term_capital_gain": F.when(has_d, not_zero(F.col("d_long_term"))).otherwise(not_zero(F.col("capital_gain"))), "self_employment": not_zero(business), "other": not_zero(other),
        "federal_income_tax_withheld": not_zero(withheld), "refund": not_zero(refund), "amount_owed": not_zero(F.col("owed")), "warnings": F.array_compact(F.array(*warnings)),
    })


def return_split(lines: DataFrame) -> DataFrame:
    """lines (with tax_year and filing_status) with the split of line 16 between ordinary and preferential rates; the gain is the lesser of Schedule D's lines 15 and 16, else line 7."""
    gain = F.when(F.col("d_long_term").isNotNull(), F.least("d_long_term", F.coalesce("d_combined", "d_long_term"))).otherwise(F.coalesce("capital_gain", F.lit(0)))
    ready = lines.withColumns({"net_ltcg_minor": F.greatest(gain, F.lit(0)), "qualified_minor": F.coalesce("qualified_dividends", F.lit(0)), "taxable_minor": F.col("taxable_income"), "income_tax_minor": F.col("income_tax")})
    return tax_estimate.split(ready).drop("net_ltcg_minor", "qualified_minor", "taxable_minor", "income_tax_minor")
