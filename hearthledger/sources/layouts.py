"""Readers of statements: from rows of words to transactions, one expression over a file's rows for each layout.

A statement is one file of some pages, so windows by file are bounded. Each reader returns rows (file_sha256, ordinal, posted_date,
transaction_date, description_raw, amount_minor, section, kind_hint, issuer_category, fx_amount_minor, fx_currency, fx_rate, balance_minor, error); what a row gets wrong
stands in `error` instead of ending the run.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthledger.functions import dates
from hearthledger.functions.columns import let
from hearthledger.functions.text import money_minor, squeezed
from hearthledger.sources.tables import kept
from hearthledger.sources.words import PAGE, bands, cells, header_starts, joined, nested, tables_of, unnested

FX = "struct<fx_amount_minor: bigint, fx_currency: string, fx_rate: double>"
_FIELDS = {
    "posted_date": "date", "transaction_date": "date", "amount_minor": "bigint", "section": "string", "kind_hint": "string", "issuer_category": "string", "balance_minor": "bigint", "error": "string",
}
_ORDER = ("page_number", "row_number")


def summaries(rows: DataFrame) -> DataFrame:
    """(file_sha256, text, period_start, period_end, opening_balance_minor, closing_balance_minor): what a statement's head says; null where it does not."""
    return _said(nested(rows.select("file_sha256", *_ORDER, "text"), ["file_sha256"], _ORDER)).drop("group")


def _said(files: DataFrame) -> DataFrame:
    """files (file_sha256, group) with their text, period and balances."""
    text = files.withColumn("text", F.array_join("group.text", "\n"))
    date, name = r"(\d{1,2}/\d{1,2}/\d{2,4})", r"([A-Za-z]+ \d{1,2},? \d{4})"
    # How a period and balances are printed.
    periods = (
        rf"(?is)(?:Opening|Statement|Billing)\s*(?:Closing)?\s*Date[:\s]*[-]?\s*{date}.{{0,60}}?(?:Closing|Closing\s*Date)[:\s]*[-]?\s*{date}",
        rf"(?i){name}\s*(?:through|to|-)\s*{name}", rf"(?i){date}\s*(?:through|to|-)\s*{date}",
    )
    plain, signed = r"[:\s]*\$?\s*([\d,]+\.\d{2})", r"[:\s]*\$?\s*(\(?-?[\d,]+\.\d{2}\)?)"
    balances = (("Previous Balance", "New Balance", plain), ("Beginning Balance", "Ending Balance", signed))
    pairs = [F.struct(dates.full(F.regexp_extract("text", p, 1)).alias("a"), dates.full(F.regexp_extract("text", p, 2)).alias("b")) for p in periods]
    period = F.coalesce(*[F.when(p["a"].isNotNull() & p["b"].isNotNull(), p) for p in pairs])
    got = lambda label, shape: F.regexp_extract("text", f"(?i){label}{shape}", 1)
    money = [F.when((got(a, s) != "") & (got(b, s) != ""), F.struct(money_minor(got(a, s)).alias("a"), money_minor(got(b, s)).alias("b"))) for a, b, s in balances]
    out = text.withColumns({"_p": period, "_b": F.coalesce(*money)})
    return out.select("file_sha256", "group", "text", F.col("_p.a").alias("period_start"), F.col("_p.b").alias("period_end"), F.col("_b.a").alias("opening_balance_minor"), F.col("_b.b").alias("closing_balance_minor"))


def folded(rows: DataFrame, across: bool = False) -> DataFrame:
    """Transactions of marked rows: each `_txn` (null for other rows) with the texts `_more` and the last `_fx` of the rows after it, up to the next.

    `_block` parts sections, beyond which nothing goes on unless `across`. Rows before a block's first transaction are left out.
    """
    by_file = Window.partitionBy("file_sha256").orderBy(*_ORDER)
    starts = F.col("_txn").isNotNull()
    count = F.sum(starts.cast("int")).over(by_file)
    own = rows.withColumn("ordinal", count)
    if not across:
        first = F.min(F.when(starts, F.col("ordinal"))).over(Window.partitionBy("file_sha256", "_block"))
        own = own.withColumn("_first", first).where(F.col("ordinal") >= F.col("_first"))
    own = own.where("ordinal > 0")
    at = F.struct(*_ORDER)
    parts = F.array_sort(F.collect_list(F.when(F.coalesce("_more", F.lit("")) != "", F.struct(*_ORDER, F.col("_more").alias("t")))))
    grouped = own.groupBy("file_sha256", "ordinal").agg(F.min_by("_txn", F.when(starts, at)).alias("_txn"), F.max_by("_fx", F.when(F.col("_fx").isNotNull(), at)).alias("_fx"), parts.alias("_parts"))
    description = squeezed(F.array_join(F.transform("_parts", lambda p: p["t"]), " "))
    return grouped.select("file_sha256", "ordinal", *[F.col(f"_txn.{c}").alias(c) for c in _FIELDS], description.alias("description_raw"), "_fx.fx_amount_minor", "_fx.fx_currency", "_fx.fx_rate")


def _txn(when: Column, **values: Column) -> Column:
    return F.when(when, F.struct(*[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in _FIELDS.items()]))


def _fx(text: Column, shape: str, amount: int = 1, currency: int = 2, rate: int = 3) -> Column:
    got = lambda k: F.regexp_extract(text, shape, k)
    found = F.struct(money_minor(got(amount)).alias("fx_amount_minor"), F.upper(got(currency)).alias("fx_currency"), F.when(got(rate) != "", got(rate).try_cast("double")).alias("fx_rate"))
    return F.when(text.rlike(shape), found)


def _per_file(rows: DataFrame) -> Window:
    return Window.partitionBy("file_sha256").orderBy(*_ORDER)


def _with_period(rows: DataFrame) -> DataFrame:
    """rows with period and balances of their files; a file's rows are brought together once."""
    return unnested(_said(nested(rows, ["file_sha256"], _ORDER)).drop("text"))


# Headings of the sections of layout A, and the words above its columns.
A_SECTIONS = {"payments and other credits": "Payments and Other Credits", "purchases and adjustments": "Purchases and Adjustments", "fees": "Fees", "interest charged": "Interest Charged"}
A_WORDS = (0, 2, 4, 5, 7, 9, 10)
A_COLUMNS = 11
A_FX = r"^([\d,]+\.\d{2})\s+([A-Z]{3})(?:\s*[Xx@]\s*([\d.]+))?\s*$"
A_TOTAL = r"(?i)^TOTAL\s+(.+?)\s+FOR THIS PERIOD\b\s*(.*)$"


def layout_a(rows: DataFrame) -> DataFrame:
    """Sections with totals, two dates a row, columns that begin where the words above them do."""
    w = _per_file(rows)
    low = F.lower(F.trim("text"))
    is_header = low.contains("reference number") & low.contains("account number")
    header = F.first(F.when(is_header, F.struct(*_ORDER, "words")), True).over(w)
    marked = rows.withColumn("_h", header).where("_h is not null").withColumn("_starts", F.array(*[F.get(F.col("_h.words"), F.lit(i))["x0"] for i in A_WORDS]))
    after = F.struct(*_ORDER) > F.struct("_h.page_number", "_h.row_number")
    marked = marked.where((F.size("_h.words") == A_COLUMNS) & after)
    heading = F.create_map(*[F.lit(x) for kv in A_SECTIONS.items() for x in kv])[low]
    ends = F.col("text").rlike(A_TOTAL)
    marked = marked.withColumns({"_mark": F.when(ends, "").otherwise(heading), "_ends": ends})
    marked = marked.withColumns({"section": F.last("_mark", True).over(w), "_block": F.count("_mark").over(w)}).where("section <> '' and _mark is null")
    marked = marked.withColumn("_c", cells(F.col("words"), F.col("_starts")))
    cell = lambda i: F.col("_c")[i]
    amount, posted = money_minor(cell(5)), dates.full(cell(1))
    fx = _fx(F.trim("text"), A_FX)
    hint = (
        F.when(F.col("section") == "Payments and Other Credits", "payment_or_refund").when(F.col("section") == "Fees", "fee").when(F.col("section") == "Interest Charged", "interest")
        .otherwise(F.when(amount < 0, "adjustment").otherwise("purchase"))
    )
    data = (cell(5) != "") & fx.isNull()
    error = F.when(amount.isNull(), "unparseable amount").when(posted.isNull(), "unparseable posting date")
    txn = _txn(data, posted_date=posted, transaction_date=dates.full(cell(0)), amount_minor=amount, section=F.col("section"), kind_hint=hint, error=error)
    return folded(marked.withColumns({"_txn": txn, "_fx": fx, "_more": F.when(fx.isNull(), cell(2))}))


def a_totals(rows: DataFrame) -> DataFrame:
    """(file_sha256, section, printed_minor): the totals that layout A prints under its sections."""
    w = _per_file(rows)
    heading = F.create_map(*[F.lit(x) for kv in A_SECTIONS.items() for x in kv])[F.lower(F.trim("text"))]
    ends = F.col("text").rlike(A_TOTAL)
    found = rows.withColumn("_mark", F.when(ends, "").otherwise(heading)).withColumn("section", F.last("_mark", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return found.where(ends & (F.col("section") != "")).select("file_sha256", "section", money_minor(F.regexp_extract("text", A_TOTAL, 2)).alias("printed_minor"))


# Fixed values of layout C.
C_FX = r"^FX\s+([\d,]+\.\d{2})\s+([A-Z]{3})(?:\s+RATE\s+(\d+(?:\.\d+)?))?$"
C_PAYMENTS = ("PAYMENTS", "CREDITS", "CREDIT")


def layout_c(rows: DataFrame) -> DataFrame:
    """Rows of column names that come again for each section: they name it and place its columns; one has the issuer's own category."""
    rows = _with_period(rows)
    w = _per_file(rows)
    names = F.transform("words", lambda x: F.upper(F.regexp_replace(x["text"], r"\.+$", "")))
    n = F.size("words")
    has_category = (F.get(names, n - 3) == "MERCHANT") & (F.get(names, n - 2) == "CATEGORY")
    own = F.slice("words", 3, F.greatest(n - 3 - F.when(has_category, 2).otherwise(0), F.lit(0)))
    is_header = (n > 3) & (F.get(names, F.lit(0)) == "TRANS") & (F.get(names, F.lit(1)) == "DATE") & (F.get(names, n - 1) == "AMOUNT") & (F.size(own) > 0)
    x = lambda i: F.get("words", i)["x0"]
    starts = F.array_compact(F.array(x(F.lit(0)), x(F.lit(2)), F.when(has_category, x(n - 3)), x(n - 1)))
    header = F.when(is_header, F.struct(joined(own).alias("section"), starts.alias("starts"), has_category.alias("category")))
    marked = rows.withColumn("_h0", header).withColumns({"_h": F.last("_h0", True).over(w), "_block": F.count("_h0").over(w)}).where("_h is not null and _h0 is null")
    marked = marked.withColumn("_c", cells(F.col("words"), F.col("_h.starts")))
    amount, date, description = money_minor(F.element_at("_c", -1)), F.col("_c")[0], F.col("_c")[1]
    posted = dates.in_period(dates.parts(date), F.col("period_start"), F.col("period_end"))
    data = amount.isNotNull() & (date != "")
    fragment = F.when(description != "", description).otherwise(F.trim("text"))
    fx = F.when(~data, _fx(fragment, C_FX))
    words = F.transform(F.split(F.upper("_h.section"), " "), lambda t: F.regexp_replace(t, r"\.+$", ""))
    hint = F.when(F.arrays_overlap(words, F.array(*[F.lit(p) for p in C_PAYMENTS])), "payment_or_refund").otherwise("purchase")
    error = F.when(dates.parts(date).isNull(), "unparseable date").when(posted.isNull(), "date out of period")
    label = F.when(F.col("_h.category") & (F.col("_c")[2] != ""), F.col("_c")[2])
    txn = _txn(data, posted_date=posted, amount_minor=amount, section=F.col("_h.section"), kind_hint=hint, issuer_category=label, error=error)
    out = folded(marked.withColumns({"_txn": txn, "_fx": fx, "_more": F.when(data, description).when(fx.isNull(), fragment)}))
    return out.where("error is null or error <> 'unparseable date'")


# Fixed values of layout D: sections with the kind of their rows, and the words of refunds and of payments of cards.
D_SECTIONS = {"deposits and additions": "transfer", "atm & debit card withdrawals": "purchase", "electronic withdrawals": "purchase", "checks paid": "purchase", "fees": "fee"}
D_HEADER = r"(?i)\bdate\b.*\b(withdrawals|debits)\b.*\b(deposits|credits)\b"
D_REFUND = r"(?i)\b(RETURN|REFUND|PURCHASE\s+RETURN)\b"
D_CARD = r"(?i)\b(AUTOPAY|CRD\s*PMT|CREDIT\s*CARD\s*PAYMENT|EPAY|PAYMENT|PMT)\b"
D_FX = r"(?i)FOREIGN\s+AMOUNT\s+([\d,]+\.\d{2})\s+([A-Z]{3})\s+RATE\s+([\d.]+)"


def layout_d(rows: DataFrame) -> DataFrame:
    """A bank's statement: the column whose name stands nearest to an amount decides whether it is a debit, a credit or the balance."""
    rows = _with_period(rows)
    w = _per_file(rows)
    is_header = F.col("text").rlike(D_HEADER)
    named = lambda *parts: F.filter("words", lambda x: F.lower(x["text"]).rlike("|".join(parts)))[0]["x0"]
    anchors = F.struct(named("withdrawal", "debit").alias("debit"), named("deposit", "credit").alias("credit"), F.get(F.filter("words", lambda x: F.lower(x["text"]).contains("balance")), F.lit(0))["x0"].alias("balance"))
    first = F.first(F.when(is_header, anchors), True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heading = F.when(F.lower(F.trim("text")).isin(*D_SECTIONS), F.lower(F.trim("text")))
    marked = rows.withColumns({"_a": first, "_mark": heading}).where(~is_header & F.col("_a").isNotNull())
    marked = marked.withColumns({"section": F.last("_mark", True).over(w), "_block": F.count("_mark").over(w)}).where("_mark is null")
    fx = _fx(F.col("text"), D_FX)
    parts = dates.parts(F.col("words")[0]["text"])
    dated = parts.isNotNull() & parts["year"].isNull() & fx.isNull()
    # The amounts at the end of a row, without the date.
    rest = F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0)))
    last_text = F.array_max(F.transform(F.sequence(F.lit(0), F.size(rest)), lambda i: F.when((i > 0) & money_minor(F.get(rest, i - 1)["text"]).isNull(), i).otherwise(0)))
    marked = marked.withColumns({"_rest": rest, "_k": last_text})
    money = F.when(F.size("_rest") > F.col("_k"), F.slice("_rest", F.col("_k") + 1, F.size("_rest"))).otherwise(F.slice("_rest", 1, 0))
    far = lambda x, c: F.abs(x - F.col(f"_a.{c}"))
    nearest = lambda x: F.array_min(F.array_compact(F.array(*[F.when(F.col(f"_a.{c}").isNotNull(), F.struct(far(x, c).alias("d"), F.lit(i).alias("i"), F.lit(c).alias("c"))) for i, c in enumerate(("debit", "credit", "balance"))])))["c"]
    marked = marked.withColumn("_m", F.transform(money, lambda x: F.struct(nearest(x["x0"]).alias("c"), money_minor(x["text"]).alias("v"))))
    of = lambda c: F.get(F.filter("_m", lambda m: m["c"] == c), F.lit(0))["v"]
    amount = F.coalesce(F.abs(of("debit")), -F.abs(of("credit")))
    error = (
        F.when(F.size("_m") == 0, "no amount").when(F.size("_m") > 2, "too many amounts").when(of("debit").isNotNull() & of("credit").isNotNull(), "debit and credit")
        .when(amount.isNull(), "balance without amount").when(F.col("section").isNull(), "row before any section")
    )
    description = joined(F.slice("_rest", 1, F.col("_k")))
    kind = F.create_map(*[F.lit(x) for kv in D_SECTIONS.items() for x in kv])[F.col("section")]
    hint = F.when(description.rlike(D_CARD), "transfer").when((F.col("section") == "deposits and additions") & description.rlike(D_REFUND), "refund").otherwise(kind)
    posted = dates.in_period(parts, F.col("period_start"), F.col("period_end"))
    txn = _txn(dated, posted_date=posted, amount_minor=amount, section=F.col("section"), kind_hint=hint, balance_minor=of("balance"), error=F.coalesce(error, F.when(posted.isNull(), "date out of period")))
    return folded(marked.withColumns({"_txn": txn, "_fx": fx, "_more": F.when(dated, description).when(fx.isNull(), F.trim("text"))}), across=True)


def balance_breaks(txns: DataFrame, summary: DataFrame) -> DataFrame:
    """(file_sha256, ordinal, expected_minor, balance_minor): rows whose printed balance is not the one before (at first the opening one) less the amounts since."""
    w = Window.partitionBy("file_sha256").orderBy("ordinal")
    rows = txns.join(summary.select("file_sha256", "opening_balance_minor"), "file_sha256", "left")
    before = F.last("balance_minor", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    since = F.count("balance_minor").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_start": F.coalesce(before, "opening_balance_minor"), "_span": since})
    spent = F.sum("amount_minor").over(Window.partitionBy("file_sha256", "_span").orderBy("ordinal"))
    rows = rows.withColumn("expected_minor", F.col("_start") - spent)
    return rows.where("balance_minor is not null and expected_minor <> balance_minor").select("file_sha256", "ordinal", "expected_minor", "balance_minor")


# Names of the columns of debits and of credits.
DEBIT, CREDIT = r"(?i)\b(?:debit|withdrawal)s?\b", r"(?i)\b(?:credit|deposit)s?\b"


def _sides(names: Column) -> Column:
    """The places (from 0) of the first column named as debit and the first named as credit, if both are there and stand in this order; else none."""
    place = lambda own, other: F.array_position(F.transform(names, lambda t: t.rlike(own) & ~t.rlike(other)), True).cast("int") - 1
    return let(F.array(place(DEBIT, CREDIT), place(CREDIT, DEBIT)), lambda p: F.when((p[0] >= 0) & (p[0] < p[1]), p))


def generic(rows: DataFrame) -> DataFrame:
    """Any table of dates, texts and amounts: columns get their role from what more than half of their cells hold.

    One column of amounts is signed; two are debit and credit, and a third is the balance. Where the names tell debit and then credit, one without
    any cell on a page counts too, so that what stands beside it keeps its role. Fewer than three transactions make a file unsupported.
    """
    key = [*PAGE, "table"]
    tables = tables_of(_with_period(rows)).withColumn("_head", header_starts(F.col("header")))
    groups = nested(tables, key, ["row_number"])
    own = F.transform(bands(F.filter("group", lambda r: (r["kind"] == "data") & r["_head"].isNull())), lambda b: b["x0"])
    cut = unnested(groups.withColumn("_own", own)).withColumn("_starts", F.coalesce("_head", "_own")).where("_starts is not null")
    cut = cut.withColumn("_c", cells(F.col("words"), F.col("_starts"))).drop("words", "_own", "_starts")
    # What each cell of a row of data holds: 1 a date, 2 an amount, 3 anything else, 0 nothing.
    holds = F.transform("_c", lambda t: F.when(F.trim(t) == "", 0).when(dates.parts(t).isNotNull(), 1).when(money_minor(t).isNotNull(), 2).otherwise(3))
    cut = cut.withColumn("_holds", F.when(F.col("kind") == "data", holds))

    def roles(table: Column) -> Column:
        all_ = table["all"]
        held = lambda i: F.filter(F.transform(all_, lambda h: F.get(h, i)), lambda x: x > 0)

        def share(i: Column, what: int) -> Column:
            return let(held(i), lambda column: F.size(F.filter(column, lambda x: x == what)) > 0.5 * F.size(column))

        places = F.sequence(F.lit(0), F.size(all_[0]) - 1)
        date = F.get(F.filter(places, lambda i: share(i, 1)), F.lit(0))
        blank = F.filter(table["sides"], lambda i: F.size(held(i)) == 0)
        money = let(F.filter(places, lambda i: share(i, 2)), lambda m: F.when(F.get(m, F.lit(0)) >= table["sides"][0], F.array_sort(F.array_union(m, blank))).otherwise(m))
        return F.struct(date.alias("date"), money.alias("money"))

    groups = nested(cut, key, ["row_number"]).withColumn("_all", F.filter(F.col("group")["_holds"], lambda h: h.isNotNull()))
    first = F.get("group", F.lit(0))
    sides = F.when(first["_head"].isNotNull(), let(cells(first["header"], first["_head"]), _sides))
    table = F.struct(F.col("_all").alias("all"), sides.alias("sides"))
    groups = groups.withColumn("_r", F.when(F.size("_all") > 0, let(table, roles))).drop("_all")
    cut = unnested(groups.withColumns({"_date": F.col("_r.date"), "_money": F.col("_r.money")}).drop("_r"))
    cut = cut.where("_date is not null and size(_money) > 0")
    cut = cut.withColumn("section", F.last(F.when(F.col("kind") == "section", F.trim("text")), True).over(Window.partitionBy(*key).orderBy("row_number")))
    cell = lambda k: F.when(F.size("_money") > k, money_minor(F.get("_c", F.get("_money", F.lit(k)))))
    amount = F.when(F.size("_money") == 1, cell(0)).otherwise(F.coalesce(F.abs(cell(0)), -F.abs(cell(1))))
    both = (F.size("_money") > 1) & cell(0).isNotNull() & cell(1).isNotNull()
    parts = dates.parts(F.get("_c", F.col("_date")))
    posted = dates.in_period(parts, F.col("period_start"), F.col("period_end"))
    starts = (F.col("kind") == "data") & parts.isNotNull() & (amount.isNotNull() | both)
    plain = F.filter(F.transform("_c", lambda t, i: F.when((i != F.col("_date")) & ~F.array_contains("_money", i), F.trim(t))), lambda t: F.coalesce(t, F.lit("")) != "")
    error = F.when(both, "debit and credit").when(posted.isNull(), "date without a year")
    txn = _txn(starts, posted_date=posted, amount_minor=amount, section=F.col("section"), balance_minor=cell(2), error=error)
    more = F.when(starts, F.array_join(plain, " ")).when(F.col("kind").isin("data", "continuation"), F.trim("text"))
    out = folded(cut.withColumns({"_txn": txn, "_fx": F.lit(None).cast(FX), "_more": more, "_block": F.lit(0)}), across=True)
    enough = F.count("*").over(Window.partitionBy("file_sha256")) >= 3
    return out.withColumn("_enough", enough).where("_enough").drop("_enough")


# Declarative layouts.

#: Expressions of a spec are at most this long and repeat no group that repeats itself.
PATTERN_CHARS = 200
_NESTED = re.compile(r"\([^()]*[+*][^()]*\)[+*{]")


@dataclass(frozen=True)
class Spec:
    """A layout as data: `row` has the groups date, description and amount, `fx` the amount, currency and rate.

    Sections are headings with the kind of their outflows and inflows (a kind of (None, None) leaves it open). Reading begins after `start`, if given, and
    ends for good at `stop`; rows that fit `skip` do not count. Amounts are outflows unless `inflow_is_minus` is false.
    """

    id: str
    detect: Sequence[str]
    row: str
    sections: dict[str, tuple[str | None, str | None]] = field(default_factory=dict)
    start: str | None = None
    stop: str | None = None
    skip: Sequence[str] = ()
    fx: str | None = None
    inflow_is_minus: bool = True

    def __post_init__(self):
        for pattern in filter(None, (self.row, self.start, self.stop, self.fx, *self.skip, *self.detect)):
            if len(pattern) > PATTERN_CHARS or _NESTED.search(pattern):
                raise ValueError(f"{self.id}: an expression is too long or repeats a repeated group")
            re.compile(pattern)
        if missing := {"date", "description", "amount"} - set(re.compile(self.row).groupindex):
            raise ValueError(f"{self.id}: row lacks the groups {sorted(missing)}")


def read(rows: DataFrame, spec: Spec) -> DataFrame:
    """Transactions of files by a spec, as column expressions."""
    rows = _with_period(rows)
    w = _per_file(rows)
    java = lambda p: "(?i)" + p.replace("(?P<", "(?<")
    text = F.trim("text")
    group = re.compile(spec.row).groupindex
    got = lambda name: F.regexp_extract(text, java(spec.row), group[name])
    marked = rows
    if spec.stop:
        marked = marked.withColumn("_stopped", F.max(text.rlike(java(spec.stop)).cast("int")).over(w)).where("_stopped = 0")
    if spec.start:
        begun = text.rlike(java(spec.start))
        marked = marked.withColumns({"_begun": F.max(begun.cast("int")).over(w), "_begins": begun}).where("_begun = 1")
    else:
        marked = marked.withColumn("_begins", F.lit(False))
    for shape in spec.skip:
        marked = marked.where(~text.rlike(java(shape)))
    heading = F.when(F.upper(text).isin(*[s.upper() for s in spec.sections]), F.upper(text)) if spec.sections else F.lit(None).cast("string")
    marked = marked.withColumn("_mark", F.when(F.col("_begins"), "").otherwise(heading))
    marked = marked.withColumns({"section": F.last("_mark", True).over(w), "_block": F.count("_mark").over(w)}).where("_mark is null")
    if spec.sections:
        marked = marked.where("section <> ''")
    amount = money_minor(got("amount"))
    parts = dates.parts(got("date"))
    data = text.rlike(java(spec.row)) & amount.isNotNull() & parts.isNotNull()
    amount = amount if spec.inflow_is_minus else -amount
    fx = F.when(~data, _fx(text, java(spec.fx), *[re.compile(spec.fx).groupindex[g] for g in ("amount", "currency", "rate")])) if spec.fx else F.lit(None).cast(FX)
    hints = [(F.col("section") == name.upper(), out, into) for name, (out, into) in spec.sections.items()]
    hint = F.coalesce(*[F.when(at, F.when(amount > 0, F.lit(out)).otherwise(F.lit(into))) for at, out, into in hints], F.lit(None).cast("string"))
    posted = dates.in_period(parts, F.col("period_start"), F.col("period_end"))
    txn = _txn(data, posted_date=posted, amount_minor=amount, section=F.col("section"), kind_hint=hint, error=F.when(posted.isNull(), "date out of period"))
    return folded(marked.withColumns({"_txn": txn, "_fx": fx, "_more": F.when(data, got("description")).when(fx.isNull(), text)}))


#: Layout B as a spec: capital headings, dates without a year, nothing after the interest table.
LAYOUT_B = Spec(
    "layout_b_credit", ("ACCOUNT ACTIVITY", "Merchant Name or Transaction Description"), r"^(?P<date>\d{1,2}/\d{1,2})\s+(?P<description>.*\S)\s+(?P<amount>\S+)$",
    {"PAYMENTS AND OTHER CREDITS": ("payment_or_refund", "payment_or_refund"), "PURCHASES": ("purchase", "adjustment")},
    start=r"^ACCOUNT ACTIVITY$", stop=r"^INTEREST CHARGED\b", skip=("Merchant Name or Transaction Description",),
    fx=r"^FOREIGN CURRENCY AMOUNT\s+(?P<amount>[\d,]+\.\d{2})\s+(?P<currency>[A-Z]{3})\s+EXCH(?:ANGE)? RATE\s+(?P<rate>[\d.]+)$",
)


def layout_b(rows: DataFrame) -> DataFrame:
    return read(rows, LAYOUT_B)


READERS: dict[str, Callable[[DataFrame], DataFrame]] = {"layout_a_credit": layout_a, "layout_b_credit": layout_b, "layout_c_credit": layout_c, "layout_d_bank": layout_d, "generic_table": generic}


def scores(text: Column) -> dict[str, Column]:
    """How sure each layout is of a file by its text, in the order of asking."""
    low, up = F.lower(text), F.upper(text)
    headings = sum((low.contains(h).cast("int") for h in A_SECTIONS), F.lit(0))
    a = F.when((headings >= 3) & low.contains("reference number") & low.contains("account number"), 0.9).when(text.rlike(r"(?i)\bTOTAL\s+[A-Za-z][A-Za-z \-]+\s+FOR THIS PERIOD\b"), 0.6).otherwise(0.0)
    activity, column = up.contains("ACCOUNT ACTIVITY"), low.contains("merchant name or transaction description")
    b = F.when(activity & column, 0.95).when(activity | column, 0.3).otherwise(0.0)
    c = F.when(up.rlike(r"TRANS\.?\s*DATE") & up.contains("PURCHASES") & up.contains("MERCHANT CATEGORY"), 0.9).otherwise(0.0)
    d = F.when(text.rlike(D_HEADER), F.when(low.rlike(r"\bbalance\b"), 0.9).otherwise(0.6)).otherwise(0.0)
    return {"layout_a_credit": a, "layout_b_credit": b, "layout_c_credit": c, "layout_d_bank": d}


def _layout(text: Column) -> Column:
    found = scores(text)
    best = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, s) in enumerate(found.items())]))
    return let(best, lambda b: F.when(b["s"] > 0.5, F.struct(b["name"].alias("parser_id"), b["s"].alias("detect_score"))).otherwise(F.struct(F.lit("generic_table").alias("parser_id"), F.lit(0.0).alias("detect_score"))))


def detected(summary: DataFrame) -> DataFrame:
    """(file_sha256, parser_id, detect_score): the surest layout if above 0.5 (of equals the first), else the generic reader."""
    return summary.select("file_sha256", _layout(F.col("text")).alias("_l")).select("file_sha256", "_l.*")


def with_layout(rows: DataFrame) -> DataFrame:
    """rows with parser_id and detect_score of their files, as `detected` has them."""
    files = nested(rows, ["file_sha256"], _ORDER)
    return unnested(files.withColumn("_l", _layout(F.array_join("group.text", "\n"))).select("file_sha256", "_l.*", "group"))


def issuer_of(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(file_sha256, issuer_id): whose term (name or other) is the longest found on page one outside tables; null if two issuers have one as long.

    terms: (issuer_id, term), written by hand, so that each file meets all of them in one broadcast list.
    """
    first = kept(rows.where("page_number = 1"), "first-pages")
    page = first.join(tables_of(first).select(*PAGE, "row_number"), [*PAGE, "row_number"], "left_anti")
    text = page.groupBy("file_sha256").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_number", "text"))), lambda r: r["text"]), " ").alias("_t"))
    spaced = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    known = [(r["issuer_id"], r["s"], r["s"].replace(" ", "")) for r in terms.select("issuer_id", spaced(F.col("term")).alias("s")).collect() if r["s"]]
    page_text = text.select("file_sha256", spaced(F.col("_t")).alias("_s")).withColumn("_c", F.replace("_s", F.lit(" "), F.lit("")))
    hits = [F.when(F.col("_s").contains(s), F.struct(F.lit(len(s)).alias("n"), F.lit(i).alias("i"))).when(F.col("_c").contains(c), F.struct(F.lit(len(c)).alias("n"), F.lit(i).alias("i"))) for i, s, c in known]
    found = page_text.withColumn("_h", F.array_compact(F.array(*hits)) if hits else F.array().cast("array<struct<n: int, i: bigint>>"))
    longest = F.array_max(F.transform("_h", lambda h: h["n"]))
    who = F.array_distinct(F.transform(F.filter("_h", lambda h: h["n"] == longest), lambda h: h["i"]))
    return found.select("file_sha256", F.when(F.size(who) == 1, who[0]).cast("bigint").alias("issuer_id"))
