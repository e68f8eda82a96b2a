"""Income and tax: rollups by form role, the basis of a year, the loss limit, payers, bracket tax."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthledger.functions.text import money_text

# Categories in their order.
INCOME = ("salary_wages", "interest", "ordinary_dividends", "qualified_dividends", "short_term_capital_gain", "long_term_capital_gain", "self_employment", "other")
MEMO = ("qualified_dividends",)
WITHHELD = ("federal_income_tax_withheld", "state_income_tax_withheld", "local_income_tax_withheld")
FICA = ("social_security_tax", "medicare_tax")
LIABILITY = (
    "total_federal_tax", "federal_tax_ordinary_est", "federal_tax_preferential_est", "net_investment_income_tax", "additional_medicare_tax",
    "self_employment_tax", "state_income_tax_liability",
)
RESULTS = ("total_payments", "refund", "amount_owed")
GAINS = ("short_term_capital_gain", "long_term_capital_gain")
#: Differences up to this (minor units) are not worth a warning.
TOLERANCE = 100
# What is compared with a return (label, categories, whether only an excess counts).
RECONCILED = (
    ("W-2 wages", ("salary_wages",), False),
    ("1099 interest", ("interest",), False),
    ("1099 dividends", ("ordinary_dividends",), False),
    ("1099-B net capital gain", GAINS, False),
    ("1099 self-employment income", ("self_employment",), False),
    ("other 1099 income", ("other",), True),
)
# The warnings of a year, as users see them; {} is a number or an amount of money.
WARNINGS = {
    "returns": "{} Form 1040 returns were imported for this year; only the most recently imported one is used. Delete the others if they were superseded.",
    "no_source": "No W-2/1099 source documents were imported for this year; income comes from the tax return, and federal withholding from its line 25d.",
    "less": " is {} less than the return reports - some forms may not be imported. Income shown is from the return.",
    "more": " is {} more than the return reports - a corrected or duplicate form may have been imported. Income shown is from the return.",
    "carryover": "Net capital loss exceeds the $3,000 annual limit; only $3,000 is counted and {} is a carryover to later years. Import the Form 1040 for the exact figure.",
    "withheld": "Federal tax withheld on source forms ({}) differs from the return's line 25d ({}). Withholding shown is from the source forms.",
    "derived": "Refund / amount owed is derived from payments minus total tax.",
    "estimate": "The ordinary vs preferential federal tax split is an estimate, not a printed figure.",
    "corrected": "{} form(s) are marked corrected; a superseded original imported as well would be counted twice.",
}
#: A net capital loss above this (minor units) is carried over.
LOSS_LIMIT = 300_000
KEY = ["user_id", "tax_year"]


def form_key() -> Column:
    """Returns are told apart by form; source forms are summed."""
    return F.when(F.col("role") == "return", F.col("form_id")).otherwise(F.lit(0))


def rollup(items: DataFrame, forms: DataFrame, memo: bool = False) -> DataFrame:
    """Sums by user, year, role, form type, return form, category (and is_memo)."""
    named = forms.select(F.col("id").alias("form_id"), "role", "form_type")
    keys = [*KEY, "role", "form_type", form_key().alias("return_form_id"), "category", *(["is_memo"] if memo else [])]
    return items.join(named, "form_id").groupBy(*keys).agg(F.sum("amount_minor").alias("amount_minor"))


def form_counts(forms: DataFrame) -> DataFrame:
    """Forms, distinct documents and corrected forms by user, year and role."""
    return forms.groupBy(*KEY, "role").agg(
        F.count("*").alias("form_count"), F.countDistinct("document_id").alias("document_count"), F.sum("is_corrected").alias("corrected")
    )


def latest_returns(forms: DataFrame) -> DataFrame:
    """The 1040 that counts (the last one imported) and how many there are."""
    found = forms.where("form_type = '1040'")
    return found.groupBy(*KEY).agg(F.max("id").alias("latest_return"), F.count("*").alias("returns"))


def limited(short: Column, long: Column) -> tuple[Column, Column, Column]:
    """Both gains with the net loss limited, and the carryover; the more negative one gives first."""
    carry = F.greatest(-(short + long) - LOSS_LIMIT, F.lit(0))
    short_first = short <= long
    room = lambda x: F.greatest(-x, F.lit(0))
    one = F.least(carry, room(F.least(short, long)))
    two = F.least(carry - one, room(F.greatest(short, long)))
    return short + F.when(short_first, one).otherwise(two), long + F.when(short_first, two).otherwise(one), carry


def warning(name: str, *values: Column) -> Column:
    """A text of WARNINGS with its values filled in."""
    parts = WARNINGS[name].split("{}")
    cells = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        cells += [value.cast("string"), F.lit(part)]
    return F.concat(*cells)


def by_form(items: DataFrame, categories: Sequence[str], memo: bool) -> DataFrame:
    """One row for each form: the sum of each category, null where it has none; memo items other than MEMO sum up as `tax_exempt`."""
    plain = (~F.col("is_memo") | F.col("category").isin(*MEMO)) if memo else F.lit(True)
    sums = [F.sum(F.when((F.col("category") == c) & plain, F.col("amount_minor"))).alias(c) for c in categories]
    if memo:
        sums.append(F.sum(F.when(~plain, F.col("amount_minor"))).alias("tax_exempt"))
    return items.groupBy("form_id").agg(*sums)


def year_summary(forms: DataFrame, income: DataFrame, taxes: DataFrame) -> DataFrame:
    """Of each user and year: basis, income by category, memo items, withholding, liability, payments, refund or amount owed, counts, warnings.

    The latest 1040 decides income where there is one; state returns feed taxes, never income. Withholding comes from source
    forms; federal withholding from the return where they lack it. Absent liabilities, payments and results stay null (a category that is
    present with 0 is not absent). Items belong to the user and year of their form.

    Items are summed by form first, so that forms are read once and only rows of forms meet by user and year.
    """
    rows = forms.select(F.col("id").alias("form_id"), *KEY, "document_id", "role", "form_type", "is_corrected")
    rows = rows.join(by_form(income, INCOME, True), "form_id", "left").join(by_form(taxes, (*WITHHELD, *FICA, *LIABILITY, *RESULTS), False), "form_id", "left")
    is_1040, is_source = F.col("form_type") == "1040", F.col("role") == "source"
    latest = F.max(F.when(is_1040, F.col("form_id"))).over(Window.partitionBy(*KEY))
    rows = rows.withColumn("_latest", latest)
    of_return = ~is_source & is_1040 & (F.col("form_id") == F.col("_latest"))
    taxed = ~is_source & (~is_1040 | (F.col("form_id") == F.col("_latest")))
    total = lambda where, c: F.sum(F.when(where, F.col(c)))
    sums = rows.groupBy(*KEY).agg(
        *[total(is_source, c).alias(f"s_{c}") for c in (*INCOME, "tax_exempt", *WITHHELD, *FICA)],
        *[total(of_return, c).alias(f"r_{c}") for c in (*INCOME, "tax_exempt")],
        *[total(taxed, c).alias(f"r_{c}") for c in (WITHHELD[0], *LIABILITY, *RESULTS)],
        F.max("_latest").alias("_latest"), F.count(F.when(is_1040, 1)).alias("returns"), F.count("*").alias("form_count"),
        (F.countDistinct(F.when(is_source, F.col("document_id"))) + F.countDistinct(F.when(~is_source, F.col("document_id")))).alias("document_count"),
        F.sum("is_corrected").cast("bigint").alias("corrected"), F.max(is_source.cast("int")).alias("_source"),
    )
    has, source = F.col("_latest").isNotNull(), F.col("_source") == 1
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    short, long, carry = limited(zero("s_short_term_capital_gain"), zero("s_long_term_capital_gain"))
    out = sums.withColumns({"_short": short, "_long": long, "_carry": carry})
    mine = {c: zero(f"s_{c}") for c in INCOME} | {"short_term_capital_gain": F.col("_short"), "long_term_capital_gain": F.col("_long")}
    none = F.lit(0).cast("bigint")
    out = out.withColumn("basis", F.when(has, "return").when(source, "source_documents").otherwise("none"))
    out = out.withColumns({c: F.when(has, zero(f"r_{c}")).when(source, mine[c]).otherwise(none) for c in INCOME})
    out = out.withColumn("tax_exempt_memo", F.when(has, zero("r_tax_exempt")).when(source, zero("s_tax_exempt")).otherwise(none))
    out = out.withColumn("carryover_minor", F.when(~has & source, F.col("_carry")).otherwise(none))
    out = out.withColumn("total_income_minor", sum((F.col(c) for c in INCOME if c not in MEMO), none))
    mine_fed, line_25d = F.col(f"s_{WITHHELD[0]}"), F.col(f"r_{WITHHELD[0]}")
    out = out.withColumns({WITHHELD[0]: F.coalesce(mine_fed, F.when(has, line_25d), none)} | {c: zero(f"s_{c}") for c in (*WITHHELD[1:], *FICA)})
    out = out.withColumns({c: F.col(f"r_{c}") for c in LIABILITY} | {"payments_minor": F.col("r_total_payments")})
    derive = F.col("r_refund").isNull() & F.col("r_amount_owed").isNull() & F.col("payments_minor").isNotNull() & F.col("total_federal_tax").isNotNull()
    diff = F.col("payments_minor") - F.col("total_federal_tax")
    out = out.withColumn("derived", derive)
    out = out.withColumn("refund_minor", F.when(F.col("derived"), F.greatest(diff, none)).otherwise(F.col("r_refund")))
    out = out.withColumn("amount_owed_minor", F.when(F.col("derived"), F.greatest(-diff, none)).otherwise(F.col("r_amount_owed")))
    compared = []
    for label, categories, only_more in RECONCILED:
        off = sum((mine[c] for c in categories), none) - sum((zero(f"r_{c}") for c in categories), none)
        less = F.lit(None) if only_more else F.when(off < -TOLERANCE, F.concat(F.lit(label), warning("less", money_text(-off))))
        compared.append(F.when(has & source, F.coalesce(less, F.when(off > TOLERANCE, F.concat(F.lit(label), warning("more", money_text(off)))))))
    estimated = F.coalesce(*[F.col(c) for c in LIABILITY if c.endswith("_est")]).isNotNull()
    found = [
        F.when(F.col("returns") > 1, warning("returns", F.col("returns"))), F.when(has & ~source, warning("no_source")), *compared,
        F.when(F.col("carryover_minor") > 0, warning("carryover", money_text(F.col("carryover_minor")))),
        F.when(has & (F.abs(mine_fed - line_25d) > TOLERANCE), warning("withheld", money_text(mine_fed), money_text(line_25d))),
        F.when(F.col("derived"), warning("derived")), F.when(estimated, warning("estimate")), F.when(F.col("corrected") > 0, warning("corrected", F.col("corrected"))),
    ]
    return out.select(
        *KEY, "basis", *INCOME, "tax_exempt_memo", "total_income_minor", "carryover_minor", *WITHHELD, *FICA, *LIABILITY, "payments_minor",
        "refund_minor", "amount_owed_minor", "derived", "form_count", "document_count", "corrected", "returns", F.array_compact(F.array(*found)).alias("warnings"),
    )


def merged(summaries: DataFrame) -> DataFrame:
    """One row for each year over all users: sums (null where no user has the figure), and `mixed` where bases differ.

    Warnings are rows of their own (`merged_warnings`): a list of them grows with the users.
    """
    sums = [F.sum(c).alias(c) for c in (*INCOME, "tax_exempt_memo", "total_income_minor", "carryover_minor", *WITHHELD, *FICA, *LIABILITY, "payments_minor", "refund_minor", "amount_owed_minor", "form_count", "document_count")]
    basis = F.when(F.min("basis") == F.max("basis"), F.min("basis")).otherwise("mixed")
    return summaries.groupBy("tax_year").agg(basis.alias("basis"), *sums, F.max("derived").alias("derived"))


def merged_warnings(summaries: DataFrame) -> DataFrame:
    """(tax_year, warning, user_id, position): each warning of a year once, where it comes first by user and place."""
    each = summaries.select("tax_year", "user_id", F.posexplode("warnings").alias("position", "warning"))
    first = each.groupBy("tax_year", "warning").agg(F.min(F.struct("user_id", "position")).alias("_f"))
    return first.select("tax_year", "warning", "_f.user_id", "_f.position")


def rate(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator to four places, null unless the denominator is positive.

    A half is decided as for binary fractions: by the exact value of the double, halves to even. The double's bits are taken as a
    whole number, 2**s times as large, whose remainder tells on which side of the half it lies.
    """
    x = F.abs(numerator.cast("double") / denominator.cast("double"))

    def places(s: int) -> Column:
        # The scale is a power of two, so the product is exact; all bits of a double of this size are below 2**63.
        whole = (x * float(1 << s)).cast("bigint").cast("decimal(38,0)") * 10_000
        one = F.lit(str(1 << s)).cast("decimal(38,0)")
        rest = whole % one
        low = ((whole - rest) / one).cast("bigint")
        twice = rest * 2
        return low + F.when((twice > one) | ((twice == one) & (low % 2 == 1)), 1).otherwise(0)

    number = F.when(x < 2.0**-9, places(71)).when(x < 1, places(62)).when(x < 1024, places(52)).otherwise(F.round(x * 10_000).cast("bigint"))
    signed = F.when(numerator < 0, -number).otherwise(number) / F.lit(10_000.0)
    return F.when(denominator > 0, signed)


def with_rates(rows: DataFrame) -> DataFrame:
    """rows of year_summary or merged with federal_effective_rate, all_in_rate and withholding_rate.

    Additional Medicare tax that an employer withheld is part of both the federal tax and box 6, and counts once.
    """
    zero = F.lit(0).cast("bigint")
    federal, income = F.col("total_federal_tax"), F.col("total_income_minor")
    twice = F.least(F.coalesce("additional_medicare_tax", zero), F.col("medicare_tax"))
    withheld = sum((F.col(c) for c in WITHHELD), zero)
    fica = sum((F.col(c) for c in FICA), zero)
    # Any of them not 0: amounts of taxes are never negative.
    any_withheld, any_fica = F.greatest(*[F.col(c) for c in WITHHELD]) > 0, F.greatest(*[F.col(c) for c in FICA]) > 0
    state = F.coalesce("state_income_tax_liability", WITHHELD[1])
    all_in = F.coalesce(federal - twice, F.col(WITHHELD[0])) + state + F.col(WITHHELD[2]) + fica
    return rows.withColumns({
        "federal_effective_rate": rate(federal, income),
        "all_in_rate": rate(F.when(federal.isNotNull() | any_withheld | any_fica, all_in), income),
        "withholding_rate": rate(F.when(any_withheld, F.col(WITHHELD[0])), income),
    })


def tax_summary(forms: DataFrame, income: DataFrame, taxes: DataFrame, per_user: bool = True, tax_years: Sequence[int] | None = None, user_ids: Sequence[int] | None = None) -> DataFrame:
    """The finished summaries, the latest year first, then by user."""
    for year in tax_years or ():
        if isinstance(year, bool) or not isinstance(year, int) or not 1990 <= year <= 2100:
            raise ValueError(f"not a tax year: {year!r}")
    if user_ids is not None:
        forms = forms.where(F.col("user_id").isin(list(user_ids)) if user_ids else F.lit(False))
    if tax_years is not None:
        forms = forms.where(F.col("tax_year").isin(list(tax_years)) if tax_years else F.lit(False))
    rows = year_summary(forms, income, taxes)
    out = with_rates(rows if per_user else merged(rows))
    return out.orderBy(F.desc("tax_year"), *(["user_id"] if per_user else []))


def tax_years(forms: DataFrame) -> DataFrame:
    """Years with a form, the latest first."""
    return forms.select("tax_year").distinct().orderBy(F.desc("tax_year"))


def documents(docs: DataFrame) -> DataFrame:
    """Tax documents, the latest year first, those without a year last, then the latest id."""
    return docs.orderBy(F.desc_nulls_last("tax_year"), F.desc("id"))


def with_items(forms: DataFrame, income: DataFrame, taxes: DataFrame) -> DataFrame:
    """forms with the items of each, as arrays: a form is bounded, it holds what is printed on one."""
    items = lambda rows, name: rows.groupBy("form_id").agg(F.array_sort(F.collect_list(F.struct("category", "amount_minor"))).alias(name))
    full = forms.join(items(income, "income_items"), forms["id"] == F.col("form_id"), "left").drop("form_id")
    return full.join(items(taxes, "tax_items"), full["id"] == F.col("form_id"), "left").drop("form_id")


def nested(docs: DataFrame, forms: DataFrame, income: DataFrame, taxes: DataFrame) -> DataFrame:
    """Documents with their forms, and those with their items, as arrays; what one statement of a household holds. Of documents without such a bound use `with_items`."""
    full = with_items(forms, income, taxes)
    listed = full.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("id", "form_type", "role", "income_items", "tax_items"))).alias("forms"))
    return docs.join(listed, docs["id"] == listed["document_id"], "left").drop("document_id")


def income_by_payer(income: DataFrame, forms: DataFrame) -> DataFrame:
    """Source income without memo items and qualified dividends, by payer; no name is `Unknown payer`."""
    named = forms.where("role = 'source'").select(F.col("id").alias("form_id"), "form_type", "payer_name")
    rows = income.where(~F.col("is_memo") & ~F.col("category").isin(*MEMO)).join(named, "form_id")
    name = F.coalesce(F.when(F.trim("payer_name") != "", F.col("payer_name")), F.lit("Unknown payer"))
    return rows.groupBy("user_id", "tax_year", name.alias("payer"), "form_type", "category").agg(F.sum("amount_minor").alias("amount_minor"))


def bracket_tax(income_minor: Column, brackets: Sequence[tuple[int, int]]) -> Column:
    """Tax by brackets (lower bound in minor units, rate in basis points), half cents up."""
    ends = [b for b, _ in brackets[1:]] + [None]
    parts = F.lit(0).cast("long")
    for (low, rate), high in zip(brackets, ends):
        top = income_minor if high is None else F.least(income_minor, F.lit(high))
        parts = parts + F.greatest(top - low, F.lit(0)) * rate
    return F.floor((parts * 2 + 10_000) / 20_000).cast("long")
