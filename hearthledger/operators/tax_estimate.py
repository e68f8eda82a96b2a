"""Federal tax on taxable income: brackets, the printed tax table, and the split of a tax between ordinary and preferential rates.

All in minor units, as column expressions over a row's bracket table, which `with_table` joins by year and filing status (twenty rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values, in dollars: where each rate above the first begins, and where the 0 % and the 15 % rates on long-term gains end.
# Rev. Proc. 2021-45, 2022-38, 2023-34 and 2024-40.
RATES = (10, 12, 22, 24, 32, 35, 37)
TABLES = {
    (2022, "single"): ((10_275, 41_775, 89_075, 170_050, 215_950, 539_900), 41_675, 459_750),
    (2022, "mfj"): ((20_550, 83_550, 178_150, 340_100, 431_900, 647_850), 83_350, 517_200),
    (2022, "mfs"): ((10_275, 41_775, 89_075, 170_050, 215_950, 323_925), 41_675, 258_600),
    (2022, "hoh"): ((14_650, 55_900, 89_050, 170_050, 215_950, 539_900), 55_800, 488_500),
    (2023, "single"): ((11_000, 44_725, 95_375, 182_100, 231_250, 578_125), 44_625, 492_300),
    (2023, "mfj"): ((22_000, 89_450, 190_750, 364_200, 462_500, 693_750), 89_250, 553_850),
    (2023, "mfs"): ((11_000, 44_725, 95_375, 182_100, 231_250, 346_875), 44_625, 276_900),
    (2023, "hoh"): ((15_700, 59_850, 95_350, 182_100, 231_250, 578_100), 59_750, 523_050),
    (2024, "single"): ((11_600, 47_150, 100_525, 191_950, 243_725, 609_350), 47_025, 518_900),
    (2024, "mfj"): ((23_200, 94_300, 201_050, 383_900, 487_450, 731_200), 94_050, 583_750),
    (2024, "mfs"): ((11_600, 47_150, 100_525, 191_950, 243_725, 365_600), 47_025, 291_850),
    (2024, "hoh"): ((16_550, 63_100, 100_500, 191_950, 243_700, 609_350), 63_000, 551_350),
    (2025, "single"): ((11_925, 48_475, 103_350, 197_300, 250_525, 626_350), 48_350, 533_400),
    (2025, "mfj"): ((23_850, 96_950, 206_700, 394_600, 501_050, 751_600), 96_700, 600_050),
    (2025, "mfs"): ((11_925, 48_475, 103_350, 197_300, 250_525, 375_800), 48_350, 300_000),
    (2025, "hoh"): ((17_000, 64_850, 103_350, 197_300, 250_500, 626_350), 64_750, 566_700),
}
#: A qualifying surviving spouse has the joint tables.
SAME_TABLE = {"qss": "mfj"}
#: The printed table ends here (dollars); above it tax is worked out exactly.
TABLE_ENDS = 100_000
#: How far a printed tax may be from the worksheet's.
NEAR_MINOR = 200


def with_table(rows: DataFrame, year: str = "tax_year", status: str = "filing_status") -> DataFrame:
    """rows with `_from` (starts of the seven rates), `_zero_to` and `_fifteen_to`; null without a table."""
    known = TABLES | {(y, s): TABLES[y, of] for s, of in SAME_TABLE.items() for y, name in TABLES if name == of}
    data = [(y, s, [0, *(x * 100 for x in starts)], zero * 100, fifteen * 100) for (y, s), (starts, zero, fifteen) in sorted(known.items())]
    table = rows.sparkSession.createDataFrame(data, f"{year} int, {status} string, _from array<bigint>, _zero_to bigint, _fifteen_to bigint")
    return rows.join(F.broadcast(table), [year, status], "left")


def _div(n: Column, d: int) -> Column:
    """The whole part of n / d for n >= 0."""
    return ((n - n % F.lit(d)) / F.lit(d)).cast("bigint")


def half_up(n: Column, d: int) -> Column:
    """n / d for n >= 0, halves up, in whole numbers."""
    return _div(n * 2 + d, 2 * d)


def bracket_cents(income: Column) -> Column:
    """Tax by brackets, rounded to a cent."""
    parts = F.lit(0).cast("bigint")
    for i, rate in enumerate(RATES):
        low = F.col("_from")[i]
        top = F.least(income, F.col("_from")[i + 1]) if i + 1 < len(RATES) else income
        parts = parts + F.greatest(top - low, F.lit(0)) * rate
    return half_up(parts, 100)


def regular_cents(income: Column) -> Column:
    """Whole-dollar tax: below 100,000 that of the middle of a printed row, else by brackets."""
    dollars = _div(F.greatest(income, F.lit(0)), 100)
    middle = (
        F.when(dollars < 5, 0).when(dollars < 15, 1_000).when(dollars < 25, 2_000)
        .when(dollars < 3_000, _div(dollars, 25) * 2_500 + 1_250).when(dollars < TABLE_ENDS, _div(dollars, 50) * 5_000 + 2_500)
        .otherwise(dollars * 100)
    )
    return half_up(bracket_cents(middle.cast("bigint")), 100) * 100


def worksheet(rows: DataFrame, taxable: str = "taxable_minor", qualified: str = "qualified_minor", gain: str = "net_ltcg_minor") -> DataFrame:
    """rows (with a table) with `ordinary_tax` (on what is no qualified dividend or gain) and `worksheet_tax`."""
    zero = F.lit(0).cast("bigint")
    income = F.greatest(F.col(taxable), zero)
    favoured = F.least(income, F.greatest(F.col(qualified), zero) + F.greatest(F.col(gain), zero))
    out = rows.withColumn("_all", income).withColumn("_fav", favoured).withColumn("_rest", F.col("_all") - F.col("_fav"))
    at_zero = F.least("_all", "_zero_to") - F.least("_rest", F.least("_all", "_zero_to"))
    out = out.withColumn("_at0", at_zero)
    room = F.greatest(F.least("_all", "_fifteen_to") - (F.col("_rest") + F.col("_at0")), zero)
    out = out.withColumn("_at15", F.least(F.col("_fav") - F.col("_at0"), room))
    out = out.withColumn("_at20", F.col("_fav") - F.col("_at0") - F.col("_at15"))
    # Tables and rates give whole dollars: amount * percent / 100, rounded to 100 minor units.
    dollars = lambda amount, percent: half_up(amount * percent, 10_000) * 100
    out = out.withColumn("ordinary_tax", regular_cents(F.col("_rest")))
    split = dollars(F.col("_at15"), 15) + dollars(F.col("_at20"), 20) + F.col("ordinary_tax")
    out = out.withColumn("worksheet_tax", F.least(split, regular_cents(F.col("_all"))))
    return out.drop("_all", "_fav", "_rest", "_at0", "_at15", "_at20")


def split(rows: DataFrame, printed: str = "income_tax_minor", taxable: str = "taxable_minor", qualified: str = "qualified_minor", gain: str = "net_ltcg_minor") -> DataFrame:
    """rows with ordinary_minor and preferential_minor, which sum to the printed tax, and approximate.

    Null without a table for year and status, or where income, dividends or tax are negative.
    """
    out = worksheet(with_table(rows), taxable, qualified, gain)
    sound = F.col("_from").isNotNull() & (F.col(taxable) >= 0) & (F.col(qualified) >= 0) & (F.col(printed) >= 0)
    ordinary = F.least(F.col("ordinary_tax"), F.col(printed))
    return out.select(
        *rows.columns, F.when(sound, ordinary).alias("ordinary_minor"), F.when(sound, F.col(printed) - ordinary).alias("preferential_minor"),
        F.when(sound, F.abs(F.col("worksheet_tax") - F.col(printed)) > NEAR_MINOR).alias("approximate"),
    )
