"""Queries of the tax form readers: forms are printed from sums of bills, read back, and compared with the sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthledger.functions.text import money_plain
from hearthledger.plans.registry import query
from hearthledger.plans.statements import cell, exploded, line, printed
from hearthledger.sources import tax_forms, words
from hearthledger.sources.fixtures import frame

# One form for each supplier and year: a file for each supplier, a page for each year.
_BASE = """SELECT CAST(l_suppkey AS BIGINT) AS supplier, CAST(year(l_shipdate) AS INT) AS y, CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS BIGINT) AS a, CAST(count(*) AS BIGINT) * 100 AS b,
  CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) % 50000) AS BIGINT) - 900000 AS g FROM lineitem GROUP BY l_suppkey, year(l_shipdate)"""


def _forms(s, d) -> DataFrame:
    base = frame(s, d, _BASE)
    of = lambda k: F.col("supplier") % 5 == k
    page, year = F.col("y") - 1991, (F.col("y") + 20).cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    a, b, g = money_plain(F.col("a")), money_plain(F.col("b")), money_plain(F.col("g"))
    row = lambda k, n, *cells: line(of(k), page, n, *cells)
    trades, summary = of(4) & (F.col("y") % 2 == 1), of(4) & (F.col("y") % 2 == 0)
    lines = [
        line(F.lit(True), page, 0, cell(0, "Prepared for you in year"), cell(200, year)), line(F.lit(True), page, 90, cell(0, "Copy B")),
        row(0, 2, cell(0, text("Form W-2 Wage and Tax Statement ", year))), row(0, 3, cell(0, text("Employer name: Acme ", F.col("supplier").cast("string")))), row(0, 4, cell(0, "Employer identification number 12-3456789")),
        row(0, 5, cell(0, text("1 Wages, tips, other compensation ........ ", a))), row(0, 6, cell(0, "2 Federal income tax withheld"), cell(300, "4 Social security tax withheld")), row(0, 7, cell(20, b), cell(320, "0.00")), row(0, 8, cell(0, "[X] Corrected")),
        row(1, 2, cell(0, text("Form 1099-INT ", year))), row(1, 3, cell(0, "Payer's name: Quay Bank")), row(1, 4, cell(0, text("1 Interest income ", a))), row(1, 5, cell(0, text("8 Tax-exempt interest ", b))), row(1, 6, cell(0, "4 Federal income tax withheld 0.00")), row(1, 7, cell(0, "Account number 0000-7788")),
        row(2, 2, cell(0, text("Form 1099-DIV ", year))), row(2, 3, cell(0, text("1a Total ordinary dividends ", a))), row(2, 4, cell(0, text("1b Qualified dividends ", b))), row(2, 5, cell(0, text("2a Total capital gain distr. ", b))),
        row(3, 2, cell(0, text("Form 1099-NEC ", year))), line(of(3) & (F.col("y") % 3 != 0), page, 3, cell(0, text("1 Nonemployee compensation ", a))), row(3, 4, cell(0, text("4 Federal income tax withheld ", b))),
        row(4, 2, cell(0, text("Form 1099-B ", year))),
        line(summary, page, 3, cell(0, text("Short-term covered ", a, " ", b, " 0.00 ", g))), line(summary, page, 4, cell(0, text("Net short-term gain 1.00"))),
        line(trades, page, 3, cell(0, "Short-term transactions")), line(trades, page, 4, cell(0, "10 SHS"), cell(100, text("1/2/2013 3/4/2013 ", a, " ", b, " ", g))), line(trades, page, 5, cell(0, "11 SHS"), cell(100, text("1/2/2013 3/4/2013 5.00 3.00 2.00"))),
        row(4, 6, cell(0, "Long-term transactions")), row(4, 7, cell(0, "12 SHS"), cell(100, "1/2/2003 3/4/2013 9.00 1.00 8.00")), row(4, 8, cell(0, text("Subtotal long-term box D ", b))), row(4, 9, cell(0, text("Subtotal long-term box D ", g))), row(4, 10, cell(0, "Subtotal long-term box E 4.00")),
    ]
    file = F.concat(F.lit("T"), F.col("supplier").cast("string")).alias("file_sha256")
    made = exploded(base, F.array(*lines), file)
    return tax_forms.segments(tax_forms.cleaned(words.rows_of(printed(made))))


_KEY = "concat('T', supplier) AS file_sha256, row_number() OVER (PARTITION BY supplier ORDER BY y) AS segment"
_SEEN = f"b AS (SELECT *, {_KEY} FROM ({_BASE}))"


def _box(k: int, form: str, box: str, category: str, tax: bool, memo: bool, amount: str, when: str = "TRUE") -> str:
    return f"SELECT file_sha256, segment, '{form}' AS form_type, '{box}' AS box, '{category}' AS category, {str(tax).lower()} AS is_tax, {str(memo).lower()} AS is_memo, {amount} AS amount_minor FROM b WHERE supplier % 5 = {k} AND {when}"


_ITEMS = " UNION ALL ".join([
    _box(0, "w2", "1", "salary_wages", False, False, "a"), _box(0, "w2", "2", "federal_income_tax_withheld", True, False, "b"),
    _box(1, "1099-int", "1", "interest", False, False, "a"), _box(1, "1099-int", "8", "other", False, True, "b"),
    _box(2, "1099-div", "1a", "ordinary_dividends", False, False, "a"), _box(2, "1099-div", "1b", "qualified_dividends", False, True, "b"), _box(2, "1099-div", "2a", "long_term_capital_gain", False, False, "b"),
    _box(3, "1099-nec", "1", "self_employment", False, False, "a", "y % 3 <> 0"), _box(3, "1099-nec", "4", "federal_income_tax_withheld", True, False, "b"),
])


@query("tax_form_items", f"WITH {_SEEN} {_ITEMS}")
def _(s, d):
    return tax_forms.items(tax_forms.boxes(_forms(s, d))).select("file_sha256", "segment", "form_type", "box", "category", "is_tax", "is_memo", "amount_minor")


@query("tax_form_heads", f"WITH {_SEEN} SELECT file_sha256, segment, CASE supplier % 5 WHEN 0 THEN 'w2' WHEN 1 THEN '1099-int' WHEN 2 THEN '1099-div' WHEN 3 THEN '1099-nec' ELSE '1099-b' END AS form_type, CASE supplier % 5 WHEN 0 THEN concat('Acme ', supplier) WHEN 1 THEN 'Quay Bank' END AS payer_name, CASE WHEN supplier % 5 = 0 THEN '6789' END AS payer_tin_last4, CASE WHEN supplier % 5 = 1 THEN '7788' END AS account_last4, supplier % 5 = 0 AS is_corrected, true AS is_copy FROM b")
def _(s, d):
    return tax_forms.identities(_forms(s, d))


@query("tax_form_years", f"WITH {_SEEN} SELECT file_sha256, CAST(min(y) + 20 AS INTEGER) AS tax_year FROM b GROUP BY file_sha256")
def _(s, d):
    return tax_forms.years(_forms(s, d))


@query("tax_form_detection", f"WITH {_SEEN} SELECT DISTINCT file_sha256, CASE supplier % 5 WHEN 0 THEN 'w2' WHEN 1 THEN '1099-int' WHEN 2 THEN '1099-div' WHEN 3 THEN '1099-nec' ELSE '1099-b' END AS form_type FROM b")
def _(s, d):
    return tax_forms.detection(_forms(s, d).drop("segment", "form_type"))


@query("tax_forms_incomplete", f"WITH {_SEEN} SELECT file_sha256, segment, '1099-nec' AS form_type, (SELECT count(*) FROM b c WHERE c.supplier = b.supplier AND y % 3 <> 0) = 0 AS alone FROM b WHERE supplier % 5 = 3 AND y % 3 = 0")
def _(s, d):
    rows = _forms(s, d)
    return tax_forms.incomplete(rows.select(*tax_forms.SEGMENT, "form_type").distinct(), tax_forms.boxes(rows))


@query("tax_broker_totals", f"WITH {_SEEN} SELECT file_sha256, segment, 'short' AS term, CASE WHEN y % 2 = 0 THEN g ELSE g + 200 END AS gain_minor, CASE WHEN y % 2 = 0 THEN 'summary' ELSE 'trades' END AS source, g - (a - b) AS off_minor FROM b WHERE supplier % 5 = 4 UNION ALL SELECT file_sha256, segment, 'long', g + 400, 'subtotal', NULL FROM b WHERE supplier % 5 = 4")
def _(s, d):
    return tax_forms.term_totals(_forms(s, d))


_N = lambda when, x: f"CASE WHEN {when} THEN {x} END"
_RETURNS = f"""SELECT o_orderkey AS id, CAST(2022 + o_orderkey % 5 AS INT) AS tax_year, CASE o_custkey % 5 WHEN 0 THEN 'single' WHEN 1 THEN 'mfj' WHEN 2 THEN 'mfs' WHEN 3 THEN 'hoh' END AS filing_status, p,
  {_N('o_orderkey % 3 > 0', 'p')} AS wages, p + 1 AS wages_1a, {_N('o_orderkey % 4 > 0', 'o_orderkey % 900')} AS taxable_interest, o_orderkey % 700 AS ordinary_dividends, o_orderkey % 300 AS qualified_dividends, {_N('o_orderkey % 7 = 0', '5000')} AS ira_taxable,
  {_N('o_orderkey % 11 = 0', '7000')} AS pension_taxable, {_N('o_orderkey % 13 = 0', '100')} AS ss_taxable, {_N('o_orderkey % 2 = 0', '(o_orderkey % 5 - 2) * 1000')} AS capital_gain, {_N('o_orderkey % 6 > 1', 'o_orderkey % 5000')} AS other_income,
  {_N('o_orderkey % 5 > 0', 'p + o_orderkey % 900')} AS total_income, {_N('o_orderkey % 9 = 0', '-400')} AS d_short_term, {_N('o_orderkey % 10 = 0', '900')} AS d_long_term, {_N('o_orderkey % 20 = 0', '500')} AS d_combined, {_N('o_orderkey % 8 > 4', '(o_orderkey % 8 - 6) * 2000')} AS business,
  p AS taxable_income, p DIV 6 AS income_tax, {_N('o_orderkey % 12 > 0', 'p DIV 5')} AS total_tax, {_N('o_orderkey % 3 = 0', 'p DIV 7')} AS withheld_total, {_N('o_orderkey % 5 = 0', '300')} AS withheld_w2, {_N('o_orderkey % 5 < 2', '20')} AS withheld_1099, CAST(NULL AS BIGINT) AS withheld_other,
  CAST(NULL AS BIGINT) AS estimated_payments, p DIV 5 + (o_orderkey % 3 - 1) * 1000 AS total_payments, {_N('o_orderkey % 3 = 2', '1000')} AS overpaid, {_N('o_orderkey % 6 = 2', '400')} AS refunded, {_N('o_orderkey % 4 = 0', '600')} AS applied, {_N('o_orderkey % 7 < 2', '1000')} AS owed
FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS p FROM orders) t"""


@query("tax_return_items", "WITH r AS (" + _RETURNS.replace(" DIV ", " // ") + """), e AS (SELECT *, d_short_term IS NOT NULL OR d_long_term IS NOT NULL AS has_d, coalesce(wages, wages_1a) AS w, greatest(coalesce(business, 0), 0) AS bz, coalesce(overpaid, CASE WHEN refunded IS NOT NULL OR applied IS NOT NULL THEN coalesce(refunded, 0) + coalesce(applied, 0) END) AS ov FROM r),
f AS (SELECT *, coalesce(ira_taxable, 0) + coalesce(pension_taxable, 0) + coalesce(ss_taxable, 0) + CASE WHEN other_income IS NULL THEN 0 ELSE greatest(other_income - bz, 0) END AS oth, coalesce(withheld_total, CASE WHEN coalesce(withheld_w2, withheld_1099) IS NOT NULL THEN coalesce(withheld_w2, 0) + coalesce(withheld_1099, 0) END) AS wh,
  CASE WHEN refunded IS NOT NULL THEN refunded WHEN overpaid IS NOT NULL THEN greatest(overpaid - coalesce(applied, 0), 0) END AS rf, w + coalesce(taxable_interest, 0) + ordinary_dividends + coalesce(ira_taxable, 0) + coalesce(pension_taxable, 0) + coalesce(ss_taxable, 0) + coalesce(capital_gain, 0) + coalesce(other_income, 0) AS rep FROM e)
SELECT id, nullif(w, 0) AS salary_wages, nullif(taxable_interest, 0) AS interest, CASE WHEN has_d THEN nullif(d_short_term, 0) END AS short_term_capital_gain, CASE WHEN has_d THEN nullif(d_long_term, 0) ELSE nullif(capital_gain, 0) END AS long_term_capital_gain, nullif(bz, 0) AS self_employment, nullif(oth, 0) AS other,
  nullif(wh, 0) AS federal_income_tax_withheld, nullif(rf, 0) AS refund, nullif(owed, 0) AS amount_owed,
  CAST((business IS NOT NULL AND business < 0) AS INT) + CAST(coalesce(abs(rep - total_income) > 100, false) AS INT) + CAST((coalesce(ov, 0) > 0 AND coalesce(owed, 0) > 0) AS INT) + CAST(coalesce(abs(ov - refunded - coalesce(applied, 0)) > 100, false) AS INT)
  + CAST(coalesce(abs(coalesce(ov, 0) - greatest(total_payments - total_tax, 0)) > 100 OR abs(coalesce(owed, 0) - greatest(total_tax - total_payments, 0)) > 100, false) AND total_tax IS NOT NULL AS INT) AS n_warnings FROM f""")  # fmt: skip
def _(s, d):
    out = tax_forms.return_items(frame(s, d, _RETURNS))
    return out.select("id", "salary_wages", "interest", "short_term_capital_gain", "long_term_capital_gain", "self_employment", "other", "federal_income_tax_withheld", "refund", "amount_owed", F.size("warnings").alias("n_warnings"))
