"""Small scenarios of the ledger's operators."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from hearthledger.functions import text as T
from hearthledger.functions.periods import period
from hearthledger.operators import classify, ledger, networth, spend, tax
from hearthledger.sources import export, words
from hearthledger.streaming.ingest import ingest


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def txns(spark, rows):
    schema = "id long, account_id long, user_id long, posted_date date, kind string, amount_minor long, currency string, category_id int, subcategory_id int, merchant_key string, merchant_canonical string, description_clean string, needs_review boolean"
    full = [(i, 1, 1, d, k, a, "USD", c, s, m, None, t, False) for i, (d, k, a, c, s, m, t) in enumerate(rows)]
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="module")
def taxonomy(spark):
    cats = spark.createDataFrame([(1, "food")], "id int, key string")
    subs = spark.createDataFrame([(10, "a", "active", None), (11, "b", "merged", 10), (12, "c", "merged", 99)], "id int, key string, status string, merged_into int")
    return cats, subs


def test_refunds_are_netted_and_other_kinds_left_out(spark, taxonomy):
    d = date(2024, 3, 9)
    rows = txns(spark, [(d, "purchase", 4210, 1, 10, "m", ""), (d, "refund", -875, 1, 10, "m", ""), (d, "transfer", 61, 1, 10, "m", "")])
    assert values(spend.spend(rows, *taxonomy), "period", "category", "total_minor", "txn_count", "avg_minor") == [("2024-03", "food", 3335, 2, 1667)]
    plain = spend.SpendQuery(net_refunds=False)
    assert values(spend.spend(rows, *taxonomy, plain), "total_minor") == [(4210,)]


def test_average_truncates_toward_zero(spark, taxonomy):
    d = date(2026, 1, 1)
    rows = txns(spark, [(d, "refund", -3, 1, 10, "m", ""), (d, "refund", -4, 1, 10, "m", "")])
    assert values(spend.spend(rows, *taxonomy), "avg_minor") == [(-3,)]


def test_merged_subcategories_resolve_one_level(spark, taxonomy):
    d = date(2026, 1, 1)
    rows = txns(spark, [(d, "purchase", 640, 1, 10, "m", ""), (d, "purchase", 87, 1, 11, "m", ""), (d, "fee", 7, 1, 12, "m", "")])
    out = spend.spend(rows, *taxonomy, spend.SpendQuery(group_by=("subcategory",)))
    assert {(r.subcategory, r.total_minor) for r in out.collect()} == {("a", 727), (None, 7)}


def test_empty_membership_matches_nothing_and_bad_names_raise(spark, taxonomy):
    rows = txns(spark, [(date(2026, 1, 1), "purchase", 1, 1, 10, "m", "")])
    assert spend.spend(rows, *taxonomy, spend.SpendQuery(user_ids=())).count() == 0
    for bad in ({"grain": "decade"}, {"group_by": ("id; drop",)}, {"kinds": ("gift",)}):
        with pytest.raises(ValueError):
            spend.SpendQuery(**bad)


@pytest.mark.parametrize("grain, want", [("day", "2024-11-27"), ("week", "2024-W48"), ("month", "2024-11"), ("quarter", "2024-Q4"), ("year", "2024"), ("all", "all")])
def test_periods(spark, grain, want):
    df = spark.createDataFrame([(date(2024, 11, 27),)], "d date")
    assert df.select(period("d", grain)).first()[0] == want


def test_weeks_are_those_of_strftime(spark):
    df = spark.sql("SELECT explode(sequence(DATE'2019-12-25', DATE'2025-01-10')) AS d").withColumn("w", period("d", "week"))
    assert all(r.w == r.d.strftime("%Y-W%W") for r in df.collect())


def test_search_is_literal(spark):
    df = spark.createDataFrame([("100%_off",), ("100x off",), ("It's",)], "t string")
    assert [r.t for r in df.where(T.contains_literal("t", "100%_OFF")).collect()] == ["100%_off"]


def test_plans_have_pruned_scans_and_no_python(spark, sf_dir, taxonomy):
    from hearthledger.plans import queries

    plan = queries.QUERIES["agg_spend_by_month_category"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "o_orderstatus" not in plan.split("ReadSchema")[-1]


def test_carry_forward_makes_nothing_up(spark):
    e = spark.createDataFrame([(1, "checking", "a", 2025, 1, 100, "USD"), (1, "checking", "a", 2025, 3, 50, "USD"), (1, "credit_card", "c", 2025, 2, 30, "USD")], "user_id long, category string, account_name string, year int, month int, balance_minor long, currency string")
    out = networth.with_change(networth.totals(networth.monthly(e)))
    assert values(out, "period", "assets_minor", "liabilities_minor", "net_minor") == [("2025-01", 100, 0, 100), ("2025-02", 100, 30, 70), ("2025-03", 50, 30, 20)]
    assert networth.snapshot(e, 2024, 12).count() == 0
    assert values(networth.snapshot(e, 2025, 2), "account_name", "as_of", "carried") == [("a", "2025-01", True), ("c", "2025-02", False)]


@pytest.mark.parametrize("short, long, want", [(-500_000, 0, (-300_000, 0, 200_000)), (-100, -200, (-100, -200, 0)), (-400_000, -100_000, (-200_000, -100_000, 200_000)), (-900_000, 100_000, (-400_000, 100_000, 500_000))])
def test_loss_limit(spark, short, long, want):
    df = spark.createDataFrame([(short, long)], "s long, l long")
    assert tuple(df.select(*tax.limited(F.col("s"), F.col("l"))).first()) == want


def test_two_equal_coffees_and_an_overlap(spark):
    schema = "statement_id long, account_id long, posted_date date, amount_minor long, description_raw string, ordinal int"
    d = date(2026, 1, 2)
    first = ledger.hashed(spark.createDataFrame([(1, 1, d, 450, "COFFEE", 1), (1, 1, d, 450, "COFFEE", 2)], schema))
    assert first.select("dedupe_hash").distinct().count() == 2
    second = ledger.hashed(spark.createDataFrame([(2, 1, d, 450, "COFFEE", 1), (2, 1, d, 450, "COFFEE", 2), (2, 1, d, 450, "COFFEE", 3)], schema))
    assert values(ledger.new_rows(second, first), "occurrence_index") == [(2,)]


def test_pairing_takes_the_nearest(spark):
    rows = [(1, 1, date(2026, 1, 10), "checking", "transfer", 500), (2, 1, date(2026, 1, 12), "credit", "payment", -500), (3, 1, date(2026, 1, 11), "credit", "payment", -500), (4, 1, date(2026, 2, 1), "credit", "payment", -500), (5, 1, date(2026, 1, 9), "checking", "transfer", 500)]
    df = spark.createDataFrame(rows, "id long, user_id long, posted_date date, account_type string, kind string, amount_minor long")
    assert values(ledger.paired(df), "transfer_id", "payment_id") == [(1, 3), (5, 2)]


def _fixpoint(transfers, payments, days=5):
    """Mutual choice, round by round, until no candidate is left."""
    out = set()
    while True:
        near = [(t, p) for t in transfers for p in payments if t[1:3] == p[1:3] and abs((t[3] - p[3]).days) <= days]
        if not near:
            return out
        gap = lambda x: abs((x[0][3] - x[1][3]).days)
        mine = {t: min((x for x in near if x[0] == t), key=lambda x: (gap(x), x[1][3], x[1][0]))[1] for t, _ in near}
        theirs = {p: min((x for x in near if x[1] == p), key=lambda x: (gap(x), x[0][3], x[0][0]))[0] for _, p in near}
        both = {(t, p) for t, p in mine.items() if theirs[p] == t}
        out |= {(t[0], p[0]) for t, p in both}
        transfers, payments = [t for t in transfers if t not in {x[0] for x in both}], [p for p in payments if p not in {x[1] for x in both}]


def test_pairing_leaves_no_candidate(spark):
    """Many equal rows of one day, and chains of days, against the rounds done plainly."""
    rng = random.Random(11)
    rows = [(i, 1, 500, date(2026, 1, 10)) for i in range(40)]
    rows += [(100 + i, rng.randint(2, 5), rng.choice((500, 700)), date(2026, 1, 1) + timedelta(rng.randint(0, 25))) for i in range(240)]
    transfers, payments = [r for r in rows if r[0] % 2], [r for r in rows if not r[0] % 2]
    data = [(i, u, d, "checking", "transfer", a) for i, u, a, d in transfers] + [(i, u, d, "credit", "payment", -a) for i, u, a, d in payments]
    df = spark.createDataFrame([*data, data[0], (None, 1, date(2026, 1, 10), "credit", "payment", -500)], "id long, user_id long, posted_date date, account_type string, kind string, amount_minor long")
    assert values(ledger.paired(df), "transfer_id", "payment_id") == sorted(_fixpoint(transfers, payments))


@pytest.mark.parametrize("text, want", [("1,234.56", 123456), ("(12.00)", -1200), ("-5", -500), ("5.00-", -500), ("7.10 CR", -710), ("$0.99", 99), ("(-3.00)", -300), ("abc", None), ("", None), ("1.005", None), ("1,23", None), (",5", None), ("12.34 cr", -1234), ("(1.00) CR", -100), ("(5", None)])
def test_money(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.money_minor(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("raw, gone", [("PAY a.b@c.org now", "a.b@c.org"), ("CARD 4111111111111111", "4111111111111111"), ("CALL +1 (555) 123-4567", "123-4567"), ("FOR $12.50", "$12"), ("ORDER 1234567 X", "1234567"), ("SHOP REF#99A", "REF#99A")])
def test_redaction(spark, raw, gone):
    df = spark.createDataFrame([(raw,)], "t string")
    out = df.select(T.description(F.col("t"))).first()[0]
    assert gone not in out and raw.split()[0] in out


@pytest.mark.parametrize("clean, want", [("Blue Bottle #123", "blue bottle"), ("SHELL 5521", "shell"), ("7 Eleven", "7 eleven"), ("76", "76"), ("CAFÉ Olé", "café olé")])
def test_merchant_keys(spark, clean, want):
    df = spark.createDataFrame([(clean,)], "t string")
    assert df.select(T.merchant_key(F.col("t"))).first()[0] == want


def test_cascade_order(spark):
    rules = lambda rows: spark.createDataFrame(rows, "id int, priority int, match_type string, pattern string, category string, subcategory string, enabled boolean")
    t = spark.createDataFrame([(1, "shop-a", "purchase"), (2, "shop-b", "purchase"), (3, "shop-a", "payment"), (4, "", "purchase"), (5, "shop-c", "purchase")], "id long, merchant_key string, kind string")
    known = spark.createDataFrame([("shop-a", "x", "y", 1.0, "user"), ("shop-b", "x", "z", 1.0, "user"), ("shop-c", "m", "n", 0.5, "llm")], "merchant_key string, category string, subcategory string, confidence double, source string")
    out = classify.cascade(t, rules([(1, 5, "exact", "SHOP-A", "u", "v", True)]), known, rules([(9, 1, "contains", "shop-b", "p", "q", True)]))
    assert values(out, "id", "classified_by", "needs_review") == [(1, "user_rule", False), (2, "user", False), (3, "kind", False), (4, "llm", True), (5, "cache", True)]


def test_words_to_transactions(spark):
    lines = [("01/05 COFFEE SHOP 4.50", 10.0), ("DOWNTOWN", 20.0), ("01/06 REFUND -2.00", 30.0), ("not a row", 0.0)]
    rows = [("f", 1, w, 10.0 * i, 10.0 * i + 8, top, top + 8) for line, top in lines for i, w in enumerate(line.split())]
    df = spark.createDataFrame(rows, "file_sha256 string, page_number int, text string, x0 double, x1 double, top double, bottom double")
    out = words.transactions_of(words.rows_of(df), 2026)
    assert values(out, "posted_date", "amount_minor", "description_raw") == [(date(2026, 1, 5), 450, "COFFEE SHOP DOWNTOWN"), (date(2026, 1, 6), -200, "REFUND")]


def test_a_column_without_cells_keeps_its_role(spark):
    from hearthledger.sources import layouts

    def printed(file, names, *rows):
        lines = [names, *[{0: f"01/0{i}/2026", 90: "SHOP", **row} for i, row in enumerate(rows, 1)]]
        return [(file, 1, w, float(x), x + 6.0 * len(w) - 0.5, 12.0 * i, 12.0 * i + 10) for i, line in enumerate(lines) for x, w in line.items()]

    names, shop = {240: "Debit", 340: "Credit", 440: "Balance"}, {0: "Date", 90: "Details"}
    files = [
        printed("credits", shop | names, {340: "5.00", 440: "105.00"}, {340: "7.00"}, {340: "1.00", 440: "113.00"}),
        printed("debits", shop | names, {240: "5.00", 440: "95.00"}, {240: "7.00"}, {240: "1.00", 440: "87.00"}),
        printed("pair", shop | {240: "Withdrawals", 340: "Deposits"}, {340: "5.00"}, {340: "7.00"}, {340: "1.00"}),
        # What no pair of names tells stays as it is: one column of amounts is signed.
        printed("signed", shop | {240: "Credit", 440: "Amount"}, {440: "5.00"}, {440: "-7.00"}, {440: "1.00"}),
        printed("turned", shop | {240: "Credit", 340: "Debit"}, {340: "5.00"}, {340: "7.00"}, {340: "1.00"}),
        printed("before", shop | {180: "Amount"} | {240: "Debit", 340: "Credit"}, {180: "5.00"}, {180: "-7.00"}, {180: "1.00"}),
        # A column that has cells gets its role from them, whatever its name.
        printed("both", shop | names, {240: "5.00", 440: "95.00"}, {340: "7.00"}, {240: "1.00", 440: "101.00"}),
    ]
    df = spark.createDataFrame([w for file in files for w in file], "file_sha256 string, page_number int, text string, x0 double, x1 double, top double, bottom double")
    got = layouts.generic(words.rows_of(df)).collect()
    assert all(r["error"] is None and r["description_raw"] == "SHOP" for r in got)
    read = {f: [(r["amount_minor"], r["balance_minor"]) for r in sorted(got, key=lambda r: r["ordinal"]) if r["file_sha256"] == f] for f in {r["file_sha256"] for r in got}}
    assert read == {
        "credits": [(-500, 10500), (-700, None), (-100, 11300)], "debits": [(500, 9500), (700, None), (100, 8700)], "pair": [(-500, None), (-700, None), (-100, None)],
        "signed": [(500, None), (-700, None), (100, None)], "turned": [(500, None), (700, None), (100, None)], "before": [(500, None), (-700, None), (100, None)], "both": [(500, 9500), (-700, None), (100, 10100)],
    }


def test_page_numbers():
    assert words.page_numbers("3,1-2, 2") == [1, 2, 3]
    for bad in ("0", "3-1", "1-9999999", "x"):
        with pytest.raises(ValueError):
            words.page_numbers(bad)


def test_export_has_no_mask(spark, tmp_path):
    df = txns(spark, [(date(2026, 1, 1), "purchase", 1, 1, 10, "m", "")]).withColumn("mask", F.lit("1234"))
    export.export(df, str(tmp_path / "out"))
    assert "mask" not in spark.read.option("header", True).csv(str(tmp_path / "out")).columns


def test_ingest_twice_adds_once(spark, tmp_path):
    schema = "statement_id long, account_id long, posted_date date, amount_minor long, description_raw string, ordinal int"
    d = date(2026, 1, 2)
    one = spark.createDataFrame([(1, 1, d, 450, "COFFEE", 1), (1, 1, d, 450, "COFFEE", 2)], schema).coalesce(1)
    two = spark.createDataFrame([(2, 1, d, 450, "COFFEE", 1), (2, 1, d, 99, "TEA", 2)], schema).coalesce(1)
    one.write.mode("append").parquet(str(tmp_path / "in"))
    args = (str(tmp_path / "in"), one.schema, str(tmp_path / "to"), str(tmp_path / "cp"))
    ingest(spark, *args).awaitTermination()
    two.write.mode("append").parquet(str(tmp_path / "in"))
    ingest(spark, *args).awaitTermination()
    ingest(spark, *args).awaitTermination()
    got = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "to"))
    assert values(got, "description_raw", "occurrence_index") == [("COFFEE", 0), ("COFFEE", 1), ("TEA", 0)]


@pytest.mark.parametrize("n, d", [(33335, 100000), (1, 32), (3, 32), (-1, 32), (12345, 100000), (1, 3), (2, 3), (99995, 100000), (5, 100000), (15, 100000), (1, 20000), (7, 4), (123456789, 1000), (0, 5), (1, 30000), (4_100_050_000, 8_200_000_000)])
def test_rates_round_as_doubles_do(spark, n, d):
    df = spark.createDataFrame([(n, d)], "n bigint, d bigint")
    assert df.select(tax.rate(F.col("n"), F.col("d"))).first()[0] == round(n / d, 4)


def test_rates_of_nothing_are_null(spark):
    df = spark.createDataFrame([(1, 0), (1, -5), (None, 7)], "n bigint, d bigint")
    assert [r[0] for r in df.select(tax.rate(F.col("n"), F.col("d"))).collect()] == [None] * 3


def test_warnings_have_their_tolerance(spark):
    forms = spark.createDataFrame([(1, 1, 2024, 1, "source", "w2", 0), (2, 1, 2024, 2, "return", "1040", 0), (3, 2, 2024, 3, "return", "1040", 1)], "id long, user_id long, tax_year int, document_id long, role string, form_type string, is_corrected int")
    income = spark.createDataFrame([(1, "salary_wages", 50_100, False), (2, "salary_wages", 50_000, False), (1, "interest", 900, False), (2, "interest", 1_001, False), (2, "other", 999, False)], "form_id long, category string, amount_minor long, is_memo boolean")
    taxes = spark.createDataFrame([(1, "federal_income_tax_withheld", 10), (2, "federal_income_tax_withheld", 111)], "form_id long, category string, amount_minor long")
    got = {r["user_id"]: r for r in tax.year_summary(forms, income, taxes).collect()}
    assert [w[:13] for w in got[1]["warnings"]] == ["1099 interest", "Federal tax w"] and "$1.01 less" in got[1]["warnings"][0]
    assert got[1]["federal_income_tax_withheld"] == 10 and got[1]["salary_wages"] == 50_000
    assert [w[:6] for w in got[2]["warnings"]] == ["No W-2", "1 form"] and got[2]["basis"] == "return"


def test_compatibility_characters_become_plain(spark):
    from hearthledger.functions import privacy

    df = spark.createDataFrame([("ﬁn １２３ Å",), (None,)], "t string")
    assert [r[0] for r in df.select(privacy.nfkc(F.col("t"))).collect()] == ["fin 123 Å", None]


def test_entries_are_replaced_in_one_pass(spark):
    """Against Python's own expressions, the longest entry first."""
    from hearthledger.functions import privacy

    texts = ["Name 5550107788 and NAME", "Ann Lee-Fox, ann lee-fox; Lee-Fox Ann B.", "1-555-010-7788 x15550107788", "no", "Flat 4, Flat 44", "a@b Ann", "", "A Ann Lee-Fox!"]
    own = ["NAME", "555-010-7788", "Ann Lee-Fox", "Flat 4", "A"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["x"]["text"] for r in df.select("i", privacy.personal(F.col("t"), own).alias("x")).orderBy("i").collect()]
    assert got == ["[REDACTED] [PHONE] and [REDACTED]", "[NAME], [NAME]; [NAME]", "[PHONE] x[PHONE]", "no", "[REDACTED], Flat 44", "a@b Ann", "", "A [NAME]!"]
    assert privacy.entries(["Ann ", "ann"], [None, "", "Bo"]) == ["Ann", "Bo"]


def test_aliases_tolerate_anything(spark):
    from hearthledger.functions import privacy

    df = spark.createDataFrame([('["a", "b"]',), ("{",), ("3",), (None,), ("[]",)], "t string")
    assert [r[0] for r in df.select(privacy.aliases(F.col("t"))).collect()] == [["a", "b"], [], [], [], []]


def test_pages_for_a_model(spark):
    from hearthledger.functions import privacy

    df = spark.createDataFrame([("card 4111 1111 1111 1234 on 2026-01-15 paid 1,234.56 to a@b.co.uk ref 12345678",)], "t string")
    assert df.select(privacy.for_model(F.col("t"))).first()[0] == "card XXXX1234 on 2026-01-15 paid 1,234.56 to [email] ref XXXX5678"


@pytest.mark.parametrize("hint, clean, amount, account, want", [
    (None, "ALDER CARD PYMT", 5, "checking", "purchase"), (None, "ALDER CARD 12 PMTS", 5, "checking", "purchase"), (None, "AUTOPAY", 5, "checking", "transfer"), (None, "AUTOPAY", 5, "credit", "payment"),
    ("payment_or_refund", "thank you", -5, "credit", "refund"), ("fee", "AUTOPAY", 5, "credit", "fee"), (None, "SERVICE FEES WAIVED", 5, "credit", "purchase"), (None, "refund?", -1, "credit", "refund"),
])
def test_kinds(spark, hint, clean, amount, account, want):
    df = spark.createDataFrame([(hint, clean, amount, account)], "h string, c string, a bigint, t string")
    assert df.select(T.kind(F.col("h"), F.col("c"), F.col("a"), F.col("t"), ["Alder Card", " "])).first()[0] == want


def test_a_model_is_asked_again_for_what_it_leaves_out(spark):
    asked = spark.createDataFrame([(f"k{i:03d}", f"text {i}") for i in range(70)], "merchant_key string, description string").coalesce(1)

    def model(texts):
        good = [t for t in texts if not t.endswith("7")]
        rows = [{"id": texts.index(t) + 1, "category": "c", "subcategory": "s", "confidence": 0.9} for t in good]
        if len(texts) > 10:
            rows = [r for r in rows if r["id"] % 5] + [{"id": 1, "category": "c", "subcategory": "s", "confidence": 0.9}, "junk", {"id": 999}]
        return rows

    got = classify.ask(asked, model).collect()
    assert len(got) == 70 and {r["merchant_key"] for r in got if r["needs_review"]} == {f"k{i:03d}" for i in range(7, 70, 10)}

    def failing(texts):
        raise RuntimeError

    assert all(r["needs_review"] and r["category"] == "others" for r in classify.ask(asked, failing).collect())


def test_specs_are_checked():
    from hearthledger.sources.layouts import Spec

    row = r"^(?P<date>\S+) (?P<description>.*) (?P<amount>\S+)$"
    Spec("x", (), row)
    for bad in (dict(row=r"(?P<date>x)"), dict(row=row, stop="(a+)+"), dict(row=row, start="x" * 201)):
        with pytest.raises(ValueError):
            Spec("x", (), **bad)


def test_figures_of_a_model_must_be_printed(spark):
    from hearthledger.operators import tax_identity

    pages = spark.createDataFrame([(1, "Wages 1,234.50 and 77")], "document_id long, text string")
    items = spark.createDataFrame([(1, 123450), (1, 7700), (1, 5), (2, 7700)], "document_id long, amount_minor long")
    assert values(tax_identity.grounded(items, pages), "amount_minor") == [(7700,), (123450,)]
    one = spark.createDataFrame([("f", 0, "w2", None, "1234", ["a:1", "b:2"]), ("f", 1, "w2", "9", None, ["z:1"]), ("f", 2, "int", None, None, ["a:1"])], "file_sha256 string, ordinal int, form_type string, account_last4 string, payer_tin_last4 string, figures array<string>")
    two = spark.createDataFrame([("f", "w2", "8", "1234", ["b:2", "q:1"])], "file_sha256 string, form_type string, account_last4 string, payer_tin_last4 string, figures array<string>")
    assert values(tax_identity.reread(one, two), "ordinal", "duplicate") == [(0, True), (1, False), (2, False)]
