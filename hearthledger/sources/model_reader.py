"""Statements read by a model, for files that no layout fits: pages are made safe, packed into requests, answered as JSON, and checked row by row.

The model is a function that is handed in (a column of prompts to a column of answers); answers are written before they are read, so that a task that is run again does not ask again for those that are there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthledger.functions import dates, privacy
from hearthledger.functions.text import decimal_minor, squeezed
from hearthledger.sources.tables import kept
from hearthledger.sources.words import PAGE

#: Characters of a request, about; a longer page goes alone.
BUDGET = 12_000
#: What an answer says of the statement, and of its rows.
SAID = ("issuer", "period_start", "period_end", "opening_balance", "closing_balance")
ANSWER = ", ".join(f"{c} string" for c in SAID) + ", transactions array<struct<date: string, description: string, amount: string, kind: string>>"
KINDS = ("purchase", "payment", "refund", "fee", "interest", "transfer", "adjustment")
# Fixed value: labels beside or above a person's name, address and number.
IDENTITY = r"(?i)\b(?:employee|recipient|taxpayer|borrower|payee|your|spouse)(?:'s|s')?\s+(?:first\s+|last\s+|full\s+)?(?:name|address|social\s+security\s+(?:number|no\.?)|identification\s+number|ssn|tin)\b|\bstreet\s+address\b|\bcity\s+or\s+town\b"
#: Points below a label that its value may stand.
IDENTITY_REACH = 30.0


def without_identity(rows: DataFrame) -> DataFrame:
    """rows without what says who a form is for: rows with such a label, and the words under it, to `IDENTITY_REACH`, that are no amounts."""
    page = Window.partitionBy(*PAGE).orderBy("row_number")
    labelled = F.col("text").rlike(IDENTITY)
    extent = F.struct(F.col("top"), F.col("words")[0]["x0"].alias("x0"), F.array_max(F.transform("words", lambda w: w["x1"])).alias("x1"))
    rows = rows.withColumns({"_is": labelled, "_label": F.last(F.when(labelled, extent), True).over(page)})
    under = F.col("_label").isNotNull() & (F.col("top") - F.col("_label.top") <= IDENTITY_REACH)
    amount = lambda w: w["text"].rlike(r"^[($-]*\d[\d,]*\.\d{2}\)?$")
    left = F.when(under, F.filter("words", lambda w: amount(w) | (w["x1"] < F.col("_label.x0")) | (w["x0"] > F.col("_label.x1")))).otherwise(F.col("words"))
    rows = rows.where("not _is").withColumn("words", left).where(F.size("words") > 0)
    return rows.withColumn("text", F.array_join(F.transform("words", lambda w: w["text"]), " ")).drop("_is", "_label")


def pages_of(rows: DataFrame) -> DataFrame:
    """(file_sha256, page_number, text): the rows of each page as lines."""
    lines = F.array_sort(F.collect_list(F.struct("row_number", "text")))
    return rows.groupBy(*PAGE).agg(F.array_join(F.transform(lines, lambda r: r["text"]), "\n").alias("text"))


def requests(pages: DataFrame, own: Iterable[str] = (), budget: int = BUDGET) -> DataFrame:
    """(file_sha256, request, first_page, last_page, prompt): safe pages of a file in order, as many to a request as its budget holds."""
    safe = pages.select(*PAGE, privacy.for_model(F.col("text"), own).alias("text"))
    files = safe.groupBy("file_sha256").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("_p"))
    start = F.struct(F.lit(0).alias("request"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("of"))

    def step(acc: Column, p: Column) -> Column:
        n = F.length(p["text"])
        new = (acc["used"] == 0) | (acc["used"] + n > budget)
        number = acc["request"] + new.cast("int")
        return F.struct(number.alias("request"), F.when(new, n).otherwise(acc["used"] + n).alias("used"), F.concat(acc["of"], F.array(number)).alias("of"))

    placed = files.withColumn("_of", F.aggregate("_p", start, step)["of"]).select("file_sha256", F.explode(F.arrays_zip("_p", "_of")).alias("_z"))
    each = placed.select("file_sha256", F.col("_z._of").alias("request"), F.col("_z._p.page_number").alias("page_number"), F.col("_z._p.text").alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda r: r["text"]), "\n")
    return each.groupBy("file_sha256", "request").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), text.alias("prompt"))


def answers(asked: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """asked with `answer`, written."""
    return kept(asked.withColumn("answer", model(F.col("prompt"))), "model-answers")


def read(answered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transactions, files) of answers.

    transactions: file_sha256, ordinal, request, posted_date, description_raw, amount_minor, kind_hint; in the order of requests and of rows within them. files: file_sha256, issuer, period_start, period_end,
    opening_balance_minor, closing_balance_minor (each from the first request that has it), n_requests, n_unreadable (answers that are no JSON object), n_rejected (rows without a date, an
    amount or a description). A kind that is not known is left open.
    """
    text = F.regexp_extract("answer", r"(?s)(\{.*\})", 1)  # what stands around the object does not count
    parsed = answered.select("file_sha256", "request", F.from_json(F.when(text != "", text), ANSWER, {"mode": "PERMISSIVE"}).alias("_a"))
    sound = F.coalesce(F.col("_a.transactions").cast("string"), *[F.col(f"_a.{c}") for c in SAID]).isNotNull()
    date = lambda raw: F.coalesce(F.try_to_date(raw, "yyyy-MM-dd"), dates.full(raw))
    rows = parsed.select("file_sha256", "request", F.posexplode("_a.transactions").alias("_i", "_t"))
    rows = rows.select(
        "file_sha256", "request", "_i", date(F.col("_t.date")).alias("posted_date"), F.nullif(squeezed(F.col("_t.description")), F.lit("")).alias("description_raw"), decimal_minor(F.col("_t.amount")).alias("amount_minor"),
        F.when(F.lower("_t.kind").isin(*KINDS), F.lower("_t.kind")).alias("kind_hint"),
    )
    good = F.col("posted_date").isNotNull() & F.col("description_raw").isNotNull() & F.col("amount_minor").isNotNull()
    rejected = rows.where(~good).groupBy("file_sha256").agg(F.count("*").alias("n_rejected"))
    ordinal = F.row_number().over(Window.partitionBy("file_sha256").orderBy("request", "_i"))
    transactions = rows.where(good).select("file_sha256", ordinal.alias("ordinal"), "request", "posted_date", "description_raw", "amount_minor", "kind_hint")
    first = lambda v, name: F.min_by(v, F.when(v.isNotNull(), F.col("request"))).alias(name)
    said = lambda c: F.nullif(F.trim(F.col(f"_a.{c}")), F.lit(""))
    files = parsed.groupBy("file_sha256").agg(
        first(privacy.payer_name(said("issuer")), "issuer"), first(date(said("period_start")), "period_start"), first(date(said("period_end")), "period_end"),
        first(decimal_minor(said("opening_balance")), "opening_balance_minor"), first(decimal_minor(said("closing_balance")), "closing_balance_minor"), F.count("*").alias("n_requests"), F.count(F.when(~sound, 1)).alias("n_unreadable"),
    )
    return transactions, files.join(rejected, "file_sha256", "left").withColumn("n_rejected", F.coalesce("n_rejected", F.lit(0)))
