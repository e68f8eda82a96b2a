"""Queries of the reader by a model: pages of bills are packed into requests, a fixed function answers for the model, and its rows are compared with the bills."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthledger.functions.text import money_plain
from hearthledger.plans.registry import query
from hearthledger.plans.statements import _BASE
from hearthledger.sources import model_reader
from hearthledger.sources.fixtures import frame

_PER_PAGE, _BUDGET = 20, 1500


def _pages(s, d):
    """A page for each 20 rows of a bill; every third says the opening balance. Rows with a bad date or amount are printed too."""
    base = frame(s, d, _BASE).withColumn("page_number", F.floor((F.col("nth") - 1) / _PER_PAGE).cast("int") + 1)
    date = F.when(F.col("n") == 3, "soon").otherwise(F.date_format("d", "yyyy-MM-dd"))
    amount = F.when(F.col("n") == 4, "n/a").otherwise(money_plain(F.col("cents")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.concat_ws("|", date, "shop", amount).alias("t")))), lambda r: r["t"]), "\n")
    pages = base.groupBy(F.concat(F.lit("N"), "k").alias("file_sha256"), "page_number").agg(lines.alias("text"))
    head = F.when(F.col("page_number") % 3 == 0, F.concat(F.lit("\nOpening "), F.col("page_number").cast("string"), F.lit(".00"))).otherwise("")
    return pages.withColumn("text", F.concat("text", head))


def _model(prompt: Column) -> Column:
    """What a model might say: JSON with words around it; of prompts with Shop 13 nothing of use."""
    line = lambda t: F.struct(F.split_part(t, F.lit("|"), F.lit(1)).alias("date"), F.split_part(t, F.lit("|"), F.lit(2)).alias("description"), F.split_part(t, F.lit("|"), F.lit(3)).alias("amount"), F.lit("Purchase").alias("kind"))
    rows = F.transform(F.filter(F.split(prompt, "\n"), lambda t: t.contains("|")), line)
    said = F.to_json(F.struct(F.nullif(F.regexp_extract(prompt, r"Opening (\S+)", 1), F.lit("")).alias("opening_balance"), F.lit("Quay Bank").alias("issuer"), rows.alias("transactions")))
    return F.when(prompt.contains("|Shop 13 Ltd|"), "I cannot read that.").otherwise(F.concat(F.lit("Here it is: "), said, F.lit(" - done.")))


# Pages go to a request in order while its budget holds.
_PACKED = f"""WITH RECURSIVE g AS (SELECT concat('N', k) AS f, k, (nth - 1) // {_PER_PAGE} + 1 AS page, nth, d, n, shop, cents, concat_ws('|', CASE WHEN n = 3 THEN 'soon' ELSE strftime(d, '%Y-%m-%d') END, shop, CASE WHEN n = 4 THEN 'n/a' ELSE concat(CAST(cents // 100 AS VARCHAR), '.', lpad(CAST(cents % 100 AS VARCHAR), 2, '0')) END) AS t FROM ({_BASE})),
p AS (SELECT f, page, string_agg(t, chr(10) ORDER BY nth) || CASE WHEN page % 3 = 0 THEN concat(chr(10), 'Opening ', page, '.00') ELSE '' END AS text FROM g GROUP BY f, page),
r AS (SELECT f, page, 1 AS request, len(text) AS used FROM p WHERE page = 1 UNION ALL SELECT p.f, p.page, CASE WHEN used + len(text) > {_BUDGET} THEN request + 1 ELSE request END, CASE WHEN used + len(text) > {_BUDGET} THEN len(text) ELSE used + len(text) END FROM r JOIN p ON p.f = r.f AND p.page = r.page + 1),
q AS (SELECT f, request, min(page) AS first_page, max(page) AS last_page, string_agg(text, chr(10) ORDER BY page) AS prompt FROM r JOIN p USING (f, page) GROUP BY f, request), a AS (SELECT *, contains(prompt, '|Shop 13 Ltd|') AS mute FROM q)"""


@query("model_requests", f"{_PACKED} SELECT f AS file_sha256, CAST(request AS INTEGER) AS request, CAST(first_page AS INTEGER) AS first_page, CAST(last_page AS INTEGER) AS last_page, md5(prompt) AS prompt_md5 FROM q")
def _(s, d):
    asked = model_reader.requests(_pages(s, d), budget=_BUDGET)
    return asked.select("file_sha256", "request", "first_page", "last_page", F.md5("prompt").alias("prompt_md5"))


@query("model_transactions", f"{_PACKED} SELECT g.f AS file_sha256, row_number() OVER (PARTITION BY g.f ORDER BY nth) AS ordinal, CAST(a.request AS INTEGER) AS request, d AS posted_date, shop AS description_raw, cents AS amount_minor, 'purchase' AS kind_hint FROM g JOIN a ON a.f = g.f AND g.page BETWEEN first_page AND last_page WHERE NOT mute AND n NOT IN (3, 4)")
def _(s, d):
    return model_reader.read(model_reader.answers(model_reader.requests(_pages(s, d), budget=_BUDGET), _model))[0]


@query("model_files", f"""{_PACKED}, b AS (SELECT a.f, a.request, min(p.page) * 100 AS opening FROM a JOIN p ON p.f = a.f AND p.page BETWEEN a.first_page AND a.last_page AND p.page % 3 = 0 WHERE NOT mute GROUP BY a.f, a.request), c AS (SELECT f, arg_min(opening, request) AS opening FROM b GROUP BY f),
j AS (SELECT g.f, count(*) AS n FROM g JOIN a ON a.f = g.f AND g.page BETWEEN first_page AND last_page WHERE NOT mute AND n IN (3, 4) GROUP BY g.f)
SELECT a.f AS file_sha256, CASE WHEN bool_and(mute) THEN NULL ELSE 'Quay Bank' END AS issuer, CAST(any_value(c.opening) AS BIGINT) AS opening_balance_minor, count(*) AS n_requests, count(*) FILTER (mute) AS n_unreadable, coalesce(any_value(j.n), 0) AS n_rejected FROM a LEFT JOIN c USING (f) LEFT JOIN j USING (f) GROUP BY a.f""")  # fmt: skip
def _(s, d):
    files = model_reader.read(model_reader.answers(model_reader.requests(_pages(s, d), budget=_BUDGET), _model))[1]
    return files.select("file_sha256", "issuer", "opening_balance_minor", "n_requests", "n_unreadable", "n_rejected")
