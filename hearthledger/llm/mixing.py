r"""Mixing sources to target weights, by histograms of hashes.

Each document has a key, hexadecimal digits of a hash of its id and text (and, for rows equal in both, a number of the row). What a source gives beyond whole repeats is the documents whose
key is below a threshold. To find it, words are summed by source and the next `DIGITS` digits of the key; only the one bucket of each source that holds the threshold is
counted again, finer, until it holds a single row. The documents just beyond the threshold that are small enough for what is left of the budget get a
threshold of their own, above the first and for sizes up to what is left, and so on: thresholds nest, each for what the one before left, until that is
at most `tolerance` of the target or nothing fits. Together that is: go through a source's documents in the order of their keys and take each that fits, but nothing is sorted. With the thresholds
known, every document decides by itself. A larger budget keeps what a smaller one takes below the smaller one's first threshold.

Keys, sizes and sources (no texts) are written to the shared folder once, so that all rounds see the same rows even if executors are lost, and runs agree. Sums are made before the shuffle: a
source of a third of all rows sends a row for each task and bucket. The few rows of sources (targets, thresholds) are broadcast up to `BROADCAST_SOURCES` and joined by source and salt beyond.

Targets: sources by code point, null last, weigh 5, 2, 1, 5, ...; they share `share` of all sizes by weight; a target stops at `most` times its source's size and the rest is shared again. A
source's documents are all taken floor(target / size) times and some once more.

Defined cases: a null, empty or blank text has size 0 and is taken 0 times; a null source is a source of its own, other than the empty one; null ids and
repeated rows count row by row; a source without words has target 0; an empty table gives no rows. Extra columns are carried if named, unless named like an output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
TOLERANCE = 1e-4
#: Hexadecimal digits of the hash, of a row's number, and of those that a round resolves.
HASH_DIGITS, ROW_DIGITS, DIGITS = 16, 16, 3
#: Sources up to this many (a hundred bytes each, with their thresholds) are broadcast.
BROADCAST_SOURCES = 10_000
SALTS = 32
WORD = r"[^\x20\x09-\x0D]+"
_ENDS = "g"  # above every digit


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """Id, carried columns, source, size and _key of each row, written to the shared folder."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spread = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    row = F.lpad(F.hex(F.monotonically_increasing_id()), ROW_DIGITS, "0")
    return written(
        docs.select(
            id_col, *carry, F.col(source_col).alias("_source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.concat(F.substring(spread, 1, HASH_DIGITS), F.lower(row)).alias("_key"),
        ),
        "mixing",
    )


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes (_source, source_size) with weight and target. A row for each source, so ranking them is the work of one task; shares are settled by sums."""
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    ranked = written(sizes.withColumn("weight", F.element_at(F.lit(list(weights)), F.pmod(rank, F.lit(len(weights))) + 1)), "mixing")
    total = ranked.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    cap, capped = F.col("source_size") * F.lit(most), F.lit(False)
    while True:
        state = ranked.withColumn("_capped", capped)
        got = state.agg(F.sum(F.when(F.col("_capped"), cap)).alias("full"), F.sum(F.when(~F.col("_capped"), F.col("weight"))).alias("w"), F.count(F.when(F.col("_capped"), 1)).alias("n")).first()
        rest, open_weight = share * total - float(got["full"] or 0), got["w"]
        shared = F.col("weight") * F.lit(float(max(rest, 0.0))) / F.lit(float(open_weight or 1))
        above = capped | (shared > cap)
        if not open_weight or state.where(above).count() == got["n"]:
            return ranked.withColumn("target", F.when(capped, cap.cast("double")).otherwise(shared))
        capped = above


def attached(rows: DataFrame, sources: DataFrame, few: bool, spread: str = "_key") -> DataFrame:
    """rows with the columns of their source; `spread` is a column of rows that differs within a source."""
    if few:
        sources = sources.withColumnRenamed("_source", "_of")
        return rows.join(F.broadcast(sources), F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    salted = sources.withColumnRenamed("_source", "_of").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return mine.join(salted, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_salt") == F.col("_s"))).drop("_of", "_s", "_salt")


def thresholds(keys: DataFrame, sources: DataFrame, few: bool, tolerance: float) -> DataFrame:
    """sources (with target and source_size) with `repeats` and `levels`: array of (low, high, most): what is taken once more are the rows of a size up to most whose key is above low and below high."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = sources.withColumn("repeats", whole).withColumn("_left", F.floor(F.col("target") - F.col("repeats") * F.col("source_size")).cast("long"))
    state = state.withColumns({"levels": F.lit(None).cast("array<struct<low: string, high: string, most: bigint>>"), "_low": F.lit(""), "_most": F.col("_left"), "_prefix": F.lit("")})
    state = written(state.withColumns({"levels": F.coalesce("levels", F.array()), "_open": F.col("_left") > 0}), "mixing")
    while state.where("_open").limit(1).count():
        scope = attached(keys.select("_source", "size", "_key"), state.where("_open").select("_source", "_low", "_most", "_prefix"), few)
        scope = scope.where((F.col("size") > 0) & (F.col("size") <= F.col("_most")) & (F.col("_key") > F.col("_low")) & F.col("_key").startswith(F.col("_prefix")))
        bucket = F.substring(F.col("_key"), F.length("_prefix") + 1, F.lit(DIGITS))
        sums = scope.groupBy("_source", F.concat("_prefix", bucket).alias("_bucket")).agg(F.sum("size").alias("_sum"), F.count("*").alias("_n"))
        w = Window.partitionBy("_source").orderBy("_bucket")
        running = sums.withColumn("_upto", F.sum("_sum").over(w))
        ends = F.struct("_bucket", "_n", (F.col("_upto") - F.col("_sum")).alias("_below"))
        found = attached(running, state.where("_open").select("_source", "_left"), few, "_bucket").groupBy("_source").agg(
            F.min(F.when(F.col("_upto") > F.col("_left"), ends)).alias("_end"), F.sum("_sum").alias("_all"),
        )
        found = found.withColumnRenamed("_source", "_of")
        same = F.col("_source").eqNullSafe(F.col("_of"))
        # Sources against sources: a row each.
        both = state.join(F.broadcast(found), same, "left") if few else state.join(found, same, "left")
        level = lambda high: F.concat("levels", F.array(F.struct(F.col("_low").alias("low"), high.alias("high"), F.col("_most").alias("most"))))
        # Nothing is in the way: all that is in scope fits. Or the end lies in one row's bucket: the level is found. Else the bucket is opened.
        fits, single = F.col("_end").isNull(), F.col("_end._n") == 1
        left = F.col("_left") - F.when(fits, F.coalesce("_all", F.lit(0))).otherwise(F.col("_end._below"))
        done = fits | (single & ((left <= F.col("target") * F.lit(tolerance)) | (left <= 0)))
        state = both.select(
            "_source", "source_size", "weight", "target", "repeats", F.when(F.col("_open"), left).otherwise(F.col("_left")).alias("_left"),
            F.when(~F.col("_open"), F.col("levels")).when(fits, level(F.lit(_ENDS))).when(single, level(F.col("_end._bucket"))).otherwise(F.col("levels")).alias("levels"),
            F.when(F.col("_open") & single, F.concat("_end._bucket", F.lit(_ENDS))).otherwise(F.col("_low")).alias("_low"),
            F.when(F.col("_open") & single, left).otherwise(F.col("_most")).alias("_most"),
            F.when(F.col("_open") & ~fits & ~single, F.col("_end._bucket")).otherwise(F.lit("")).alias("_prefix"),
            (F.col("_open") & ~done).alias("_open"),
        )
        state = written(state, "mixing")
    return state.select("_source", "source_size", "target", "repeats", "levels")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = (), weights: Sequence[int] = WEIGHTS,
    share: float = SHARE, most: int = MOST, tolerance: float = TOLERANCE,
) -> DataFrame:
    """Id, carried columns, source, size, source_size, target (of the source), times and taken (size x times) of each row."""
    made = ("size", "source_size", "target", "times", "taken", "source")
    keys = keyed(docs, id_col, text_col, source_col, [c for c in carry if c not in made and c not in (id_col, source_col)])
    sizes = keys.groupBy("_source").agg(F.sum("size").alias("source_size"))
    sources = targets(sizes, weights, share, most)
    few = sources.count() <= BROADCAST_SOURCES
    known = thresholds(keys, sources, few, tolerance)
    rows = attached(keys, known, few)
    more = F.exists("levels", lambda x: (F.col("_key") > x["low"]) & (F.col("_key") < x["high"]) & (F.col("size") <= x["most"]))
    rows = rows.withColumn("times", F.when(F.col("size") > 0, F.col("repeats") + more.cast("long")).otherwise(F.lit(0)))
    own = [c for c in keys.columns if c not in ("_source", "size", "_key")]
    return rows.select(*own, F.col("_source").alias("source"), "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def op13_source_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "times", "source")


#: The same in SQL: rows in the order of their keys, one after the other; each is taken that fits into what is left, until a row does not fit and at most the tolerance is left.
OP13_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))), 1, {HASH_DIGITS}) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM d GROUP BY source),
c AS (SELECT 0 AS r, source, source_size, weight, false AS capped, false AS again FROM s UNION ALL
  SELECT * FROM (SELECT r + 1 AS r, source, source_size, weight, capped OR over AS capped, bool_or(over AND NOT capped) OVER () AS again FROM (
    SELECT *, weight * ({SHARE} * sum(source_size) OVER () - coalesce(sum(CASE WHEN capped THEN {MOST} * source_size END) OVER (), 0)) / coalesce(sum(CASE WHEN NOT capped THEN weight END) OVER (), 1) > {MOST} * source_size AS over FROM c)) WHERE again),
f AS (SELECT * FROM c WHERE r = (SELECT max(r) FROM c)),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST({MOST} * source_size AS DOUBLE) ELSE weight * CAST({SHARE} * sum(source_size) OVER () - coalesce(sum(CASE WHEN capped THEN {MOST} * source_size END) OVER (), 0) AS DOUBLE) / coalesce(sum(CASE WHEN NOT capped THEN weight END) OVER (), 1) END AS target FROM f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM t),
o AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS n FROM d),
w AS (SELECT CAST(0 AS BIGINT) AS n, source, target, CAST(floor(target - repeats * source_size) AS BIGINT) AS rest, CAST(floor(target - repeats * source_size) AS BIGINT) <= 0 AS done, false AS took FROM b UNION ALL
  SELECT o.n, o.source, w.target, CASE WHEN NOT done AND size <= rest THEN rest - size ELSE rest END, done OR (size > rest AND rest <= {TOLERANCE} * w.target), NOT done AND size <= rest FROM w JOIN o ON o.source IS NOT DISTINCT FROM w.source AND o.n = w.n + 1)
SELECT o.doc_id, o.size, b.source_size, b.target, o.size * (b.repeats + CAST(w.took AS BIGINT)) AS taken, CASE WHEN o.size > 0 THEN b.repeats + CAST(w.took AS BIGINT) ELSE 0 END AS times, o.source
FROM o JOIN b ON b.source IS NOT DISTINCT FROM o.source JOIN w ON w.source IS NOT DISTINCT FROM o.source AND w.n = o.n"""
