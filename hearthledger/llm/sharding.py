"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by a 63-bit key: 32 bits of the text's hash, 24 bits of id and text, and 7 bits that only part rows
equal in both. To cut that order into shards of near equal bytes, the exact bytes in each of 256 intervals of the key are
counted across all partitions; then only the intervals that hold a splitter are counted again, 256 times as
fine, until every splitter is within tolerance of its target. At most shards x 256 sums reach the driver in a round,
whatever the size of the data. With the splitters known each row knows its shard, and one exchange numbers the rows of a
shard: it goes by (shard, slice of the row's hash), so that no shard meets in one task; the offsets of
the slices are sums over a few counts.

Groups of equal texts stay in one shard. Refining stops at the text's bits, at the group's nearer end, unless the group is
larger than a shard; only such a group is divided, by its rows. So that a group does not push a splitter far from its target, groups
of at least `WHOLE` of a shard are found first, by probing the same histogram (at most shards / WHOLE of them exist), and placed
whole, the largest first, each where least is; the splitters of the rest then aim at the room that is left in each shard.

The keys (no texts) are written to the shared folder once: all rounds and the exchange then see the same
rows, even if executors are lost. How the table is partitioned makes no difference to shards and slots, but
where a splitter falls among rows equal in id and text that are more than a shard by themselves.

Law: `bytes`. A splitter misses its target by at most `tolerance` of a mean shard, or half of the group of equal texts
(smaller than WHOLE of a shard) or of the row that lies across it. Defined cases: a null text has size 16 and the checksum of no bytes;
repeated rows, even of one doc_id, each get a slot; an empty table gives no
rows; a table of fewer groups than shards leaves shards empty. Other columns are carried if named.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

SHARDS = 40
TOLERANCE = 0.001
#: Bytes that a row counts besides its text.
ROW_BYTES = 16
#: Bits of the text's hash, of the hash of id and text, and of a number of the row.
TEXT_BITS, ROW_BITS, TIE_BITS = 32, 24, 7
KEY_BITS = TEXT_BITS + ROW_BITS + TIE_BITS
#: Bits of the key that a round resolves.
ROUND_BITS = 8
#: Groups of equal texts of at least this part of a shard are placed before the others.
WHOLE = 0.02
#: Rows of a slice, about; slices share out the numbering of a shard.
SLICE_ROWS = 200_000


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """Id, carried columns, size, text_crc32 and key of each row, written to the shared folder."""
    text = F.col(text_col)
    top = lambda hashed, bits: F.shiftrightunsigned(hashed, 64 - bits)
    key = F.shiftleft(top(F.xxhash64(F.coalesce(text, F.lit(""))), TEXT_BITS), ROW_BITS)
    key = F.shiftleft(key + top(F.xxhash64(F.col(id_col).cast("string"), text), ROW_BITS), TIE_BITS)
    return written(
        docs.select(
            id_col,
            *carry,
            (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            (key + top(F.xxhash64(F.monotonically_increasing_id()), TIE_BITS)).alias("_key"),
        ),
        "sharding",
    )


def large_groups(keys: DataFrame, least: float, most: float) -> dict[int, int]:
    """text hash -> bytes of each group of equal texts of `least` to `most` bytes, by probing finer and finer intervals."""
    found: dict[int, int] = {}
    bits, rows = 0, keys
    while bits < TEXT_BITS:
        bits += ROUND_BITS
        part = F.shiftright("_key", KEY_BITS - bits)
        sums = rows.groupBy(part.alias("part")).agg(F.sum("size").alias("size")).where(F.col("size") >= least)
        found = {r["part"]: r["size"] for r in sums.collect()}  # all / least rows at most
        if not found:
            break
        rows = keys.where(part.isin(list(found)))
    return {k: n for k, n in found.items() if n <= most}


def placed(groups: dict[int, int], shards: int) -> tuple[dict[int, int], list[int]]:
    """text hash -> shard, and the bytes so placed in each shard: the largest first, each where least is."""
    load, at = [0] * shards, {}
    for group, size in sorted(groups.items(), key=lambda x: (-x[1], x[0])):
        at[group] = min(range(shards), key=lambda k: (load[k], k))
        load[at[group]] += size
    return at, load


def splitters(keys: DataFrame, room: Sequence[float], mean: float, tolerance: float = TOLERANCE) -> list[int]:
    """One key less than there are shards: a row belongs to shard k if k of them are at or below its key.

    room: the part of the bytes of `keys` that each shard should get. Groups of equal texts up to `mean` bytes are not divided.
    """
    total = keys.agg(F.sum("size").alias("all")).first()["all"]
    if not total or len(room) < 2:
        return [0] * (len(room) - 1)
    targets = [total * sum(room[: k + 1]) / sum(room) for k in range(len(room) - 1)]
    # Of each splitter: the interval of the key (as its leading bits) and the bytes below that interval.
    found: dict[int, int] = {}
    open_: dict[int, tuple[int, int]] = {k: (0, 0) for k in range(len(targets))}
    bits = 0
    while open_:
        step = min(ROUND_BITS, KEY_BITS - bits)
        shift = KEY_BITS - bits - step
        part = F.shiftright("_key", shift)
        rows = keys if not bits else keys.where(F.shiftright("_key", shift + step).isin({p for p, _ in open_.values()}))
        sums = rows.groupBy(part.alias("part")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        by_prefix: dict[int, list] = {}
        for r in sorted(sums, key=lambda r: r["part"]):
            by_prefix.setdefault(r["part"] >> step, []).append(r)
        bits += step
        still: dict[int, tuple[int, int]] = {}
        for k, (prefix, below) in open_.items():
            for r in by_prefix[prefix]:
                if below + r["size"] >= targets[k]:
                    break
                below += r["size"]
            low, high = targets[k] - below, below + r["size"] - targets[k]
            whole = bits >= TEXT_BITS and r["size"] <= mean
            if min(low, high) <= mean * tolerance or whole or bits >= KEY_BITS or r["n"] == 1:
                found[k] = (r["part"] if low <= high else r["part"] + 1) << shift
            else:
                still[k] = (r["part"], below)
        open_ = still
    return [found[k] for k in range(len(targets))]


def shard_of(key: str, cuts: list[int]) -> Column:
    """How many splitters are at or below the key."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.lit(cuts), lambda c: c <= F.col(key)))


def shard(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (),
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Id, carried columns, size, text_crc32, shard and slot (from 0, in no gap) of each row."""
    keys = keyed(docs, id_col, text_col, carry)
    mean = (keys.agg(F.sum("size").alias("all")).first()["all"] or 0) / shards
    at, load = placed(large_groups(keys, max(1.0, mean * WHOLE), mean) if mean else {}, shards)
    # shards / WHOLE rows at most, made of a literal.
    groups = docs.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"g": g, "k": k} for g, k in sorted(at.items())])), "array<struct<g: bigint, k: int>>")).alias("_at"))
    groups = F.broadcast(groups.select(F.col("_at.g").alias("_group"), F.col("_at.k").alias("_placed")))
    keys = keys.withColumn("_group", F.shiftright("_key", KEY_BITS - TEXT_BITS))
    rest = keys.join(groups, "_group", "left_anti") if at else keys
    room = [max(0.0, mean - x) for x in load]
    cuts = splitters(rest, room if sum(room) else [1.0] * shards, mean, tolerance)
    slices = max(16, -(-keys.count() // (shards * SLICE_ROWS)))
    by_key = shard_of("_key", cuts)
    rows = keys.join(groups, "_group", "left") if at else keys.withColumn("_placed", F.lit(None).cast("int"))
    rows = rows.withColumn("shard", F.coalesce("_placed", by_key).cast("int")).drop("_placed", "_group")
    rows = rows.withColumn("_order", F.shiftright("_key", TIE_BITS)).withColumn("_slice", F.pmod(F.col("_order"), F.lit(slices)))
    counts = rows.groupBy("shard", "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy("shard", "_slice").orderBy("_order", id_col, "_key")
    numbered = rows.withColumn("_nth", F.row_number().over(within) - 1)
    out = numbered.join(offsets, ["shard", "_slice"])
    return out.withColumn("slot", (F.col("_from") + F.col("_nth")).cast("long")).drop("_slice", "_from", "_nth", "_key", "_order")


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
