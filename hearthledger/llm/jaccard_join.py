"""N-gram Jaccard join in a metric space: pivots, Voronoi regions, windows, exact recursion.

d(x, y) = 1 - |x & y| / |x | y| is a metric on sets of word shingles. Texts link at a distance of at most
r (0.2). Almost all pairs of documents lie at distance 1, from which the triangle inequality concludes
nothing, so documents drawn at random would be pivots that separate nothing. The join
therefore has two levels, each with the pivots that do separate there:

1. *Single shingles as pivots.* x is at distance 1 - 1/|x| from the set of each shingle it has, and at 1 from
   all others: its nearest pivots are its own shingles, rarest first in one global order. If y has none of
   the first w of them, then d(x, y) >= w / |x|; so beyond a window of floor(r |x|) + 1 pivots no partner can
   hide, and x is copied into just these regions. Regions of one set hold no pair and go at once.
   Its position in the two windows bounds what follows the first shared pivot: each entry has a
   reach, the largest set that it can link with, and leaves a region whose smallest set is beyond it.
2. *Documents as pivots inside the regions.* In each of `ROUNDS` rounds a region has one document as its
   pivot, the one with the least before what the region shares; a document's nearest one (that of most of
   its regions) is compared with it exactly. Groups of copies link with one comparison for each member and
   round, and a region whose documents are connected is done. What is left after the rounds recurs into pairs
   of documents of different components that reach each other, with an exact comparison of each.

No exact comparison is made of a pair that is surely apart: each document has a sketch, the number of its shingles in each
of about n / 4 hash buckets, and the sum of the differences of two sketches (a metric too) is at most the size
of the symmetric difference. The rest of the pairs have their texts compared.

Components of the links come from label propagation with pointer jumping; each round is a
table in the shared folder. The order of the pivots changes the work, never the result: shingles that are
frequent anywhere come last. Counting reads all texts; the `HOT` most frequent ones are kept on the driver.

Defined cases: null texts and texts without words have no shingles, link with nothing and are
their own component; fewer than `k` words are one shingle; equal sets form one class and meet as one;
a null doc_id is a document of its own, in the component of what it links with (null if none of it has an id); rows of
one doc_id with one set are one document, with different sets they are as many documents. Where there are such rows,
every row is numbered and linked by its number. Texts are read whole; extra columns are not needed and left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, table, written

K = 5
#: A pair links if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Frequent shingles that the driver keeps for the order of pivots: 16 bytes each.
HOT = 100_000
#: Times that a shingle must occur in a task's block of texts to be counted as frequent.
HOT_IN_BLOCK = 8
BLOCK_SHINGLES = 3_000_000
#: Ids that are broadcast at most (16 bytes each); beyond it a shuffle join takes over.
MAX_BROADCAST_IDS = 1_000_000

#: Shingles of a bucket of a sketch, about.
BUCKET = 4

#: Rows of a rare pivot that may meet in one task; pivots with more are found by counts of `COUNTERS` buckets, then exactly.
REGION_ROWS = 200_000
COUNTERS = 1 << 17

#: Rounds with document pivots before the exact comparison of what is left.
ROUNDS = 3

_BASE = 0x9E3779B97F4A7C15
_POWERS: tuple[np.ndarray, np.ndarray] | None = None


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _POWERS
    if _POWERS is None or len(_POWERS[0]) < n:
        size = max(n, 1 << 17)
        one = np.ones(1, np.uint64)
        both = [np.concatenate((one, np.full(size - 1, b, np.uint64))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        _POWERS = np.cumprod(both[0]), np.cumprod(both[1])
    return _POWERS


def shingles(text: str | None, k: int = K) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []
    if not words:
        return np.empty(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    up, down = _powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)])))
    spaces = np.flatnonzero(data == 32)
    begin, end = np.concatenate(([0], spaces + 1)), np.append(spaces, len(data))
    size = min(k, len(words))
    first, last = begin[: len(words) - size + 1], end[size - 1 :]
    return np.unique(_mixed((total[last] - total[first]) * down[first]))


def window(n: int, percent: int = PERCENT) -> int:
    """Pivots of a set of n that a partner must share one of; 0 if only an equal set can link."""
    return 0 if 100 * n < percent * (n + 1) else n - -(-percent * n // 100) + 1


def sketch(h: np.ndarray) -> bytes:
    """The size of a set (4 bytes) and how many of it fall into each bucket (a byte each, 255 at most)."""
    buckets = 1 << max(4, (len(h) // BUCKET - 1).bit_length() if len(h) > BUCKET else 0)
    counts = np.bincount((h & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return len(h).to_bytes(4, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes()


def apart(one: bytes, two: bytes) -> tuple[int, int]:
    """(a lower bound of the symmetric difference, the sum of the sizes) of two sketched sets."""
    x, y = (np.frombuffer(v, np.uint8, offset=4).astype(np.int64) for v in (one, two))
    m = min(len(x), len(y))  # buckets are the low bits, so the finer sketch folds onto the coarser one
    total = int.from_bytes(one[:4], "little") + int.from_bytes(two[:4], "little")
    return int(np.abs(x.reshape(-1, m).sum(0) - y.reshape(-1, m).sum(0)).sum()), total


def surveyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass: (doc_id, n, set) of each document, and (shingle, n) of what is frequent in a block of texts."""

    def survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        block: list[np.ndarray] = []
        total = 0

        def often() -> pd.DataFrame:
            values, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *block]), return_counts=True)
            many = counts >= HOT_IN_BLOCK
            return _rows(shingle=values[many].view(np.int64), n=counts[many])

        for pdf in batches:
            sizes, digests = [], []
            for text in pdf["text"]:
                h = shingles(text)
                sizes.append(len(h))
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                if len(h) and (at := hash(digests[-1])) not in seen:
                    seen.add(at)
                    block.append(h)
                    total += len(h)
            yield _rows(doc_id=pdf["doc_id"], n=sizes, set=digests)
            if total >= BLOCK_SHINGLES:
                yield often()
                seen, block, total = set(), [], 0
        yield often()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return written(rows.mapInPandas(survey, "doc_id long, n long, set binary, shingle long"), "jaccard-survey")


def _rows(**columns) -> pd.DataFrame:
    """Rows of the survey; what is not given is null."""
    size = len(next(iter(columns.values())))
    empty = {"doc_id": "Int64", "n": "Int64", "set": object, "shingle": "Int64"}
    return pd.DataFrame({k: pd.Series(columns.get(k, [None] * size), dtype=t) for k, t in empty.items()})


def order_of(survey: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent shingles, and their places in the order of pivots."""
    found = survey.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n"))
    most = found.orderBy(F.desc("n"), "shingle").limit(HOT).collect()
    hashes = np.array([r["shingle"] for r in most], np.int64).view(np.uint64)
    place = np.arange(len(most), 0, -1)  # the most frequent one is last of all
    order = np.argsort(hashes)
    return hashes[order], place[order]


def only(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of the given ids."""
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(ids, "doc_id", "left_semi")


def members_of(docs: DataFrame, survey: DataFrame, classes: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(doc_id, n, cold, hot, sketch): one document of each class, with its window of rare and of frequent pivots."""
    shared = docs.sparkSession.sparkContext.broadcast(order_of(survey))

    @F.pandas_udf("n long, cold array<long>, hot array<long>, sketch binary")
    def windowed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hot, place = shared.value
        for part in texts:
            rows = []
            for text in part:
                h = shingles(text)
                late = np.zeros(len(h), np.int64)
                if len(hot) and len(h):
                    near = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    late = np.where(hot[near] == h, place[near], 0)
                first = np.argsort(late, kind="stable")[: window(len(h), percent)]
                chosen, often = h[first].view(np.int64), late[first] > 0
                rows.append((len(h), chosen[~often], chosen[often], sketch(h)))
            yield pd.DataFrame(rows, columns=["n", "cold", "hot", "sketch"])

    ids = classes.where(_can_link("n", percent) & F.col("class_id").isNotNull()).select(F.col("class_id").alias("doc_id"))
    out = only(docs, ids, id_col, text_col).select("doc_id", windowed("text").alias("_w"))
    out = written(out.select("doc_id", "_w.*"), "jaccard-members")
    return out if out.count() == out.select("doc_id").distinct().count() else written(out.dropDuplicates(["doc_id"]), "jaccard-members")


def _can_link(n: str, percent: int) -> Column:
    """Whether a set of that size can link with another than itself."""
    return 100 * F.col(n) >= percent * (F.col(n) + 1)


def reach(pos: Column, n: Column, percent: int) -> Column:
    """The largest set that can link with one of n if the first pivot they share has this position in it."""
    return F.floor((n - pos) * (100 + percent) / percent + 1e-6).cast("int") - n


def heavy_pivots(members: DataFrame) -> DataFrame | None:
    """(pivot) of rare pivots with more than REGION_ROWS rows, None without any: what the blocks of texts did not show as frequent.

    All rows are counted by bucket first, which sums up in each task; only pivots of buckets above the limit are counted one by one.
    """
    each = members.select(F.explode("cold").alias("pivot")).withColumn("_bucket", F.pmod("pivot", F.lit(COUNTERS)))
    full = each.groupBy("_bucket").count().where(F.col("count") > REGION_ROWS).select("_bucket")
    full = written(full, "jaccard-buckets")  # COUNTERS rows at most
    if full.isEmpty():
        return None
    exact = each.join(F.broadcast(full), "_bucket", "left_semi").groupBy("pivot").count()
    found = written(exact.where(F.col("count") > REGION_ROWS).select("pivot"), "jaccard-heavy")
    return None if found.isEmpty() else found


def regions_of(members: DataFrame, percent: int) -> DataFrame:
    """(pivot, doc_id, n, reach, hub, rows) of regions of two documents or more; the hub is the most central document.

    A document whose reach ends before the smallest set leaves the region. A rare pivot's rows meet in a
    window. Those of a frequent one are counted with partial sums and joined back, so that even a pivot of a
    third of all documents is shared out.
    """

    def entries(which: str, before: Column) -> DataFrame:
        rows = members.select("doc_id", F.col("n").cast("int").alias("n"), before.alias("_before"), F.posexplode(which).alias("_at", "pivot"))
        return rows.select("pivot", "doc_id", "n", reach(F.col("_at") + F.col("_before"), F.col("n"), percent).alias("reach"))

    rare, often = entries("cold", F.lit(0)), entries("hot", F.size("cold"))
    if (heavy := heavy_pivots(members)) is not None:
        few = F.broadcast(heavy) if heavy.count() <= MAX_BROADCAST_IDS else heavy
        often = often.unionByName(rare.join(few, "pivot", "left_semi"))
        rare = rare.join(few, "pivot", "left_anti")
    hub, smallest = F.max(_central()).alias("hub"), F.min(F.struct("n", "doc_id")).alias("_least")
    by = Window.partitionBy("pivot")
    # Dealt out as three numbers a row, before the window works out its structs.
    packed = rare.select("pivot", "doc_id", F.expr("shiftleft(cast(n as bigint), 32) + reach").alias("_p")).repartition("pivot")
    cold = packed.select("pivot", "doc_id", F.expr("cast(shiftright(_p, 32) as int)").alias("n"), F.expr("cast(_p & 4294967295 as int)").alias("reach"))
    cold = cold.select("*", *(c.over(by).alias(a) for c, a in ((F.max(_central()), "hub"), (F.min(F.struct("n", "doc_id")), "_least"), (F.count("*"), "rows"))))
    hubs = often.groupBy("pivot").agg(hub, smallest, F.count("*").alias("rows"))
    rows = cold.unionByName(often.join(hubs, "pivot")).where("rows > 1 and (doc_id = _least.doc_id or reach >= _least.n)")
    return written(rows.drop("_least"), "jaccard-regions")


def _central() -> Column:
    """Greatest for the document with the least before what its region shares: it links with most of the others."""
    return F.struct((F.col("reach") / F.col("n")).alias("share"), "doc_id", "n", "reach")


def contested(regions: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """What is left of the regions: documents that reach the smallest set of another component, with a hub of this turn."""
    placed = regions.select("pivot", "doc_id", "n", "reach").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "doc_id"))
    # The most central one of another half of the components in each turn.
    half = (F.xxhash64("component", F.lit(turn)) % 2 == 0).alias("half")
    pick = F.max(F.struct(half, (F.col("reach") / F.col("n")).alias("share"), "doc_id", "n", "reach", "component")).alias("hub")
    first = F.min(F.struct("n", "component")).alias("_first")
    mixed = placed.groupBy("pivot").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), first, pick, F.count("*").alias("rows")).where("_lo < _hi")
    left = placed.join(mixed.drop("_lo", "_hi"), "pivot").where("component = _first.component or reach >= _first.n")
    return written(left.drop("_first"), "jaccard-regions")


def _both(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(a, b, _x, _y): pairs with the values (_id, _value) of both; those of b should be the fewer ones."""
    small = F.broadcast if pairs.count() <= MAX_BROADCAST_IDS else lambda df: df
    left = values.join(small(pairs.select("a", "b")), F.col("_id") == F.col("a")).select("a", "b", F.col("_value").alias("_x"))
    right = values.join(small(pairs.select("b").distinct()), F.col("_id") == F.col("b"), "left_semi")
    return left.join(right.select(F.col("_id").alias("b"), F.col("_value").alias("_y")), "b")


def compared(pairs: DataFrame, docs: DataFrame, members: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Pairs (a, b) with bounds of their distance (lo, hi) and whether they link; exact where sketches leave it open."""

    @F.pandas_udf("apart long, total long")
    def bound(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([apart(x, y) for x, y in zip(left, right, strict=True)], columns=["apart", "total"])

    @F.pandas_udf("apart long, total long")
    def exact(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows, last, y = [], None, None
        for one, two in zip(left, right, strict=True):
            x = shingles(one)
            if last is None or two != last:  # a hub's rows come one after another
                last, y = two, shingles(two)
            total = len(x) + len(y)
            rows.append((total - 2 * len(np.intersect1d(x, y, assume_unique=True)), total))
        return pd.DataFrame(rows, columns=["apart", "total"])

    # With the sizes' sum t and the symmetric difference s: intersection (t - s) / 2, union (t + s) / 2.
    links = F.expr(f"(100 - {percent}) * _o.total >= (100 + {percent}) * _o.apart")
    distance = 2 * F.col("_o.apart") / (F.col("_o.total") + F.col("_o.apart"))
    sketches = members.select(F.col("doc_id").alias("_id"), F.col("sketch").alias("_value"))
    bounds = _both(written(pairs, "jaccard-pairs"), sketches).select("a", "b", bound("_x", "_y").alias("_o"))
    bounds = written(bounds.select("a", "b", distance.alias("lo"), links.alias("open")), "jaccard-bounds")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_value"))
    near = _both(bounds.where("open"), texts).select("a", "b", exact("_x", "_y").alias("_o"))
    near = near.select("a", "b", distance.alias("lo"), distance.alias("hi"), links.alias("linked"))
    far = bounds.where("not open").select("a", "b", "lo", F.lit(1.0).alias("hi"), F.lit(False).alias("linked"))
    return written(near.unionByName(far), "jaccard-compared")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b): the smallest node that is reachable."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(both.distinct(), "jaccard-edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "jaccard-labels")
    while True:
        seen = edges.join(labels.select(F.col("node").alias("b"), "component"), "b")
        least = seen.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        near = labels.join(least, "node").select("node", "component", F.least("component", "_near").alias("_to"))
        jump = labels.select(F.col("node").alias("_to"), F.col("component").alias("_far"))
        step = near.join(jump, "_to", "left")
        step = step.select("node", F.least("_to", F.coalesce("_far", "_to")).alias("component"), F.col("component").alias("_old"))
        new = written(step, "jaccard-labels")
        if new.where(F.col("component") != F.col("_old")).isEmpty():
            return new.drop("_old")
        labels = new.drop("_old")


def linked_pairs(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between members that connect all that link."""
    regions = regions_of(members, percent)
    links = seen = None
    for turn in range(ROUNDS + 1):
        if turn:
            regions = contested(regions, components(links), turn)
            if turn == ROUNDS or regions.isEmpty():
                break
        # A document's nearest pivot is the one of most of the regions in which they can link; small regions count for more in every second turn.
        others = regions.where(f"doc_id <> hub.doc_id and reach >= hub.n and hub.reach >= n and 100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)")
        if turn:
            others = others.where("component <> hub.component")
        votes = others.groupBy(F.col("doc_id").alias("a"), F.col("hub.doc_id").alias("b")).agg(F.sum(1 / F.col("rows") if turn % 2 else F.lit(1.0)).alias("votes"))
        nearest = votes.groupBy("a").agg(F.max(F.struct("votes", "b")).alias("_best")).select("a", "_best.b")
        near = compared(nearest, docs, members, id_col, text_col, percent)
        to_pivot = near.select(F.col("a").alias("doc_id"), F.struct("b", F.struct("lo", "hi").alias("d")).alias("_d"))
        seen = to_pivot if seen is None else seen.unionByName(to_pivot)
        found = near.where("linked").select("a", "b")
        links = found if links is None else links.unionByName(found)
    # Exactly: pairs of different components that reach each other. A pair with a common document pivot, from which
    # bounds of both distances are known, must lie within the window of the triangle inequality.
    known = seen.groupBy("doc_id").agg(F.map_from_entries(F.collect_set("_d")).alias("_near"))  # an entry a round at most
    placed = regions.select("pivot", "doc_id", "component", "n", "reach").join(known, "doc_id", "left")
    left = placed.select("pivot", F.col("doc_id").alias("a"), F.col("component").alias("_p"), F.col("n").alias("_na"), F.col("reach").alias("_ra"), F.col("_near").alias("_xa"))
    right = placed.select(F.col("pivot").alias("_pivot"), F.col("doc_id").alias("b"), F.col("component").alias("_q"), F.col("n").alias("_nb"), F.col("reach").alias("_rb"), F.col("_near").alias("_xb"))
    one, two = (lambda h: F.try_element_at("_xa", h)), (lambda h: F.try_element_at("_xb", h))
    far = F.exists(F.map_keys("_xa"), lambda h: F.greatest(one(h)["lo"] - two(h)["hi"], two(h)["lo"] - one(h)["hi"]) > 1 - percent / 100 + 1e-9)
    fits = F.expr(f"pivot = _pivot and a < b and _p <> _q and _ra >= _nb and _rb >= _na and 100 * least(_na, _nb) >= {percent} * greatest(_na, _nb)")
    pairs = left.join(right, fits & ~F.coalesce(far, F.lit(False))).select("a", "b").distinct()
    near = compared(pairs, docs, members, id_col, text_col, percent)
    return links.unionByName(near.where("linked").select("a", "b"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row; also digest and first where ids do not tell documents apart.

    digest: md5 of the text; first: whether a row is the one of its component that stays, of the smallest (doc_id nulls last, number).
    """
    bounded_batches(docs.sparkSession)
    survey = surveyed(docs, id_col, text_col)
    documents = survey.where("shingle is null").select("doc_id", "n", "set")
    by_id = documents.groupBy("doc_id").agg(F.min("set").alias("_lo"), F.max("set").alias("_hi"), F.count("set").alias("_sets"), F.count("*").alias("_rows"))
    if not by_id.where("doc_id is null or _lo <> _hi or _sets not in (0, _rows)").isEmpty():
        return _join_rows(docs, id_col, text_col, percent)
    return _join(docs, survey, id_col, text_col, percent)


def _join_rows(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """join by a number of each row, given when the rows are written."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "jaccard-rows")
    found = written(_join(rows, surveyed(rows, "_row", "text"), "_row", "text", percent), "jaccard-found")
    ids = rows.select(F.col("_row").alias("doc_id"), "_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    # Rows of one id without words are one document too.
    group = F.when((F.col("n_shingles") == 0) & F.col("_id").isNotNull(), F.concat(F.lit("id "), "_id")).otherwise(F.concat(F.lit("row "), "component_id"))
    of_row = found.join(ids, "doc_id").withColumn("_group", group)
    # A component's first row, and the smallest id of it and of each class.
    key = F.struct(F.col("_id").isNull().alias("none"), "_id", "doc_id")
    firsts = of_row.groupBy("_group").agg(F.min(key).alias("_first"))
    classes = of_row.groupBy("class_id").agg(F.min("_id").alias("_class"))
    out = of_row.join(firsts, "_group").join(classes, "class_id")
    return out.select(
        F.col("_id").alias("doc_id"), "n_shingles", F.col("_class").alias("class_id"), F.col("_first._id").alias("component_id"),
        "digest", (F.col("doc_id") == F.col("_first.doc_id")).alias("first"),
    )


def _join(docs: DataFrame, survey: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """join of documents that their ids tell apart."""
    documents = survey.where("shingle is null").select("doc_id", "n", "set")
    full = documents.where("n > 0")
    classes = written(full.groupBy("set").agg(F.min("doc_id").alias("class_id"), F.max("n").alias("n")), "jaccard-classes")
    members = members_of(docs, survey, classes, id_col, text_col, percent)
    labels = components(linked_pairs(docs, members, id_col, text_col, percent))
    out = full.join(classes.drop("n"), "set").join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    out = out.select("doc_id", "n", "class_id", F.coalesce("component", "class_id").alias("component"))
    empty = documents.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component"))
    out = out.unionByName(empty)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, joined: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: that of the smallest id (a null one where no other has an id), once."""
    if "first" in joined.columns:
        first = joined.where("first").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), (F.col("n_shingles") == 0).alias("_wordless"))
        rows = docs.withColumn("_text", F.md5(F.col(text_col).cast("binary")))
        rows = rows.join(written(first.distinct(), "jaccard-kept"), F.col(id_col).eqNullSafe(F.col("_id")) & F.col("_text").eqNullSafe(F.col("_digest")))
        # Rows equal in id and text are copies; but without id and words each row is a document of its own.
        own = F.col("_wordless") & F.col(id_col).isNull()
        return rows.where(~own).dropDuplicates([id_col, "_text"]).unionByName(rows.where(own)).select(*docs.columns)
    # What goes is fewer than what stays, so texts stay where they are as long as its ids can be broadcast.
    found = written(joined.groupBy("doc_id", "component_id").agg(F.count("*").alias("_rows")), "jaccard-found")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col))
    out = docs.join(F.broadcast(gone) if gone.count() <= MAX_BROADCAST_IDS else gone, id_col, "left_anti")
    return out if found.where("doc_id = component_id and _rows > 1").isEmpty() else out.dropDuplicates([id_col])


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 80 * (s.n + t.n - c)
), edges AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.y, r.c FROM reach r JOIN edges e ON e.x = r.doc_id WHERE r.c < e.y
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
