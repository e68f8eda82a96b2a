"""Clustering around centroids (Lloyd's rounds on whole numbers), filtered by ball trees.

Each block of a partition's rows becomes a metric tree once: a ball has a centre, a radius, the count and the exact sum of its vectors, and is halved along the
line between two far points until it holds `LEAF` vectors or equal ones only. The trees are written to the shared folder. A round sends the centroids to all
tasks, which walk their trees from the roots, level by level: a centroid that by the triangle inequality is further from every point of a ball than another one is
dropped below that ball; a ball left with one centroid goes to it whole, with its sum and count, and a leaf left with several compares its vectors exactly. Ties are
never settled by a ball: rounding has a margin, within which the leaf decides. A task sends a sum for each centroid, so a round shuffles centroids x tasks
rows, and the driver meets centroids x entries numbers.

Defined cases: only vectors of exactly `width` entries, none null or not finite, are kept. Entries become floor(256 x). The first centroids are the kept vectors
with the smallest sha256 of the seed and the id (equal ids: by the vector; a null id last), so with fewer vectors there are fewer centroids. Equal distances
go to the smaller number; a centroid without vectors stays. Repeated rows each count. No kept rows give no rows. Other columns are carried if named, unless named like an output. An entry beyond 2**27 raises an
error, as distances must fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table, written
from .whitening import matrix, usable

SCALE = 256
WIDTH, CENTROIDS, ROUNDS, SEED = 64, 40, 5, 2
#: Vectors of a tree and of a leaf.
BLOCK, LEAF = 4096, 32
LARGEST = 2.0**27
_TREE = "members array<struct<{}>>, points binary, node_from binary, node_to binary, node_left binary, node_radius binary, node_sum binary"


def whole(c: np.ndarray) -> np.ndarray:
    x = np.floor(c * SCALE)
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError("an entry is beyond 2**27 after scaling")
    return x.astype(np.int64)


class Balls:
    """A metric tree over rows of whole numbers: `order` puts the rows as the leaves have them; node i holds rows from[i] to to[i] of that order, its halves are left[i] and left[i] + 1 (0: a leaf)."""

    def __init__(self, points, start, end, left, radius, sums):
        self.points, self.start, self.end, self.left, self.radius, self.sums = points, start, end, left, radius, sums

    @classmethod
    def grown(cls, points: np.ndarray) -> tuple[Balls, np.ndarray]:
        order = np.arange(len(points))
        start, end, left, radius, sums = [0], [len(points)], [0], [], []
        at = 0
        while at < len(start):
            own = order[start[at] : end[at]]
            p = points[own].astype(np.float64)
            sums.append(points[own].sum(0))
            off = np.sqrt(((p - sums[-1] / len(own)) ** 2).sum(1))
            far = int(off.argmax())
            radius.append(float(off[far]))
            if len(own) > LEAF and not (points[own] == points[own[0]]).all():
                other = int(((p - p[far]) ** 2).sum(1).argmax())
                half = len(own) // 2
                order[start[at] : end[at]] = own[np.argpartition(p @ (p[other] - p[far]), half)]
                left[at] = len(start)
                start += [start[at], start[at] + half]
                end += [start[at] + half, end[at]]
                left += [0, 0]
            at += 1
        return cls(points[order], np.array(start), np.array(end), np.array(left), np.array(radius), np.array(sums)), order

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(x, dtype=t).tobytes() for x, t in ((self.points, "<i4"), (self.start, "<i4"), (self.end, "<i4"), (self.left, "<i4"), (self.radius, "<f8"), (self.sums, "<i8"))]

    @classmethod
    def unpacked(cls, raw: Sequence[bytes], width: int) -> Balls:
        points, start, end, left = (np.frombuffer(x, "<i4").astype(np.int64) for x in raw[:4])
        return cls(points.reshape(-1, width), start, end, left, np.frombuffer(raw[4], "<f8"), np.frombuffer(raw[5], "<i8").reshape(-1, width))

    def assigned(self, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        """([(ball, its centroid)], rows that leaves had to compare, their centroids)."""
        c = centroids.astype(np.float64)
        squares = (c * c).sum(1)
        nodes, open_ = np.array([0]), np.ones((1, len(c)), bool)
        balls: list[tuple[int, int]] = []
        leaves: list[int] = []
        while len(nodes):
            centre = self.sums[nodes] / (self.end[nodes] - self.start[nodes])[:, None]
            own = (centre * centre).sum(1)
            distance = np.sqrt(np.maximum(own[:, None] - 2 * centre @ c.T + squares, 0.0))
            distance[~open_] = np.inf
            nearest = distance.argmin(1)
            margin = 1e-6 * (1 + np.sqrt(own.max()) + np.sqrt(squares.max()))
            reach = 2 * self.radius[nodes] + margin
            open_ = distance <= (distance[np.arange(len(nodes)), nearest] + reach)[:, None]
            sure = open_.sum(1) == 1
            balls += zip(nodes[sure].tolist(), nearest[sure].tolist())
            split = ~sure & (self.left[nodes] > 0)
            leaves += nodes[~sure & (self.left[nodes] == 0)].tolist()
            below = self.left[nodes[split]]
            nodes, open_ = np.concatenate([below, below + 1]), np.concatenate([open_[split]] * 2)
        rows = np.concatenate([np.arange(self.start[i], self.end[i]) for i in leaves]) if leaves else np.empty(0, np.int64)
        return balls, rows, nearest_of(self.points[rows], centroids)


def nearest_of(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each row, exactly; of equals the smallest."""
    if not len(points):
        return np.empty(0, np.int64)
    top = int(max(np.abs(points).max(), np.abs(centroids).max()))
    if 4 * points.shape[1] * top * top < 2**53:  # whole numbers that doubles hold exactly
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((c * c).sum(1) - 2 * p @ c.T).argmin(1)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], 1).argmin(1)


def trees(df: DataFrame, vector_col: str, carry: Sequence[str], width: int) -> DataFrame:
    """A written table with a row for each block of kept rows: the carried columns in the order of the leaves, and the packed tree."""
    kept = df.where(usable(F.col(vector_col)) & (F.size(vector_col) == width)).select(*carry, F.col(vector_col).cast("array<double>").alias("_v"))
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in kept.select(*carry).schema)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(rows: pa.Table) -> pa.RecordBatch:
            balls, order = Balls.grown(whole(matrix(rows.column("_v"), width)))
            own = rows.select(list(carry)).take(pa.array(order)).combine_chunks()
            members = pa.StructArray.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in own.columns], fields=list(own.schema))
            lists = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), members)
            return pa.record_batch([lists, *(pa.array([x], pa.binary()) for x in balls.packed())], ["members", "points", "node_from", "node_to", "node_left", "node_radius", "node_sum"])

        held: list[pa.Table] = []
        n = 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            n += b.num_rows
            while n >= BLOCK:
                rows = pa.concat_tables(held)
                yield tree(rows.slice(0, BLOCK))
                held, n = [rows.slice(BLOCK)], n - BLOCK
        if n:
            yield tree(pa.concat_tables(held))

    return written(kept.mapInArrow(grow, _TREE.format(fields)), "clustering")


def each_tree(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, int, Balls]]:
    for b in batches:
        for i in range(b.num_rows):
            yield b, i, Balls.unpacked([b.column(j)[i].as_buffer() for j in range(b.num_columns - 6, b.num_columns)], width)


def sums_of(grown: DataFrame, centroids: np.ndarray) -> list[tuple[int, list[int]]]:
    """(count, sums) of the vectors that go to each centroid."""
    k, width = centroids.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), dtype=np.int64)
        for _, _, t in each_tree(batches, width):
            balls, rows, own = t.assigned(centroids)
            if balls:
                at, to = np.array(balls).T
                np.add.at(total, to, np.column_stack([t.end[at] - t.start[at], t.sums[at]]))
            if len(rows):
                order = np.argsort(own, kind="stable")
                own, first = own[order], np.flatnonzero(np.diff(own[order], prepend=-1))
                total[own[first]] += np.column_stack([np.diff(first, append=len(own)), np.add.reduceat(t.points[rows[order]], first, axis=0)])
        yield pa.record_batch([pa.array(np.arange(k), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    parts = grown.drop("members").mapInArrow(summed, "cluster int, sums array<long>")
    each = parts.select("cluster", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {(r["cluster"], r["at"]): int(r["s"]) for r in each.collect()}
    return [(found[i, 0], [found[i, j + 1] for j in range(width)]) for i in range(k)]


def placed(grown: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(carried columns, cluster, distance) of each vector."""
    width = centroids.shape[1]
    members = grown.schema["members"].dataType.elementType
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in members]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, t in each_tree(batches, width):
            balls, rows, own = t.assigned(centroids)
            cluster = np.empty(len(t.points), np.int64)
            for node, k in balls:
                cluster[t.start[node] : t.end[node]] = k
            cluster[rows] = own
            distance = ((t.points - centroids[cluster]) ** 2).sum(1)
            columns = b.column(0)[i].values.flatten()
            yield pa.record_batch([*columns, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], [*members.names, "cluster", "distance"])

    return grown.mapInArrow(out, ", ".join([*fields, "cluster int", "distance long"]))


def cluster(
    df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", carry: Sequence[str] = (), width: int = WIDTH, centroids: int = CENTROIDS,
    rounds: int = ROUNDS, seed: int = SEED,
) -> DataFrame:
    """(id, carried columns, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector."""
    spark = df.sparkSession
    bounded_batches(spark, BLOCK)
    made = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    grown = trees(df, vector_col, [id_col, *(c for c in carry if c not in made and c not in (id_col, vector_col))], width)
    points = df.where(usable(F.col(vector_col)) & (F.size(vector_col) == width)).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256).alias("h"), F.col(vector_col).cast("array<double>").alias("v"))
    first = points.orderBy(F.col("h").asc_nulls_last(), "v").limit(centroids).collect()
    at = whole(np.array([r["v"] for r in first], dtype=np.float64).reshape(-1, width))
    for _ in range(rounds if len(at) else 0):
        moved = np.array([[s // n for s in sums] if n else old for (n, sums), old in zip(sums_of(grown, at), at.tolist())], dtype=np.int64)
        if (moved == at).all():  # later rounds would change nothing
            break
        at = moved
    if not len(at):
        at = np.zeros((1, width), np.int64)
    out = placed(grown, at)
    sums = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    known = [(Decimal(sums.get(k, 0)), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for k, row in enumerate(at.tolist())]
    of = lambda i, kind: F.element_at(F.array(*[F.lit(x[i]).cast(kind) for x in known]), F.col("cluster") + 1)
    return out.withColumns({
        "cluster_inertia": of(0, "decimal(38,0)").cast("long"), "inertia": F.lit(Decimal(sum(sums.values()))).cast("decimal(38,0)").cast("long"), "centroid_sha256": of(1, "string"),
    })


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The same rounds in SQL: all distances of each round, as whole numbers."""
    kept = f"v AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = {WIDTH} AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true))"
    parts = [
        kept, "e AS MATERIALIZED (SELECT rid, vec_id, i, CAST(floor(256 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM v, range(1, 65) r(i))",
        f"s AS (SELECT rid, row_number() OVER (ORDER BY sha256(concat('{SEED}:', vec_id))) - 1 AS k FROM v QUALIFY k < {CENTROIDS})", "c0 AS MATERIALIZED (SELECT k, i, x FROM s JOIN e USING (rid))",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"d{r} AS (SELECT rid, k, CAST(sum((e.x - c.x) * (e.x - c.x)) AS BIGINT) AS d FROM e JOIN c{r} c USING (i) GROUP BY rid, k)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1)")
        if r < ROUNDS:
            parts.append(f"m{r} AS (SELECT k, i, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM a{r} JOIN e USING (rid) GROUP BY k, i)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce((t - ((t % n) + n) % n) // n, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.k = c.k AND m.i = c.i)")
    parts.append(f"h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS sha FROM c{ROUNDS} GROUP BY k)")
    return "WITH " + ", ".join(parts) + f""" SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (rid) JOIN h ON h.k = a.k"""


OP12_SQL = _sql()
