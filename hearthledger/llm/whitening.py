"""Whitening of embeddings by a singular value decomposition after one-sided Jacobi rotations.

Entries become whole numbers first, x = floor(1024 c) + 100000, so that counts and sums are exact. Three narrow passes over the rows follow: exact sums; a QR
decomposition of the centred rows, block by block, of which each task leaves one triangle R; and, once the components are known, the covariance of the whitened
rows as a check. Triangles (and moments) are merged as a tree, `FAN_BYTES` of them in a task, so that neither a task nor the driver holds more than a few. R has
as many columns as a vector has entries, whatever the number of rows. Plane rotations on pairs of its columns then make these orthogonal, half of all columns at a time; the
lengths of the columns are the standard deviations times sqrt(n), accurate in the small ones too, as no product of R with itself is formed, and the
rotations together are the components.

Defined cases: rows whose vector is null, or holds a null or a value that is not finite, are left out. The space is that of the most frequent length (the
greater of equals); a vector of another length, an empty one too, has no place in it and is left out. A null id and repeated rows count like any
others; columns named like an output are replaced, others pass through if named in `carry`. No rows left give no rows. Where a component has no variance (equal rows, or fewer rows than entries) its
whitened value is 0, its explained share 0, and identity_error leaves it out. A component's sign makes its largest entry positive (the first of equals).
`deviation` is a decimal of 38 digits. An entry beyond 2**40 raises an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table, written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Bytes of triangles or moments that a task merges.
FAN_BYTES = 32 << 20
#: Rows of a batch of vectors.
ROWS = 4096
LARGEST = 2.0**40
_DIGITS = pa.decimal128(38, 0)
_PARTS = "part long, state binary"


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The lists of an Arrow column, all of `width` entries, as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def whole(c: np.ndarray) -> np.ndarray:
    x = np.floor(c * SCALE)
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError("an entry is beyond 2**40 after scaling")
    return x.astype(np.int64) + SHIFT


def merged(parts: DataFrame, merge: Callable[[Sequence[bytes]], bytes], fan: int, name: str) -> bytes | None:
    """One state of many (part, state), merged `fan` at a time in the order of their numbers."""
    parts = written(parts, name)
    while (left := parts.count()) > 1:

        def fold(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("part")
            return pd.DataFrame({"part": [int(rows["part"].iloc[0]) // fan], "state": [merge([bytes(s) for s in rows["state"]])]})

        parts = written(parts.groupBy(F.floor(F.col("part") / fan).alias("_to")).applyInPandas(fold, _PARTS), name)
    return bytes(parts.first()["state"]) if left else None


def triangle(rows: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """R of the QR decomposition of rows below an earlier R."""
    return np.linalg.qr(rows if before is None else np.vstack([before, rows]), mode="r")


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(lengths of R's columns once these are orthogonal, falling; the rotations, a column for each length).

    A round rotates disjoint pairs of columns at once; the rounds of a sweep (a round-robin tournament) meet every pair.
    """
    a, width = np.array(r, dtype=np.float64), r.shape[1]
    turns = np.eye(width)
    places = [*range(width), *([-1] * (width % 2))]
    tiny = np.finfo(np.float64).eps
    for _ in range(sweeps):
        moved = False
        for _ in range(len(places) - 1):
            pairs = [(p, q) for p, q in zip(places[: len(places) // 2], places[::-1]) if p >= 0 and q >= 0]
            places = [places[0], places[-1], *places[1:-1]]
            p, q = (np.array(x, dtype=int) for x in zip(*pairs)) if pairs else (np.empty(0, int), np.empty(0, int))
            ap, aq = a[:, p], a[:, q]
            alpha, beta, gamma = (ap * ap).sum(0), (aq * aq).sum(0), (ap * aq).sum(0)
            turn = np.abs(gamma) > tiny * np.sqrt(alpha) * np.sqrt(beta)
            if not turn.any():
                continue
            moved = True
            p, q, alpha, beta, gamma = p[turn], q[turn], alpha[turn], beta[turn], gamma[turn]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, turns):
                mp, mq = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * mp - s * mq, s * mp + c * mq
        if not moved:
            break
    else:
        raise ArithmeticError("the rotations did not come to an end")
    lengths = np.sqrt((a * a).sum(0))
    order = np.argsort(-lengths, kind="stable")
    turns = turns[:, order]
    top = np.abs(turns).argmax(0)
    return lengths[order], turns * np.where(turns[top, np.arange(width)] < 0, -1.0, 1.0)


class Moments:
    """Count, means and centred products of rows; two of them add up (Chan's update)."""

    def __init__(self, n: float, mean: np.ndarray, products: np.ndarray):
        self.n, self.mean, self.products = n, mean, products

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        mean = rows.mean(0)
        centred = rows - mean
        return cls(len(rows), mean, centred.T @ centred)

    def plus(self, other: Moments) -> Moments:
        n, apart = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n))

    def packed(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.products.ravel()]).tobytes()

    @classmethod
    def unpacked(cls, raw: bytes, width: int) -> Moments:
        v = np.frombuffer(raw)
        return cls(v[0], v[1 : 1 + width], v[1 + width :].reshape(width, width))


def exact_deviation(x: np.ndarray, n: int, mean: np.ndarray, rest: np.ndarray) -> pa.Array:
    """Sum over entries of (n x - S)**2 with S = n mean + rest, as decimals.

    The square is opened, so that the entries meet only numbers that fit 64 bits, and n comes in once for a row.
    """
    d = x - mean
    top, width = int(np.abs(d).max(initial=0)) + 1, x.shape[1]
    if width * (n * top) ** 2 < 2**62:
        z = n * d - rest
        return pa.array((z * z).sum(1)).cast(_DIGITS)
    high, low = rest >> 30, rest & (2**30 - 1)
    if width * top * max(top, 2**30, int(high.max(initial=0)) + 1) < 2**62:
        squares, by_high, by_low = (d * d).sum(1).tolist(), (d @ high).tolist(), (d @ low).tolist()
    else:
        o = d.astype(object)
        squares, by_high, by_low = (o * o).sum(1).tolist(), (o @ high.astype(object)).tolist(), (o @ low.astype(object)).tolist()
    last = sum(int(r) ** 2 for r in rest)
    return pa.array([Decimal(n * n * a - 2 * n * ((b << 30) + c) + last) for a, b, c in zip(squares, by_high, by_low)], _DIGITS)


def whiten(df: DataFrame, vector_col: str = "embedding", carry: Sequence[str] = ("vec_id",), components: int = COMPONENTS) -> DataFrame:
    """(carried columns, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component."""
    spark = df.sparkSession
    bounded_batches(spark, ROWS)
    made = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    carry = [c for c in carry if c not in made and c != vector_col]
    found = df.where(usable(F.col(vector_col))).select(*carry, F.col(vector_col).cast("array<double>").alias("_v"))
    most = found.groupBy(F.size("_v").alias("width")).agg(F.count("*").alias("n")).where("width > 0").orderBy(F.desc("n"), F.desc("width")).first()
    width, n = (most["width"], most["n"]) if most else (1, 0)
    rows = found.where(F.size("_v") == width)
    vectors = rows.select("_v")
    k = min(components, width)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=object)
        for b in batches:
            total = total + whole(matrix(b.column(0), width)).sum(0).astype(object)
        yield pa.record_batch([pa.array([[Decimal(int(t)) for t in total]], pa.list_(_DIGITS))], ["sums"])

    sums = vectors.mapInArrow(summed, "sums array<decimal(38,0)>").select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
    by_place = {r["at"]: int(r["s"]) for r in sums.collect()} if n else {}
    mean = np.array([by_place[i] // n for i in range(width)] if n else [0], dtype=np.int64)
    rest = np.array([by_place[i] % n for i in range(width)] if n else [0], dtype=np.int64)
    part = rest / max(n, 1)

    def centred(b: pa.RecordBatch, at: int = 0) -> np.ndarray:
        return (whole(matrix(b.column(at), width)) - mean) - part

    def triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            if b.num_rows:
                r = triangle(centred(b), r)
        if r is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["part", "state"])

    def merge_triangles(states: Sequence[bytes]) -> bytes:
        r = None
        for s in states:
            r = triangle(np.frombuffer(s).reshape(-1, width), r)
        return r.tobytes()

    fan = lambda numbers: int(min(64, max(2, FAN_BYTES // (8 * numbers))))
    raw = merged(vectors.mapInArrow(triangles, _PARTS), merge_triangles, fan(width * width), "whitening") if n else None
    r = np.frombuffer(raw).reshape(-1, width) if raw else np.zeros((1, width))
    lengths, turns = jacobi(r)
    flat = lengths <= lengths[0] * width * np.finfo(np.float64).eps
    whole_variance = float((lengths**2).sum())
    explained = [0.0 if f or not whole_variance else float(v * v / whole_variance) for v, f in zip(lengths[:k], flat[:k])]
    weights = turns[:, :k] * np.where(flat[:k], 0.0, np.sqrt(max(n, 1)) / np.where(flat[:k], 1.0, lengths[:k]))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for b in batches:
            if b.num_rows:
                m = Moments.of(centred(b) @ weights)
                seen = m if seen is None else seen.plus(m)
        if seen is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([seen.packed()], pa.binary())], ["part", "state"])

    def merge_moments(states: Sequence[bytes]) -> bytes:
        seen = Moments.unpacked(states[0], k)
        for s in states[1:]:
            seen = seen.plus(Moments.unpacked(s, k))
        return seen.packed()

    raw = merged(vectors.mapInArrow(moments, _PARTS), merge_moments, fan(k * k + k + 1), "whitening") if n else None
    error = 0.0
    if raw and not flat[:k].all():
        live = np.flatnonzero(~flat[:k])
        covariance = Moments.unpacked(raw, k).products / n
        error = float(np.abs(covariance[np.ix_(live, live)] - np.eye(len(live))).max())

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.num_columns - 1
            z = centred(b, at) @ weights
            deviation = exact_deviation(whole(matrix(b.column(at), width)), n, mean, rest)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * k), pa.array(z.ravel()))
            yield pa.record_batch([*b.columns[:at], deviation, lists], [*carry, "deviation", "_z"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*carry).schema]
    each = rows.mapInArrow(out, ", ".join([*kept, "deviation decimal(38,0)", "_z array<double>"]))
    each = each.select(*carry, "deviation", F.posexplode("_z").alias("_i", "whitened"))
    return each.select(
        *carry, (F.col("_i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.lit(explained), F.col("_i") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """The deviation is a long by contract: one that does not fit (n beyond some 10**6 for unit vectors) raises an error instead of wrapping around."""
    out = whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))
