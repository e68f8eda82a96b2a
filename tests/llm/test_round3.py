"""Whitening, clustering and mixing: brute force, SQL, edges."""

import hashlib
from fractions import Fraction

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from hearthledger.llm import clustering, mixing, queries, whitening


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.tables(sf_dir)


@pytest.mark.parametrize("name", ["op12_centroid_clustering", "op13_source_mixing"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_rows_as_sql(spark, name, sf):
    path = f"/root/testdata/{sf}"
    got = queries.QUERIES[name](spark, path).toPandas()
    assert oracle.differences(got, oracle.tables(path).execute(queries.SQL[name]).df()) == ""


def vectors(spark, rows, more=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int" + more)


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).astype(np.float32).tolist(), 1) for i in range(300)]
    rows += [(300, None, 1), (301, [None] * 64, 1), (302, [float("nan")] * 64, 1), (303, [float("inf")] + [0.0] * 63, 1), (304, [], 1), (305, [1.0] * 63, 1)]
    rows += [(7, rows[7][1], 1), (None, rows[8][1], None)] + [(400 + i, rows[9][1], 2) for i in range(900)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'old' AS cluster", "'old' AS whitened", "'old' AS n").repartition(5)


def whole_numbers(df):
    rows = [r for r in df.select("vec_id", "embedding").collect() if r[1] is not None and len(r[1]) == 64 and all(x is not None and np.isfinite(x) for x in r[1])]
    return rows


def test_whitening_equals_an_eigendecomposition_of_exact_sums(spark, odd_vectors):
    rows = whole_numbers(odd_vectors)
    x = np.floor(1024 * np.array([r[1] for r in rows], dtype=np.float64)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(0)
    centred = x - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    got = whitening.whiten(odd_vectors).toPandas()
    assert len(got) == 8 * n and set(got["n"]) == {n}
    assert sorted(got["vec_id"].fillna(-1)) == sorted([-1 if r[0] is None else r[0] for r in rows for _ in range(8)])
    exact = {r[0]: sum((n * int(a) - int(t)) ** 2 for a, t in zip(v, total)) for r, v in zip(rows, x)}
    first = got[got["component"] == 1]
    assert all(int(d) == exact[None if i != i else int(i)] for i, d in zip(first["vec_id"], first["deviation"]))
    for k in range(8):
        want = dict(zip([r[0] for r in rows], centred @ axes[:, k] / np.sqrt(values[k])))
        one = got[got["component"] == k + 1]
        have = np.array(one["whitened"])
        wanted = np.array([want[None if i != i else int(i)] for i in one["vec_id"]])
        assert min(np.abs(have - wanted).max(), np.abs(have + wanted).max()) < 1e-7
        assert np.allclose(one["explained"], values[k] / values.sum(), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_does_not_depend_on_partitions(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    a, b = (whitening.whiten(df.repartition(k)).orderBy("vec_id", "component").toPandas() for k in (1, 9))
    assert (a["deviation"] == b["deviation"]).all() and np.allclose(a["whitened"], b["whitened"], atol=1e-9)


def test_triangles_merge_in_many_small_groups(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").repartition(23)
    a = whitening.whiten(df).orderBy("vec_id", "component").toPandas()
    monkeypatch.setattr(whitening, "FAN_BYTES", 1)
    b = whitening.whiten(df).orderBy("vec_id", "component").toPandas()
    assert np.allclose(a["whitened"], b["whitened"], atol=1e-9)


def test_rotations_are_accurate_in_small_standard_deviations():
    rng = np.random.default_rng(1)
    for width in (1, 2, 5, 17):
        a = rng.normal(size=(60, width)) * 10.0 ** -np.arange(width)
        lengths, turns = whitening.jacobi(whitening.triangle(a))
        assert np.allclose(lengths, np.linalg.svd(a, compute_uv=False), rtol=1e-9, atol=0)
        assert np.allclose(turns.T @ turns, np.eye(width), atol=1e-12)


def test_whitening_without_variance_and_without_rows(spark):
    same = whitening.whiten(vectors(spark, [(i, [1.0, 2.0], 0) for i in range(5)])).toPandas()
    assert len(same) == 10 and (same["whitened"] == 0).all() and (same["explained"] == 0).all() and (same["identity_error"] == 0).all()
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i], 0) for i in range(5)])).toPandas()
    assert np.allclose(line[line["component"] == 1]["explained"], 1) and (line[line["component"] == 2]["whitened"] == 0).all()
    assert whitening.whiten(vectors(spark, [(1, None, 0)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [3.0], 0)])).count() == 1


def test_deviation_is_exact_beyond_64_bits():
    rng = np.random.default_rng(5)
    x = rng.integers(-1000, 1000, size=(7, 3)) + 100_000
    for n, mean, rest in ((10, [100_000] * 3, [1, 2, 3]), (10**11, [100_003] * 3, [5, 10**11 - 1, 77]), (10**15, [99_999] * 3, [10**15 - 1] * 3)):
        got = whitening.exact_deviation(x, n, np.array(mean), np.array(rest)).to_pylist()
        assert [int(g) for g in got] == [sum((n * int(a) - n * m - r) ** 2 for a, m, r in zip(row, mean, rest)) for row in x]


def test_clustering_equals_plain_rounds(spark, odd_vectors):
    rows = whole_numbers(odd_vectors)
    points = np.floor(256 * np.array([r[1] for r in rows], dtype=np.float64)).astype(np.int64)
    ids = [r[0] for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (ids[i] is None, hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest(), points[i].tolist()))
    at = points[order[:40]]
    for _ in range(5):
        own = ((points[:, None] - at[None]) ** 2).sum(2).argmin(1)
        at = np.array([[int(s) // int((own == k).sum()) for s in points[own == k].sum(0)] if (own == k).any() else at[k] for k in range(40)])
    distance = ((points[:, None] - at[None]) ** 2).sum(2)
    own = distance.argmin(1)
    want = sorted((-1 if i is None else i, int(k), int(distance[j, k])) for j, (i, k) in enumerate(zip(ids, own)))
    got = clustering.cluster(odd_vectors, carry=["label", "cluster"]).toPandas()
    assert sorted((-1 if i != i else int(i), k, d) for i, k, d in zip(got["vec_id"], got["cluster"], got["distance"])) == want
    assert set(got["inertia"]) == {sum(w[2] for w in want)} and got.groupby("cluster")["cluster_inertia"].nunique().max() == 1
    assert dict(zip(got["cluster"], got["centroid_sha256"])) == {int(k): hashlib.sha256(",".join(map(str, at[k])).encode()).hexdigest() for k in set(own)}


def test_balls_go_whole_only_where_every_point_agrees():
    rng = np.random.default_rng(2)
    centres = rng.integers(-3000, 3000, size=(12, 8))
    points = np.concatenate([c + rng.integers(-20, 20, size=(400, 8)) for c in centres] + [np.tile(centres[:1] + 7, (300, 1))])
    tree, order = clustering.Balls.grown(points)
    assert (tree.points == points[order]).all() and (tree.end - tree.start)[0] == len(points)
    again = clustering.Balls.unpacked(tree.packed(), 8)
    for at in (centres, centres + rng.integers(-200, 200, size=centres.shape), np.repeat(centres[:3], 2, 0), centres[:1]):
        balls, rows, own = again.assigned(at)
        cluster = np.full(len(points), -1)
        for node, k in balls:
            cluster[tree.start[node] : tree.end[node]] = k
        cluster[rows] = own
        assert (cluster == ((tree.points[:, None] - at[None]) ** 2).sum(2).argmin(1)).all()
    balls, rows, _ = again.assigned(centres)
    assert len(rows) < len(points) / 10 and len(balls) < 300  # clear groups: only leaves that halving has mixed are compared


def test_clustering_of_few_and_no_vectors(spark):
    few = clustering.cluster(vectors(spark, [(i, [float(i)] * 64, 0) for i in range(3)])).toPandas()
    assert len(few) == 3 and (few["distance"] == 0).all() and set(few["cluster"]) == {0, 1, 2}
    assert clustering.cluster(vectors(spark, [(1, None, 0), (2, [1.0], 0)])).count() == 0
    with pytest.raises(Exception, match="beyond"):
        clustering.cluster(vectors(spark, [(1, [1e30] * 64, 0)])).count()


def shares(sizes: dict, weights=(5, 2, 1)) -> dict:
    """Targets in fractions."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        open_ = sum(weight[s] for s in names if s not in full)
        each = {s: weight[s] * (total - sum(2 * sizes[f] for f in full)) / open_ for s in names if s not in full} if open_ else {}
        more = {s for s, v in each.items() if v > 2 * sizes[s]}
        if not more:
            return {s: float(2 * sizes[s] if s in full else each[s]) for s in names}
        full |= more


def test_mixing_meets_targets(spark, odd_docs):
    got = mixing.mix(odd_docs, carry=["n_words"]).toPandas()
    assert len(got) == odd_docs.count() and set(got["n_words"]) == {"old"}
    sizes = {None if s is None else s: int(v) for s, v in got.groupby(got["source"].where(got["source"].notna(), None), dropna=False)["size"].sum().items() if s == s} | {None: int(got[got["source"].isna()]["size"].sum())}
    want = shares(sizes)
    for row in got.itertuples():
        assert row.target == pytest.approx(want[None if row.source is None or row.source != row.source else row.source], rel=1e-12)
        assert row.taken <= 2 * row.size and row.taken == row.size * row.times
    again = mixing.mix(odd_docs.repartition(7)).toPandas()
    key = ["doc_id", "source", "size", "target", "taken"]
    assert oracle.differences(got[key], again[key]) == ""


@pytest.mark.parametrize("limit", [0, 10_000])
def test_mixing_is_near_with_few_and_many_sources(spark, monkeypatch, limit):
    """Both ways to join sources give the same rows; what is left of a target is less than any document that was not taken."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = mixing.mix(docs).toPandas()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    got = mixing.mix(docs.repartition(3)).toPandas()
    assert oracle.differences(got, want) == ""
    sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(sums["taken"] - sums["target"]) <= 0.02 * sums["target"]).all()  # 50 documents a source


def test_mixing_of_equal_rows_and_nested_budgets(spark):
    same = spark.createDataFrame([(1, "one two three", "a")] * 50 + [(i, "word " * 10, "b") for i in range(40)], "doc_id long, text string, source string")
    got = mixing.mix(same, weights=(1, 3)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).toPandas()
    assert (abs(got["t"] - got["target"]) < 10).all()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.lit("one")).withColumn("size", F.lit(0))
    small, large = (mixing.mix(docs, share=s, tolerance=1.0).toPandas() for s in (0.3, 0.6))
    assert set(small[small["taken"] > 0]["doc_id"]) <= set(large[large["taken"] > 0]["doc_id"])
    assert mixing.mix(same.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", ""), (3, " \n", "a")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(blank).collect()] == [0, 0, 0]
