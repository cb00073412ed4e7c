import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.llm import shared
from copse.llm import voronoi_knn as voronoi
from copse.llm.anisotropic_ann import anisotropic_ann, encode, fit, probes_for, unit
from copse.llm.vectors import block_rows, grouped
from copse.llm.voronoi_knn import voronoi_knn


def table(spark, extra=()):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    x = centres[rng.integers(0, 6, 600)] + rng.normal(size=(600, 16)) * 0.4
    x[300:420] = x[300]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + list(extra)
    return rows, spark.createDataFrame([(i, v, 1, 2.0, True) for i, v in rows], "vec_id long, embedding array<float>, cell int, dist double, q boolean")


ODD = [(1000, None), (1001, [1.0] * 15 + [float("nan")]), (1002, [float("inf")] * 16), (1003, [0.0] * 16), (1004, [1.0, 2.0]), (None, [1.0] * 16), (1005, [1.0, None] * 8), (1006, [])]


def usable(rows, zero=True):
    ids, x = [], []
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and (zero or any(v)):
            ids.append(i)
            x.append(np.float32(list(v) + [0.0] * (16 - len(v))).astype(np.float64))
    return np.array(ids), np.array(x)


@pytest.mark.parametrize("block", [64, 4096])
def test_exact_search(spark, block):
    rows, df = table(spark, ODD)
    ids, x = usable(rows)
    x = np.floor(256 * x)
    want = []
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:5]
        want += [(int(ids[i]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)]
    got = voronoi_knn(df, F.col("vec_id") % 50 == 0, data_block=block, query_block=7)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def exact(rows, scale=256, k=5):
    """The same by brute force over (vec_id, vector)."""
    ids, x = np.array([i for i, _ in rows]), np.floor(scale * np.float32([v for _, v in rows]).astype(np.float64))
    want = []
    for v in np.unique(ids[ids % 50 == 0]):
        best = sorted(((-int(s), int(i)) for q in x[ids == v] for s, i in zip(x @ q, ids, strict=True) if i != v))[:k]
        want += [(int(v), r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(want)


@pytest.mark.parametrize("dims", [2, 3])
@pytest.mark.parametrize("copies", [2, 6, 400])
def test_many_vectors_of_one_id(spark, copies, dims):
    """Rows of the query's own vec_id lie nearer than all others, in cells of their own, and take no place."""
    rng = np.random.default_rng(copies + dims)
    own = rng.normal(size=(copies, dims)) * 3 + 10
    far = rng.normal(size=(60, dims)) - 4
    rows = [(50, [float(c) for c in v]) for v in own] + [(1000 + i, [float(c) for c in v]) for i, v in enumerate(far)]
    got = voronoi_knn(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 50)
    assert sorted((r.query_id, r.rank, r.score) for r in got.collect()) == [(q, r, s) for q, r, _, s in exact(rows) if q == 50]


def test_wide_components(spark):
    rng = np.random.default_rng(3)
    for width in (1.0, 1e4, 1e8):
        rows = [(i, [float(np.float32(c)) for c in v * width]) for i, v in enumerate(rng.integers(-9, 9, size=(120, 3)) / 256)]
        got = voronoi_knn(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0)
        assert sorted(map(tuple, got.collect())) == exact(rows)


def test_rings_leave_rows_out(spark, monkeypatch):
    """Far clusters are not copied to groups that cannot need them, and the result is exact all the same."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(8, 6))
    centres *= 20 / np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.float32(centres[np.arange(1600) % 8] + rng.normal(size=(1600, 6)) * 0.2).astype(np.float64)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    copied = []

    def settle(table, name):
        out = shared.settle(table, name)
        copied.extend([out.count()] if name == "copied" else [])
        return out

    monkeypatch.setattr(voronoi, "settle", settle)
    got = {}
    for r in voronoi_knn(df, F.col("vec_id") % 20 == 0, query_block=10).collect():
        got.setdefault(r.query_id, []).append(r.score)
    x = np.floor(256 * x)
    assert len(got) == 80
    for i, scores in got.items():
        s = x @ x[i]
        s[i] = -np.inf
        assert scores == sorted(map(int, np.sort(s)[-5:]), reverse=True)
    assert copied[0] <= 2 * 1600  # of eight groups


def test_repeated_ids(spark):
    """Rows of one vec_id are candidates each, and never their own; as queries they share the ranks."""
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = [tuple(r) for r in voronoi_knn(df, F.col("vec_id") == 50).orderBy("rank").collect()]
    assert [r[1:] for r in exact] == [(1, 4, 2 * 65536), (2, 3, 65536), (3, 3, 65536), (4, 3, 65536), (5, 3, 65536)]
    found = [(r.vec_id, round(r.score, 6)) for r in anisotropic_ann(df, F.col("vec_id") == 50).orderBy("rank").collect()]
    assert found == [(4, 1.0), (3, 0.707107), (3, 0.707107), (3, 0.707107), (3, 0.707107)]


def test_production_recall(spark):
    """The registered query's parameters, on clustered and on shapeless vectors."""
    rng = np.random.default_rng(4)
    for spread in (0.3, 50.0):
        x = np.float32(rng.normal(size=(40, 32))[rng.integers(0, 40, 9000)] + spread * rng.normal(size=(9000, 32)))
        df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
        u = unit(x.astype(np.float64))
        s = u[::50] @ u.T
        s[np.arange(180), np.arange(0, 9000, 50)] = -np.inf
        edge = np.sort(s, axis=1)[:, -5]
        got = anisotropic_ann(df, F.col("vec_id") % 50 == 0).collect()
        assert len(got) == 900 and sum(r.score >= edge[r.query_id // 50] - 1e-12 for r in got) >= 0.9 * 900
        assert probes_for(u[:4096], grouped(u[:4096], 23)[0], 5, 0.99) <= (6 if spread < 1 else 23)


def test_few_candidates_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (7, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in voronoi_knn(few, F.col("vec_id") == 0).collect()] == [(0, 1, 7, 4 * 256 * 256)]
    assert [(r.query_id, r.vec_id) for r in anisotropic_ann(few, F.col("vec_id") == 0).collect()] == [(0, 7)]
    none = few.where("false")
    assert voronoi_knn(none, F.lit(True)).collect() == [] and anisotropic_ann(none, F.lit(True)).collect() == []


def test_recall_and_scores(spark):
    rows, df = table(spark, ODD)
    ids, x = usable(rows, zero=False)
    got = {}
    for r in anisotropic_ann(df, F.col("vec_id") % 50 == 0, rerank=40, data_block=200).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[i])
        own = ids != ids[i]
        edge = np.sort(s[own])[-5]
        assert all(abs(v - s[list(ids).index(j)]) < 1e-12 for j, v in got[ids[i]].items())
        hits += sum(v >= edge - 1e-12 for v in got[ids[i]].values())
        total += 5
    assert hits / total >= 0.9


def uneven(kind):
    """Rows that codes or cells of a sample tell little about."""
    rng = np.random.default_rng(21)
    n = 3000
    if kind == "tight":
        return rng.normal(size=(4, 16))[rng.integers(0, 4, n)] + 0.01 * rng.normal(size=(n, 16))
    if kind == "plane":
        return rng.normal(size=(n, 2))
    x = rng.normal(size=(n, 16))
    if kind == "copies":
        x[rng.random(n) < 0.5] = x[0]
    if kind == "queries elsewhere":
        x = rng.normal(size=(40, 16))[rng.integers(0, 40, n)] + 0.1 * x
        x[::50] = rng.normal(size=(60, 16))
    return x


def nearest(x, i, k=5):
    """Ids of the k largest cosines to row i of all others, ties (to 1e-12) to smaller ids."""
    s = np.round((x * x[i]).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(x[i]), 12)
    s[i] = -np.inf
    return np.argsort(-s, kind="stable")[:k].tolist()


@pytest.mark.parametrize("kind", ["tight", "plane", "copies", "queries elsewhere"])
def test_recall_on_uneven_rows(spark, kind):
    x = np.float32(uneven(kind)).astype(np.float64)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    for cover, least in ((0.99, 0.95), (1.0, 1.0)):
        got = {}
        for r in anisotropic_ann(df, F.col("vec_id") % 50 == 0, cover=cover).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert len(got) == 60 and all(len(v) == 5 for v in got.values())
        assert sum(len(v & set(nearest(x, i))) for i, v in got.items()) >= least * 300


@pytest.mark.parametrize("length", [1e200, 1e-200])
def test_cosines_of_very_long_and_short_vectors(spark, length):
    x = np.random.default_rng(22).normal(size=(300, 6))
    df = spark.createDataFrame([(i, (r * length).tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in anisotropic_ann(df, F.col("vec_id") % 50 == 0, data_block=100, cover=1.0).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {i: nearest(x, i) for i in range(0, 300, 50)}


def test_parallel_error_costs_more():
    x = unit(np.random.default_rng(5).normal(size=(800, 16)))
    errors = {}
    for weight in (1.0, 6.0):
        centres = fit(x, 2, weight)
        codes = encode(x, centres, weight)
        back = np.stack([centres[j][codes[:, j]] for j in range(8)], axis=1).reshape(800, 16)
        errors[weight] = float((((x - back) * x).sum(1) ** 2).mean())
    assert errors[6.0] < errors[1.0]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_scores_are_as_exact_as_the_vectors(spark, kind):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 8))
    x = np.float32(x).astype(np.float64) if kind == "float" else x
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = anisotropic_ann(df, F.col("vec_id") % 50 == 0, data_block=100).collect()
    assert len(got) == 30
    for r in got:
        a, b = x[r.query_id], x[r.vec_id]
        assert abs(r.score - (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))) < 1e-14


def test_blocks_follow_the_rows_and_the_memory():
    assert [block_rows(n, 64) for n in (1, 10_000, 500_000, 10**9)] == [1024, 1024, 7812, 16_384]
    assert block_rows(10**9, 4096) == 1024 and block_rows(10**9, 10**6) == 64
