"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors become integers, floor(scale * x). One more coordinate, sqrt(M - |x|^2) for data (M: the largest |x|^2) and 0 for
queries, turns the largest inner product into the smallest distance: |q - x|^2 = |q|^2 + M - 2 q.x. Data and queries are grouped
by their nearest pivot; pivots are rows, about the square root of their number. Each cell of data is summarised by its radii and the k + 1 smallest of 256 distances to the pivot,
each the least of a part of the cell. All rows of a vec_id are in one part, so a query leaves its own vec_id's part of every cell out; the k-th least of what the others
give is an upper bound t of its k-th distance. A cell is out of a query's reach if the plane
between the two pivots is farther from the query than t; of the others the triangle inequality leaves a ring around the pivot.
Queries of neighbouring cells (k-means over the pivots) form a group; a group unites its queries' rings cell by cell, and a data row is copied only to the groups
whose ring in its cell holds it. Groups hold about `query_block` queries (up to 16,384), so where nothing can be left out a row is copied once
for a block of queries, as an exact search must. Copies are searched in blocks, each giving k rows a query at most.

Only pivots (at most `pivots`), cells' summaries and groups' rings (at most `groups` for each cell) reach the driver or are broadcast; these bounds do not grow with the data.

Behaviour: vectors null or with null, NaN or infinite components take no part, nor do rows of null vec_id. Shorter vectors count as
if zeros followed. A query meets all rows but those of its own vec_id. Fewer candidates give fewer rows. Repeated rows are
candidates each; queries of one vec_id share its k ranks. Scores are exact while |floor(scale * x)| sums stay below 2^53. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copse.llm.shared import drop, ints, settle
from copse.llm.shared import groups as runs_of
from copse.llm.vectors import best, binary, block_rows, from_binary, grouped, matrix, usable


#: Parts of a cell, by a hash of vec_id.
PARTS = 256


def _whole(widest: float) -> type:
    """The narrowest type that holds all components."""
    return np.int16 if widest < 1 << 15 else np.int32 if widest < 1 << 31 else np.float64


def _cells(scale: float, dims: int, top: float, kind: type, pivots: np.ndarray, square: np.ndarray):
    """Each row's integer vector, its cell and its distance to the cell's pivot; `top` is M."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.floor(scale * matrix(batch.column("embedding"), dims))
            cell, dist = np.empty(len(x), dtype=np.int64), np.empty(len(x))
            query = batch.column("is_query").to_numpy(zero_copy_only=False)
            lift = np.where(query, 0.0, np.sqrt(np.maximum(0.0, top - (x * x).sum(1))))
            d = _distances(x, lift, pivots, square)
            cell = d.argmin(1)
            dist = d[np.arange(len(x)), cell]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("is_query"), ints(cell), pa.array(dist), binary(x.astype(kind))], names=["vec_id", "is_query", "cell", "dist", "v"])

    return run


def _distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Distances of rows with the lifted coordinate to pivots of one more coordinate."""
    d2 = (x * x).sum(1)[:, None] + (lift * lift)[:, None] + square[None, :] - 2 * (x @ pivots[:, :-1].T + lift[:, None] * pivots[None, :, -1])
    return np.sqrt(np.maximum(d2, 0.0))


def _reach(dims: int, kind: type, pivots: np.ndarray, square: np.ndarray, cells: dict[int, tuple], k: int, group_of: np.ndarray):
    """For each query group and cell, the lowest and highest distance to the pivot that some query of the group may need."""
    ids = np.array(sorted(cells))
    near, radius = np.array([cells[c][0] for c in ids]), np.array([cells[c][1] for c in ids])
    first = np.concatenate([[low for low, _ in cells[c][2]] for c in ids])
    part = np.concatenate([[part for _, part in cells[c][2]] for c in ids])
    own = np.repeat(np.arange(len(ids)), [len(cells[c][2]) for c in ids])
    p = pivots[ids]
    between = np.sqrt(np.maximum(0.0, square[:, None] + square[ids][None, :] - 2 * pivots @ p.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups_ = int(group_of.max()) + 1
        low, high = np.full((groups_, len(ids)), np.inf), np.full((groups_, len(ids)), -np.inf)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                q, cell = from_binary(batch.column("v"), kind, dims).astype(np.float64), batch.column("cell").to_numpy()
                d, home = _distances(q, np.zeros(len(q)), p, square[ids]), batch.column("dist").to_numpy()
                upper = np.where(batch.column("part").to_numpy()[:, None] == part[None, :], np.inf, d[:, own] + first[None, :])
                t = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] >= k else np.full(len(q), np.inf)
                t = (t * (1 + 1e-6) + 1e-6)[:, None]
                gap = between[cell]
                plane = np.where(gap > 0, (d * d - (home * home)[:, None]) / np.maximum(2 * gap, 1e-300), 0.0)
                lo, hi = d - t, d + t
                need = (lo <= radius) & (hi >= near) & (plane <= t * (1 + 1e-6))
                order = np.argsort(group_of[cell], kind="stable")
                g, start = np.unique(group_of[cell][order], return_index=True)
                low[g] = np.minimum(low[g], np.minimum.reduceat(np.where(need, lo, np.inf)[order], start, axis=0))
                high[g] = np.maximum(high[g], np.maximum.reduceat(np.where(need, hi, -np.inf)[order], start, axis=0))
        g, c = np.nonzero(low <= high)
        yield pa.RecordBatch.from_arrays([ints(g), ints(ids[c]), pa.array(low[g, c]), pa.array(high[g, c])], names=["grp", "cell", "low", "high"])

    return run


def _solve(dims: int, kind: type, k: int):
    """The k best of each block of data for each of its queries; the block's rows and queries are tagged by is_query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs_of(batches, ["grp", "qb", "db"]):
            query = rows.column("is_query").to_numpy(zero_copy_only=False)
            ids = rows.column("vec_id").to_numpy()
            v = from_binary(rows.column("v").combine_chunks(), kind, dims)
            q, x, qid, xid = v[query], v[~query].astype(np.float64), ids[query], ids[~query]
            if not len(q) or not len(x):
                continue
            for lo in range(0, len(q), 256):
                s = q[lo : lo + 256].astype(np.float64) @ x.T
                s[qid[lo : lo + 256, None] == xid[None, :]] = -np.inf
                at = best(s, xid, k)
                score = np.take_along_axis(s, at, 1)
                keep = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([ints(np.repeat(qid[lo : lo + 256], keep.sum(1))), ints(xid[at][keep]), ints(score[keep])], names=["query_id", "vec_id", "score"])

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def crossed(queries: DataFrame, data: DataFrame) -> DataFrame:
    """Query rows (with `grp`, `qb`, `nd`) and data rows (with `grp`, `db`, `nq`) once for each pair of a query block and a data block of their group."""
    q = queries.withColumn("db", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nd") - 1)))
    x = data.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)))
    cols = ["grp", "qb", "db", "is_query", "vec_id", "v"]
    return q.select(*cols).unionByName(x.select(*cols)).repartition("grp", "qb", "db").sortWithinPartitions("grp", "qb", "db")


def voronoi_knn(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, pivots: int = 2048, groups: int = 128, query_block: int | None = None, data_block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest integer inner products for every row of `vectors` where `is_query`."""
    spark = vectors.sparkSession
    rows = vectors.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("q"))
    whole = F.transform("embedding", lambda x: F.floor(x * scale).cast("double"))
    norm = F.aggregate(whole, F.lit(0.0), lambda s, x: s + x * x)
    widest = F.array_max(F.transform(whole, F.abs))
    dims, top, widest, n, asking = rows.agg(F.max(F.size("embedding")), F.max(norm), F.max(widest), F.count("*"), F.count_if("q")).first()
    if not dims or not asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    query_block, data_block = query_block or block_rows(asking, dims), data_block or block_rows(n, dims)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(pivots, max(16, math.isqrt(n)))).select("embedding").toArrow()
    base = np.floor(scale * matrix(chosen.column("embedding"), dims))
    p = np.unique(np.hstack([base, np.sqrt(np.maximum(0.0, top - (base * base).sum(1)))[:, None]]), axis=0)
    square, kind = (p * p).sum(1), _whole(widest)
    tagged = rows.withColumn("is_query", F.explode(F.when(F.col("q"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))).drop("q")
    cells = settled = settle(tagged.mapInArrow(_cells(scale, dims, top, kind, p, square), "vec_id long, is_query boolean, cell long, dist double, v binary"), "cells")
    cells = cells.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS)))
    data, queries = cells.where("not is_query"), cells.where("is_query")
    few = data.groupBy("cell", "part").agg(F.min("dist").alias("low"), F.max("dist").alias("high"))  # some rows' distances: an upper bound all the same
    summary = few.groupBy("cell").agg(F.min("low"), F.max("high"), F.slice(F.array_sort(F.collect_list(F.struct("low", "part"))), 1, k + 1)).collect()
    by_cell = {int(r[0]): (float(r[1]), float(r[2]), [tuple(x) for x in r[3]]) for r in summary}
    group_of = grouped(p[:, :-1], min(groups, max(1, -(-asking // query_block))))[1]
    rings = queries.mapInArrow(_reach(dims, kind, p, square, by_cell, k, group_of), "grp long, cell long, low double, high double").groupBy("grp", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    rings = settle(rings, "rings")
    copied = settle(data.join(F.broadcast(rings), "cell").where("dist between low and high").select("grp", "vec_id", "is_query", "v"), "copied")
    where = F.broadcast(spark.createDataFrame([(i, int(g)) for i, g in enumerate(group_of)], "cell long, grp long"))
    grouped_ = settle(queries.join(where, "cell").select("grp", "vec_id", "is_query", "v"), "asking")
    drop(settled, rings)
    nd = copied.groupBy("grp").agg(F.ceil(F.count("*") / data_block).alias("nd"))
    nq = grouped_.groupBy("grp").agg(F.ceil(F.count("*") / query_block).alias("nq"))
    sizes = F.broadcast(settle(nd.join(nq, "grp"), "blocks"))  # a row a group
    salt = F.xxhash64("vec_id", F.monotonically_increasing_id())
    q = grouped_.withColumn("salt", salt).join(sizes, "grp").withColumn("qb", F.pmod("salt", "nq"))
    x = copied.withColumn("salt", salt).join(sizes, "grp").withColumn("db", F.pmod("salt", "nd"))
    found = crossed(q, x).mapInArrow(_solve(dims, kind, k), "query_id long, vec_id long, score long")
    return ranked(found, k)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
