"""Approximate nearest neighbours by score-aware anisotropic quantisation.

Unit vectors are cut into subspaces of `sub` dimensions, each coded by one of 16 centres (four bits, two codes a byte). Codes
and centres minimise an anisotropic loss: of a row's residual r, the part parallel to the row, which moves the inner products that
matter, costs `parallel` times as much as the rest: |r|^2 + (parallel - 1) (r.x)^2. Codes are found by coordinate descent over
the subspaces (the parallel part couples them), centres by solving that loss on a bounded sample of at most `sample` rows, the
only part fitted on a sample; every row is coded. A query's table of 16 scores a subspace is joined into 256 scores a byte, scanned over
a block's codes; the `rerank` best of each block are scored exactly on the original vectors, in double precision. So is every other row
that could still be among the k best by its scan, so nothing is lost in a block however coarse the codes are for it. With x the unit row, c what its codes stand for, a = c.x and p = |c - a x|,
a row of cosine s to the query has a scan of at least s a - sqrt(1 - s^2) p, which grows with s: rows whose scan is below that at the
k-th best cosine known (of the block, or of a bounded part of the sample) are out. a and p, kept with each code, are the parallel and the other part of its error: few rows are left where neighbours are near,
or codes good; rows that codes cannot tell apart are all scored. Rows travel with their codes and with their vectors as they came (single
precision stays single), once for a block of up to 16,384 queries.

Rows are filed under the nearest of at most `cells` coarse centres (k-means on the sample, about the square root of the rows), and a query
is sent to the fewest cells that hold `cover` of the true neighbours among all rows of at most `asked` queries (found by brute force, one scan), and of the
sample's own among themselves: few where rows cluster, nearly all where they do not, or where queries lie elsewhere than rows.
A query whose cells hold no more than k rows goes to further ones until they do. With a `cover` of 1 queries go to all cells, and the result is exact.

Behaviour: vectors null, all zero, or with null, NaN or infinite components take no part, nor do rows of null vec_id. Vectors may be
as long or as short as their type allows. Shorter vectors count as if zeros followed. A query meets all rows but those of its own vec_id. Fewer candidates give fewer rows; rows that share the query's
vec_id may make a query find fewer still. Repeated rows are candidates each; queries of one vec_id share its k ranks.
Equal rows are all scored, so ties go to smaller vec_ids among all rows of the cells. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copse.llm.shared import groups, ints, settle
from copse.llm.vectors import best, binary, block_rows, from_binary, grouped, matrix, usable
from copse.llm.voronoi_knn import crossed, ranked

CENTRES = 16
SIDE = 8  # bytes between a row's codes and its vector: a and p in single precision; a query's least cosine in double


def evened(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that their squares neither overflow nor vanish; cosines keep every bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = evened(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def padded(x: np.ndarray, sub: int) -> np.ndarray:
    """Zeros up to an even number of subspaces, so that two codes fill a byte."""
    more = -x.shape[1] % (2 * sub)
    return np.hstack([x, np.zeros((len(x), more))]) if more else x


def encode(x: np.ndarray, centres: np.ndarray, parallel: float, rounds: int = 3) -> np.ndarray:
    """Codes of unit rows `x` (n, m * sub) for `centres` (m, 16, sub)."""
    m, _, sub = centres.shape
    parts = x.reshape(len(x), m, sub)
    codes = np.empty((len(x), m), dtype=np.uint8)
    along = np.zeros((len(x), m))
    for j in range(m):
        d = ((parts[:, j, None, :] - centres[j][None]) ** 2).sum(2)
        codes[:, j] = d.argmin(1)
        along[:, j] = ((parts[:, j] - centres[j][codes[:, j]]) * parts[:, j]).sum(1)
    total = along.sum(1)
    for _ in range(rounds):
        for j in range(m):
            rest = total - along[:, j]
            r = parts[:, j, None, :] - centres[j][None]
            t = (r * parts[:, j, None, :]).sum(2)
            cost = (r * r).sum(2) + (parallel - 1) * (rest[:, None] + t) ** 2
            codes[:, j] = cost.argmin(1)
            along[:, j] = t[np.arange(len(x)), codes[:, j]]
            total = rest + along[:, j]
    return codes


def fit(x: np.ndarray, sub: int, parallel: float, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Centres (m, 16, sub) for unit rows `x`, by turns of coding and solving one centre's normal equations at a time."""
    m = x.shape[1] // sub
    parts = x.reshape(len(x), m, sub)
    pick = np.random.default_rng(seed).choice(len(x), CENTRES, replace=len(x) < CENTRES)
    centres = parts[pick].transpose(1, 0, 2).copy()
    for _ in range(rounds):
        codes = encode(x, centres, parallel, 1)
        quant = np.stack([centres[j][codes[:, j]] for j in range(m)], axis=1)
        along = ((parts - quant) * parts).sum(2)
        total = along.sum(1)
        for j in range(m):
            rest = total - along[:, j]
            for c in range(CENTRES):
                own = codes[:, j] == c
                if not own.any():
                    continue
                p = parts[own, j]
                left = np.eye(sub) * len(p) + (parallel - 1) * p.T @ p
                right = p.sum(0) + (parallel - 1) * p.T @ (rest[own] + (p * p).sum(1))
                centres[j, c] = np.linalg.solve(left, right)
            along[:, j] = ((parts[:, j] - centres[j][codes[:, j]]) * parts[:, j]).sum(1)
            total = rest + along[:, j]
    return centres


def probes_for(x: np.ndarray, coarse: np.ndarray, k: int, cover: float, asked: int = 512) -> int:
    """How many of its nearest cells a row must look into to find `cover` of its k nearest in the sample `x` of unit rows."""
    q = x[: min(asked, len(x))]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    true = np.argsort(-s, axis=1)[:, : min(k, len(x) - 1)]
    cell = (x @ coarse.T - (coarse * coarse).sum(1) / 2).argmax(1)
    rank = np.argsort(np.argsort(-(q @ coarse.T - (coarse * coarse).sum(1) / 2), axis=1), axis=1)
    return enough(np.take_along_axis(rank, cell[true], axis=1).ravel(), cover)


def enough(place: np.ndarray, cover: float) -> int:
    """How many cells hold `cover` of neighbours that lie in the cells of these places, from 0."""
    place = np.sort(place)
    return int(place[min(len(place) - 1, int(cover * len(place)))]) + 1 if len(place) else 1


def _places(dims: int, kind: type, skip: int, q: np.ndarray, qid: np.ndarray, coarse: np.ndarray, k: int):
    """The k rows nearest to each of a few unit queries, by brute force, with the places of their cells among the query's."""
    rank = np.argsort(np.argsort(-(q @ coarse.T - (coarse * coarse).sum(1) / 2), axis=1, kind="stable"), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, ids, cell = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), dtype=np.int64), np.zeros((len(q), 0), dtype=np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                part = whole.slice(lo, 2048)
                u = unit(_vectors(from_binary(part.column("v"), np.uint8, skip + np.dtype(kind).itemsize * dims), skip, kind))
                s, xid = q @ u.T, part.column("vec_id").to_numpy()
                s[qid[:, None] == xid[None, :]] = -np.inf
                at = best(s, xid, k)
                score = np.hstack([score, np.take_along_axis(s, at, 1)])
                ids, cell = np.hstack([ids, xid[at]]), np.hstack([cell, part.column("grp").to_numpy()[at]])
                at = np.lexsort((ids, -score), axis=1)[:, :k]
                score, ids, cell = (np.take_along_axis(z, at, 1) for z in (score, ids, cell))
        row, at = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays([ints(row), ints(ids[row, at]), pa.array(score[row, at]), ints(rank[row, cell[row, at]])], names=["query", "vec_id", "score", "place"])

    return run


def _coded(dims: int, kind: type, sub: int, centres: np.ndarray, parallel: float, coarse: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x = matrix(part.column("embedding"), dims)
                u = unit(x)
                wide = padded(u, sub)
                codes = encode(wide, centres, parallel)
                cell = (u @ coarse.T - (coarse * coarse).sum(1) / 2).argmax(1)
                stands = centres[np.arange(len(centres)), codes].reshape(wide.shape)
                along = (stands * wide).sum(1)
                side = np.stack([along, np.linalg.norm(stands - along[:, None] * wide, axis=1)], axis=1).astype(np.float32)
                v = _joined(codes[:, ::2] | (codes[:, 1::2] << 4), side, x.astype(kind))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("is_query"), ints(cell), v], names=["vec_id", "is_query", "grp", "v"])

    return run


def _joined(*parts: np.ndarray) -> pa.Array:
    """The bytes of each row's parts, one after another."""
    return binary(np.hstack([np.ascontiguousarray(p).view(np.uint8).reshape(len(p), -1) for p in parts]))


def _vectors(both: np.ndarray, skip: int, kind: type) -> np.ndarray:
    """The original vectors behind the codes and what is beside them, in double precision."""
    return np.ascontiguousarray(both[:, skip:]).view(kind).astype(np.float64)


def _probed(dims: int, kind: type, skip: int, coarse: np.ndarray, held: np.ndarray, probes: int, k: int, some: np.ndarray, some_id: np.ndarray):
    """Each query once for each cell that it looks into; `held` rows are in each cell. Beside its codes: a cosine that the k-th best reaches, as `some` rows do."""
    slack = 2.0**-23 * (dims + 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                part = whole.slice(lo, 1024)
                both = from_binary(part.column("v"), np.uint8, skip + np.dtype(kind).itemsize * dims)
                u = unit(_vectors(both, skip, kind))
                s = u.astype(np.float32) @ some.T
                s[part.column("vec_id").to_numpy()[:, None] == some_id[None, :]] = -1
                floor = np.partition(s, len(some) - k, axis=1)[:, len(some) - k] - slack if len(some) >= k else np.full(len(u), -1.0)
                v = _joined(both[:, : skip - SIDE], floor.astype(np.float64), both[:, skip:])
                order = np.argsort(-(u @ coarse.T - (coarse * coarse).sum(1) / 2), axis=1, kind="stable")
                before = np.cumsum(held[order], axis=1) - held[order]
                row, at = np.nonzero((np.arange(len(coarse)) < probes) | (before <= k))
                cell = order[row, at]
                row, cell = row[held[cell] > 0], cell[held[cell] > 0]
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(ints(row)), part.column("is_query").take(ints(row)), ints(cell), v.take(ints(row))], names=["vec_id", "is_query", "grp", "v"])

    return run


def _search(dims: int, kind: type, sub: int, centres: np.ndarray, k: int, rerank: int):
    m = centres.shape[0]
    skip, slack = m // 2 + SIDE, 2.0**-23 * (m + 16) * (1 + np.sqrt((centres**2).sum(2).max(1).sum()))  # of sums in single precision
    close = 2.0**-50 * (dims + 16)  # cosines of two ways of summing
    step = max(1, min(64, (32 << 20) // (8 * dims * rerank)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, ["grp", "qb", "db"]):
            query = rows.column("is_query").to_numpy(zero_copy_only=False)
            ids = rows.column("vec_id").to_numpy()
            both = from_binary(rows.column("v").combine_chunks(), np.uint8, skip + np.dtype(kind).itemsize * dims)
            x = evened(_vectors(both, skip, kind))
            norms = np.sqrt((x * x).sum(1))
            q, qid, xid = x[query], ids[query], ids[~query]
            data, dn, qn = x[~query], norms[~query], norms[query]
            if not len(q) or not len(data):
                continue
            codes = np.ascontiguousarray(both[~query, : m // 2].T)
            along, aside = np.ascontiguousarray(both[~query, m // 2 : skip]).view(np.float32).T
            floor = np.ascontiguousarray(both[query, m // 2 : skip]).view(np.float64)
            for lo in range(0, len(q), step):
                part, own, pn = q[lo : lo + step], qid[lo : lo + step, None], qn[lo : lo + step, None]
                left = np.ones((len(part), len(data)), dtype=bool)
                if len(data) > rerank:
                    table = np.einsum("jcs,qjs->qjc", centres, padded(unit(part), sub).reshape(len(part), m, sub))
                    pairs = (table[:, 1::2, :, None] + table[:, ::2, None, :]).reshape(len(part), m // 2, 256).astype(np.float32)
                    scan = np.zeros((len(part), len(data)), dtype=np.float32)
                    for j in range(m // 2):
                        scan += pairs[:, j].take(codes[j], axis=1)
                    near = np.argpartition(scan, len(data) - rerank, axis=1)[:, -rerank:]
                    score = (data[near] @ part[:, :, None])[:, :, 0] / (dn[near] * pn)
                    score[xid[near] == own] = -np.inf
                    kth = np.partition(score, rerank - k, axis=1)[:, rerank - k, None] - close
                    least = np.where(np.isfinite(kth), np.maximum(floor[lo : lo + step], kth), -1.0)  # k rows at least, where there are any
                    far = np.sqrt(np.maximum(0.0, 1 - least * least)).astype(np.float32)
                    left = (least <= 0) | (scan >= np.minimum(along, along * least.astype(np.float32)) - far * aside - np.float32(slack))
                    np.put_along_axis(left, near, True, 1)
                some = np.flatnonzero(left.any(0))
                score = part @ data[some].T / (dn[some] * pn)
                score[~left[:, some] | (xid[some] == own)] = -np.inf
                edge = np.partition(score, len(some) - k, axis=1)[:, len(some) - k, None] - close if len(some) > k else -np.inf
                row, at = np.nonzero((score >= edge) & np.isfinite(score))
                at = some[at]
                each = max(1, (8 << 20) // (8 * dims))  # pairs, which are many where rows are equal
                dots = [(data[at[i : i + each]] * part[row[i : i + each]]).sum(1) for i in range(0, len(at), each)]
                score = np.concatenate([*dots, np.zeros(0)]) / (dn[at] * pn[row, 0])
                order = np.lexsort((xid[at], -score, row))
                order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]  # rows ascend already
                yield pa.RecordBatch.from_arrays([ints(own[row[order], 0]), ints(xid[at[order]]), pa.array(score[order])], names=["query_id", "vec_id", "score"])

    return run


def anisotropic_ann(vectors: DataFrame, is_query: Column, k: int = 5, sub: int = 2, parallel: float = 4.0, rerank: int = 128, sample: int = 4096, cells: int = 256, cover: float = 0.99, asked: int = 512, query_block: int | None = None, data_block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest cosines found for every row of `vectors` where `is_query`."""
    spark = vectors.sparkSession
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.where(usable() & F.col("vec_id").isNotNull()).where(some).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("q"))
    dims, n, asking = rows.agg(F.max(F.size("embedding")), F.count("*"), F.count_if("q")).first()
    if not dims or not asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64  # as exact as they came
    query_block, data_block = query_block or block_rows(asking, dims), data_block or block_rows(n, dims)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "embedding").toArrow()
    x = unit(matrix(chosen.column("embedding"), dims))
    centres = fit(padded(x, sub), sub, parallel)
    coarse = grouped(x, max(1, min(cells, math.isqrt(n) // 4, len(x) // 16)))[0]
    coded = settle(rows.withColumnRenamed("q", "is_query").mapInArrow(_coded(dims, kind, sub, centres, parallel, coarse), "vec_id long, is_query boolean, grp long, v binary"), "codes")
    held = np.zeros(len(coarse), dtype=np.int64)
    for grp, rows_ in coded.groupBy("grp").count().collect():
        held[grp] = rows_
    skip = centres.shape[0] // 2 + SIDE
    few = rows.where("q").orderBy(F.xxhash64("vec_id"), "vec_id").limit(asked).select("vec_id", "embedding").toArrow()
    near = coded.mapInArrow(_places(dims, kind, skip, unit(matrix(few.column("embedding"), dims)), few.column("vec_id").to_numpy(), coarse, k), "query long, vec_id long, score double, place long")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k)
    probes = max(probes_for(x, coarse, k, cover), enough(np.array([r.place for r in near.select("place").collect()], dtype=np.int64), cover)) if cover < 1 else len(coarse)
    most = max(256, (8 << 20) // (4 * dims))
    probed = _probed(dims, kind, skip, coarse, held, probes, k, x[:most].astype(np.float32), chosen.column("vec_id").to_numpy()[:most])
    sent = settle(coded.where("is_query").mapInArrow(probed, "vec_id long, is_query boolean, grp long, v binary"), "sent")
    nd = F.element_at(F.array(*(F.lit(max(1, -(-int(h) // data_block))).cast("long") for h in held)), (F.col("grp") + 1).cast("int"))
    sizes = sent.groupBy("grp").agg(F.ceil(F.count("*") / query_block).alias("nq")).withColumn("nd", nd)
    sizes = F.broadcast(settle(sizes, "blocks"))  # a row a cell
    salt = F.xxhash64("vec_id", F.monotonically_increasing_id())
    q = sent.withColumn("salt", salt).join(sizes, "grp").withColumn("qb", F.pmod("salt", "nq"))
    x = coded.withColumn("is_query", F.lit(False)).withColumn("salt", salt).join(sizes, "grp").withColumn("db", F.pmod("salt", "nd"))
    found = crossed(q, x).mapInArrow(_search(dims, kind, sub, centres, k, max(k, rerank)), "query_id long, vec_id long, score double")
    return ranked(found, k)
