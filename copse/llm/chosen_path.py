"""N-gram Jaccard join by chosen paths.

Every text is the set of its windows of `n` words. Sets are first put into classes of equal sets, and each class is embedded
as `COORDS` min-hashes, tokens that two sets share with a probability equal to their Jaccard similarity. Each run splits the
classes recursively: the path so far picks a coordinate, and classes that agree on it go the same way; a bucket is split
while it holds more than `bucket` classes, down to `depth` levels. Buckets are then searched by brute force on the min-hashes
(a bucket that stays larger, as a large group of near copies does, in pairs of blocks). Runs are repeated until a pair at the
threshold that is split at every level would be met, and pass the search, with probability `recall`. All runs share the min-hashes,
so that probability is summed over the number of coordinates that the pair may agree in.

What the buckets find only ties classes into candidate groups, kept as one edge a class to the group's head. In each group,
again in pairs of blocks, all sets are then compared exactly (integers; intersections as products of 0/1 matrices over the
windows that two or more of the block's sets hold), so no link within a group is lost and no pair is ever a row.

Behaviour: null and empty texts have no windows, hence no link, and are classes of their own. A text of fewer than `n` words is
one window, the whole text. Copies count as links. Repeated rows are copies of each other; doc_id may be null or repeated: rows
are told apart by doc_id and text together. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.llm.components import components
from copse.llm.shared import drop, groups, ints, over_texts, settle
from copse.llm.substring_dedup import KEY, _few, _own, _unpacked, keyed, pack
from copse.llm.words import Words, mix, slices

COORDS = 64
_U = np.uint64
_RNG = np.random.default_rng(20260101)
_MUL = _RNG.integers(0, 1 << 32, COORDS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, COORDS, dtype=np.uint64).astype(np.uint32)
SIGNED = "doc_id long, unknown boolean, th long, n_set long, k1 long, k2 long, sig binary"


def window_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of each text, sorted by text and value, and the bounds of each text's stretch."""
    h = words.hashes(0)
    w, valid = words.windows(h, n)
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    values = np.concatenate([w[valid], words.whole(h)[short]])
    owner = np.concatenate([text[valid], short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(words.counts) + 1))


def _signed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in slices(batch.column("text")):
                values, bounds = window_sets(words, n)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                sigs = np.zeros((hi - lo, COORDS), dtype=np.uint32)
                k = np.zeros((2, hi - lo), dtype=_U)
                if len(full):
                    at = bounds[:-1][full]
                    folded = (values ^ (values >> _U(32))).astype(np.uint32)
                    for c in range(COORDS):
                        x = folded * _MUL[c] + _ADD[c]
                        x ^= x >> np.uint32(15)
                        x *= np.uint32(0x2C1B3C6D)
                        sigs[full, c] = np.minimum.reduceat(x, at)
                    k[0, full] = np.add.reduceat(mix(values), at)
                    k[1, full] = np.bitwise_xor.reduceat(mix(values + _U(77)), at)
                rows = sigs.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*_own(batch, lo, hi), ints(sizes), ints(k[0].view(np.int64)), ints(k[1].view(np.int64)), pa.array([rows[i : i + 4 * COORDS] for i in range(0, len(rows), 4 * COORDS)], type=pa.binary())],
                    names=[*KEY, "n_set", "k1", "k2", "sig"],
                )

    return run


def agreeing(least: float) -> int:
    """Coordinates that two min-hashes must agree in to be tied: so few that about 4 in a million pairs at 0.8 fall short."""
    return math.ceil(max(0.0, least - 0.25) * COORDS)


def met(least: float, depth: int, runs: int) -> float:
    """The probability that a pair of that similarity, split at every level of every run, meets in a run and is tied."""
    share = [math.comb(COORDS, m) * least**m * (1 - least) ** (COORDS - m) for m in range(COORDS + 1)]
    return sum(share[m] * (1 - (1 - (m / COORDS) ** depth) ** runs) for m in range(agreeing(least), COORDS + 1))


def runs_for(least: float, depth: int, recall: float, most: int = 4096) -> int:
    """The fewest runs with which such a pair is met with probability `recall`."""
    if met(least, depth, most) < recall:
        raise ValueError(f"no number of runs up to {most} meets pairs at {least} with probability {recall}")
    lo, hi = 1, most
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if met(least, depth, mid) >= recall else (mid + 1, hi)
    return lo


def _paths(runs: int, depth: int):
    """For each class and run, the path's hash at every level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(n, COORDS).astype(_U)
            row = np.arange(n)
            for r in range(runs):
                path = np.full(n, mix(np.array([r + 1], dtype=_U))[0], dtype=_U)
                levels = []
                for level in range(depth):
                    pick = (mix(path + _U(level + 1)) % _U(COORDS)).astype(np.int64)
                    path = mix(path ^ mix(sig[row, pick] * _U(COORDS) + pick.astype(_U) + _U(1)))
                    levels.append(ints(path.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), *levels], names=["id", *(f"p{d}" for d in range(depth))])

    return run


def _block_pairs(df: DataFrame, nb: str) -> DataFrame:
    """`df` with each row once for every pair of its `nb` blocks (bi <= bj) that its own block `b` is in."""
    df = df.withColumn("b", F.pmod(F.xxhash64("id"), F.col(nb)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col(nb).cast("int") - 1))
    return df.withColumn("o", other).withColumn("bi", F.least("b", "o")).withColumn("bj", F.greatest("b", "o")).drop("o", nb)


def _heads(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the smallest index that each row's links reach."""
    n = len(linked)
    head = np.arange(n)
    while True:
        low = head.copy()
        for i in range(0, n, 256):
            low[i : i + 256] = np.minimum(low[i : i + 256], np.where(linked[i : i + 256], head[None, :], n).min(axis=1))
        low = np.minimum(low, low[low])
        if (low == head).all():
            return head
        head = low


def _similar(least: float):
    """Star edges between the classes of a bucket whose min-hashes agree in enough coordinates for that similarity."""
    need = agreeing(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, rows in groups(batches, ["bucket", "bi", "bj"]):
            if rows.num_rows < 2:
                continue
            ids = rows.column("id").to_numpy()
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=np.uint32).reshape(len(ids), COORDS)
            linked = np.zeros((len(ids), len(ids)), dtype=bool)
            for i in range(len(ids) - 1):
                linked[i, i + 1 :] = (sig[i + 1 :] == sig[i]).sum(axis=1) >= need
            head = _heads(linked | linked.T)
            tied = np.flatnonzero(head != np.arange(len(ids)))
            a.append(ids[tied])
            b.append(ids[head[tied]])
            if len(a) >= 4096:
                yield pa.RecordBatch.from_arrays([ints(np.concatenate(a)), ints(np.concatenate(b))], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([ints(np.concatenate(a)), ints(np.concatenate(b))], names=["a", "b"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            for lo, hi, words in slices(_unpacked(batch.column("packed"))):
                values, bounds = window_sets(words, n)
                lists = pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), ints(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("id", "component", "w", "nb")), lists], names=["id", "component", "w", "nb", "set"])

    return run


def intersections(values: np.ndarray, owner: np.ndarray, n: int, columns: int = 4096) -> np.ndarray:
    """Sizes of the pairwise intersections of n sets; only values in two or more sets matter, a bounded number of them at a time."""
    order = np.argsort(values, kind="stable")
    v, o = values[order], owner[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = v[1:] != v[:-1]
    which = np.cumsum(new) - 1
    many = np.bincount(which) >= 2 if len(v) else np.zeros(0, dtype=bool)
    at = np.cumsum(many) - 1
    pick = many[which]
    col, row = at[which[pick]], o[pick]
    out = np.zeros((n, n), dtype=np.float64)
    for lo in range(0, int(many.sum()), columns):
        part = (col >= lo) & (col < lo + columns)
        grid = np.zeros((n, min(columns, int(many.sum()) - lo)), dtype=np.float32)
        grid[row[part], col[part] - lo] = 1
        out += grid @ grid.T
    return out.astype(np.int64)


def _exact(num: int, den: int):
    """Per class, the weight of its links in this pair of blocks, and star edges of the links; threshold num / den."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, bi, bj), rows in groups(batches, ["component", "bi", "bj"]):
            ids, w, b = (rows.column(c).to_numpy() for c in ("id", "w", "b"))
            lists = rows.column("set").combine_chunks()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            both = intersections(lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), sizes), len(ids))
            linked = (num + den) * both >= num * (sizes[:, None] + sizes[None, :])
            np.fill_diagonal(linked, False)
            if bi != bj:
                linked &= b[:, None] != b[None, :]
            head = _heads(linked)
            yield pa.RecordBatch.from_arrays([ints(ids), ints(linked @ w), ints(ids[head])], names=["id", "links", "head"])

    return run


def _buckets(reps: DataFrame, runs: int, depth: int, bucket: int, block: int) -> DataFrame:
    """(id, bucket, nb): each class in its bucket of every run, nb the blocks that the bucket is searched in.

    The first level's sizes leave only paths that classes share; the deeper levels' sizes are counted together, of what is still large.
    Rows join sizes that are plain tables, so that Spark splits a path with many rows.
    """
    paths = settle(reps.mapInArrow(_paths(runs, depth), "id long, " + ", ".join(f"p{d} long" for d in range(depth))), "paths")
    sizes = settle(paths.groupBy("p0").agg(F.count("*").alias("size")).where("size >= 2"), "sizes")
    met = settle(paths.join(sizes, "p0").withColumnRenamed("p0", "bucket"), "met")
    drop(paths, sizes)
    levels = [f"p{d}" for d in range(1, depth)]
    alike = met.where(F.col("size") > bucket if levels else F.lit(False)).groupBy(*levels).agg(F.count("*").alias("n"))  # whole paths first: near copies share them
    deeper = alike.select("n", F.explode(F.array(*(levels or [F.lit(0).cast("long")]))).alias("bucket"))
    sizes = settle(deeper.groupBy("bucket").agg(F.sum("n").alias("size")).where("size >= 2"), "sizes")
    found = met.where(F.col("size") <= bucket) if depth > 1 else met
    large = met.where(F.col("size") > bucket)
    for d in range(1, depth):
        large = large.drop("bucket", "size").withColumnRenamed(f"p{d}", "bucket").join(sizes, "bucket")
        if d < depth - 1:
            found = found.select("id", "bucket", "size").unionByName(large.where(F.col("size") <= bucket).select("id", "bucket", "size"))
            large = large.where(F.col("size") > bucket)
        else:
            found = found.select("id", "bucket", "size").unionByName(large.select("id", "bucket", "size"))
    found = settle(found.select("id", "bucket", F.ceil(F.col("size") / block).alias("nb")), "buckets")
    drop(met, sizes)
    return found


def chosen_path_join(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, recall: float = 0.9999, bucket: int = 256, depth: int = 4, block: int = 1024, block_values: int = 2_000_000) -> DataFrame:
    """(doc_id, th, component, class_id, n_links, n_copies): one row for each row of `docs`(doc_id, text).

    Links join texts whose sets have a Jaccard similarity of num / den or more. class_id: the smallest doc_id among the
    documents that a path of links reaches. component: a number of those documents together, whatever their doc_ids;
    rows without windows have one for each doc_id and text. th: the text's hash. n_links: the other documents linked directly. n_copies: the documents of equal set.
    """
    least = num / den
    runs = runs_for(least, depth, recall)
    signed = settle(over_texts(keyed(docs), _signed(n), SIGNED), "signatures")
    classes = signed.where("n_set > 0").groupBy("k1", "k2", "n_set").agg(F.min(F.struct(*KEY)).alias("rep"), F.count("*").alias("w"), F.min(F.when(~F.col("unknown"), F.col("doc_id"))).alias("low"), F.first("sig").alias("sig"))
    classes = settle(classes.select("k1", "k2", "n_set", "rep.*", "w", "low", F.xxhash64("k1", "k2", "n_set").alias("id"), "sig"), "classes")
    reps = classes.select("id", "sig")
    found = _buckets(reps, runs, depth, bucket, block)
    pairs = _block_pairs(found, "nb").drop("b").join(reps, "id").repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    near = components(pairs.mapInArrow(_similar(least), "a long, b long"))
    drop(found)
    held = settle(classes.select(*KEY, "id", "w", "n_set").join(near, "id"), "members")
    drop(near)
    blocks = settle(held.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n_set") / block_values)).alias("nb")), "blocks")
    held = held.drop("n_set").join(blocks, "component")
    sets = over_texts(pack(docs).join(held, KEY).dropDuplicates(KEY), _sets(n), "id long, component long, w long, nb long, set array<long>")
    tiles = _block_pairs(sets, "nb").repartition("component", "bi", "bj").sortWithinPartitions("component", "bi", "bj")
    exact = settle(tiles.mapInArrow(_exact(num, den), "id long, links long, head long"), "links")
    drop(blocks)
    links = exact.groupBy("id").agg(F.sum("links").alias("links"))
    tied = components(exact.where("id != head").select(F.col("id").alias("a"), F.col("head").alias("b")))
    whole = classes.join(links, "id", "left").join(tied, "id", "left").select("k1", "k2", "n_set", "low", "w", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    whole = settle(whole, "whole")
    drop(classes, exact, tied)
    named = settle(whole.groupBy("component").agg(F.min("low").alias("class_id")), "named")  # both sides of the join are plain tables: Spark splits a skewed one
    whole = whole.join(named, "component").select("component", "k1", "k2", "n_set", "class_id", (F.col("links") + F.col("w") - 1).alias("n_links"), F.col("w").alias("n_copies"))
    out = signed.select(*KEY, "k1", "k2", "n_set").join(whole, ["k1", "k2", "n_set"], "left")
    own = F.when(~F.col("unknown"), F.col("doc_id"))
    return out.select(own.alias("doc_id"), "th", F.coalesce("component", F.xxhash64(*KEY)).alias("component"), F.when(F.col("n_set") > 0, F.col("class_id")).otherwise(own).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))
