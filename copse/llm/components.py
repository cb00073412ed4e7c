"""Connected components of an edge table: forests within tasks, dealt anew until they are stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.llm.shared import drop, ints, settle

#: A node's links are dealt over so many tasks, each of which learns the node's own smaller neighbours.
SPREAD = 8
#: A task's forest goes out once it has so many edges, so that a task holds no more than that and one batch.
HELD = 1 << 21
#: What an edge is dealt for: to be kept (once a round), to tell a node's other tasks its smaller neighbours, to hang on what its smaller end hangs on.
OWN, LEARNED, HUNG = 0, 1, 2


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node of the edges but the roots; a root is the smallest id that edges reach."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = np.arange(len(ids))
    x, y = at[: len(a)], at[len(a) :]
    while len(x):
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while True:
            top = up[up]
            if (top == up).all():
                break
            up = top
        x, y = up[x], up[y]
        x, y = x[x != y], y[x != y]
    hung = np.flatnonzero(up != np.arange(len(ids)))
    return ids[hung], ids[up[hung]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges' forest. Where edges say what they are for, `learned` ones shape it but only ids of other edges are sent, of `hung` edges the larger end alone."""
    a = b = told = np.zeros(0, dtype=np.int64)
    for batch in batches:
        x, y = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        use = batch.column("use").to_numpy() if "use" in batch.schema.names else np.full(len(x), OWN)
        told = np.unique(np.concatenate([told, x[use != LEARNED], y[use == OWN]]))
        a, b = forest(np.concatenate([a, x]), np.concatenate([b, y]))
        if len(a) >= HELD:
            yield _sent(a, b, told)
            a = b = told = np.zeros(0, dtype=np.int64)
    yield _sent(a, b, told)


def _sent(a: np.ndarray, b: np.ndarray, told: np.ndarray) -> pa.RecordBatch:
    keep = np.isin(a, told)
    return pa.RecordBatch.from_arrays([ints(a[keep]), ints(b[keep])], names=["a", "b"])


def _stars(edges: DataFrame) -> bool:
    """Whether no id hangs on two others, or on one that hangs itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(False).alias("top")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(True).alias("top")))).alias("e")).select("e.*")
    seen = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("top").alias("top"))
    return seen.where("up > 1 or (up = 1 and top)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in `edges`(a, b): component is the smallest id that a path of edges reaches.

    A task turns the edges that it gets into a forest of stars, so it sends a node at most once; then every node's edges go to its own task, which
    leaves about one edge a node. Each round deals every edge
    to both of its ends (to the smaller end's tasks by a salt, so a hub's links are spread; to all salts of the larger end,
    which thus hangs what hangs on it on its own smaller neighbours), then every node to its own task. Rounds end when the edges
    are stars, after about log(nodes) of them; the driver sees one boolean a round.
    Null ends and loops are ignored; no edges give no rows.
    """
    first = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(_forests, "a long, b long")
    now = settle(first.repartition("a").mapInArrow(_forests, "a long, b long"), "edges")
    while not _stars(now):
        old = now
        up = [F.struct(F.col("a").alias("key"), F.lit(s).cast("long").alias("salt"), F.lit(LEARNED if s else OWN).cast("long").alias("use")) for s in range(SPREAD)]
        down = F.struct(F.col("b").alias("key"), F.pmod(F.xxhash64("a"), F.lit(SPREAD)).alias("salt"), F.lit(HUNG).cast("long").alias("use"))
        ends = now.select("a", "b", F.explode(F.array(*up, down)).alias("to")).select("a", "b", "to.*")
        met = ends.repartition("key", "salt").select("a", "b", "use").mapInArrow(_forests, "a long, b long")
        now = settle(met.repartition("a").mapInArrow(_forests, "a long, b long"), "edges")
        drop(old)
    root = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = root.unionByName(root.select(F.col("component").alias("id"), "component").distinct())
    out.settled_at = now.settled_at
    return out
