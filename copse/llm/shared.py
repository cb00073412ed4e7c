"""Where intermediate tables go, and how sorted Arrow batches are cut into groups."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_INSIDE: ContextVar[str] = ContextVar("scratch", default="")
BATCH_BYTES, TEXT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, `spark.checkpoint.dir`.

    Where that is unset, a local session (tests) gets a temporary folder, deleted when it ends; on a cluster it is an error, as executors
    would write to their own disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='copse-')}"
        spark.conf.set("spark.checkpoint.dir", path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return f"{path.rstrip('/')}/copse/{spark.sparkContext.applicationId}{_INSIDE.get()}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of Spark's file systems; none there is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; results that have not been written by then are lost."""
    remove(spark, shared_dir(spark))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside go to a folder of their own, which is deleted at the end: results are to be written by then."""
    before = _INSIDE.set(f"{_INSIDE.get()}/{uuid.uuid4().hex}")
    try:
        yield
    finally:
        remove(spark, shared_dir(spark))
        _INSIDE.reset(before)


def settle(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: cuts lineage, survives lost executors.

    What no later table or result reads is dropped by the operator that wrote it; the tables that a lazy result reads stay
    until the end of a `scratch` around it, or `clear`.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.settled_at)


def over_texts(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`df.mapInArrow`, with the session's Arrow batches set to `TEXT_BYTES`, so that few texts are in a task's memory at once."""
    df.sparkSession.conf.set(BATCH_BYTES, str(TEXT_BYTES))
    return df.mapInArrow(function, schema)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal integer `keys` from batches sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []
    held_key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], batch.num_rows)
        for s, e in zip(starts, ends, strict=True):
            key = tuple(int(c[s]) for c in cols)
            if key != held_key and held:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(s, e - s))
    if held:
        yield held_key, pa.Table.from_batches(held)


def ints(values, kind=np.int64) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, dtype=kind))
