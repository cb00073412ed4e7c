"""A store of graphs that a stream of documents fills, a batch at a time.

Every document's graph is made of the document alone, so a batch of documents gives the rows that one job over all of them would. A batch's tables are written to a
folder of its number and the batch is then marked; a batch that is marked already is left out, and one that was broken off before its mark is written anew. So a
batch that the stream sends again, after a failure, is there once. Readers see marked batches alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from copse.operators.graphs import Graph


class GraphStore:
    """Graphs under `path`, in a store that Spark reads; `schemas`: those of the tables of the graphs that come."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.files = where.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def has(self, batch: int) -> bool:
        return self.files.exists(self._at("done", str(batch)))

    def batches(self) -> list[int]:
        """The marked batches: a list of small numbers, one a batch."""
        if not self.files.exists(self._at("done")):
            return []
        return sorted(int(f.getPath().getName()) for f in self.files.listStatus(self._at("done")))

    def append(self, batch: int, graph: Graph) -> bool:
        """Writes a batch's graph and marks it; False if it is there already."""
        if self.has(batch):
            return False
        for name in ("nodes", "edges", "attrs"):
            getattr(graph, name).write.mode("overwrite").parquet(f"{self.path}/{batch}/{name}")
        self.files.create(self._at("done", str(batch)), True).close()
        return True

    def graph(self) -> Graph:
        """All marked batches as one graph."""
        done = self.batches()
        if not done:
            raise ValueError("no batch has been written")
        return Graph(*(self.spark.read.parquet(*(f"{self.path}/{b}/{name}" for b in done)) for name in ("nodes", "edges", "attrs")))


def filled(documents: DataFrame, rule: Callable[[DataFrame], Graph], store: GraphStore, checkpoint: str, available: bool = True) -> None:
    """Streams `documents` into `store`: `rule` makes a batch's graph of the batch's rows.

    With `available`, all that is there now, in as many batches as the source gives, else until the query is stopped. `checkpoint`: the stream's own folder, in a
    place that driver and executors share.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.append(number, rule(batch))

    stream = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    (stream.trigger(availableNow=True) if available else stream).start().awaitTermination()
