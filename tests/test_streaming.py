from pyspark.sql import functions as F

from copse.catalogue import _talk
from copse.operators.graphs import Graph
from copse.streaming.store import GraphStore, filled


def turns(spark, first, last):
    return spark.createDataFrame([(i, t, ["user", "assistant"][t % 2], f"{i} {t}") for i in range(first, last) for t in range(i % 4 + 1)], "conv_id long, turn long, role string, text string")


def rows(graph):
    return [sorted(map(tuple, t.collect()), key=repr) for t in (graph.nodes, graph.edges, graph.attrs)]


def test_a_stream_gives_what_one_job_gives(spark, tmp_path):
    for i in range(3):
        turns(spark, 10 * i, 10 * i + 10).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    store = GraphStore(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(turns(spark, 0, 1).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    filled(stream, _talk, store, str(tmp_path / "checkpoint"))
    assert store.batches() == [0, 1, 2] and rows(store.graph()) == rows(_talk(turns(spark, 0, 30)))
    turns(spark, 30, 40).coalesce(1).write.parquet(str(tmp_path / "in/3"))
    filled(stream, _talk, store, str(tmp_path / "checkpoint"))  # goes on where it stopped
    assert store.batches() == [0, 1, 2, 3] and rows(store.graph()) == rows(_talk(turns(spark, 0, 40)))


def test_batches_sent_again_or_broken_off(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    graph = _talk(turns(spark, 0, 5))
    assert store.append(7, graph) and not store.append(7, _talk(turns(spark, 0, 9)))
    graph.nodes.write.parquet(f"{tmp_path}/8/nodes")  # broken off: no mark
    assert store.batches() == [7] and rows(store.graph()) == rows(graph)
    assert store.append(8, _talk(turns(spark, 5, 7))) and rows(store.graph()) == rows(_talk(turns(spark, 0, 7)))
    other = Graph(*(t.where(F.col("doc_id") < 0) for t in (graph.nodes, graph.edges, graph.attrs)))
    assert store.append(9, other) and store.batches() == [7, 8, 9]
