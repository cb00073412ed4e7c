"""Where intermediate tables go and when they go away."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from copse.llm import shared
from copse.llm.chosen_path import chosen_path_join
from copse.llm.substring_dedup import substring_dedup


def test_scratch_is_gone_afterwards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"one two three four five six {i // 2}") for i in range(6)], "doc_id long, text string")
    top = Path(shared.shared_dir(spark).removeprefix("file://"))
    before = set(top.glob("*")) if top.exists() else set()
    with shared.scratch(spark):
        chosen_path_join(docs).write.parquet(str(tmp_path / "a"))
        with shared.scratch(spark):
            substring_dedup(docs, width=5, piece=2).write.parquet(str(tmp_path / "b"))
        assert set(top.glob("*")) - before
    assert set(top.glob("*")) == before
    assert spark.read.parquet(str(tmp_path / "a")).count() == spark.read.parquet(str(tmp_path / "b")).count() == 6
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("copse_run_")]


def test_settled_tables_are_dropped(spark):
    table = shared.settle(spark.range(3), "t")
    path = Path(table.settled_at.removeprefix("file://"))
    assert path.exists() and table.agg(F.sum("id")).first()[0] == 3
    shared.drop(table)
    assert not path.exists()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://there", "x"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
