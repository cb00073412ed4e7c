import math
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pytest

from copse.llm import source_mixing, toxicity_fm
from copse.llm.queries import ORACLES, QUERIES
from copse.llm.terms import Terms
from tests.llm import test_chosen_path, test_substring_dedup

SF = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    want = con.execute("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({ORACLES[name]})").fetchall()
    assert Counter(map(tuple, df.select(*cols).collect())) == Counter(want)


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_fingerprint_index(spark):
    got = QUERIES["op2_fingerprint_index"](spark, str(SF))
    assert test_substring_dedup.rows_of(got) == test_substring_dedup.brute(documents(spark), 35)


def test_chosen_path_join(spark):
    got = QUERIES["op8_chosen_path_join"](spark, str(SF))
    assert test_chosen_path.rows_of(got) == test_chosen_path.brute(documents(spark))


@pytest.mark.parametrize(("name", "table"), [("op3_factorization_machine", "documents"), ("op6_soft_membership_mixing", "documents"), ("op7_rank_queue_bpe", "documents")])
def test_a_row_for_each_row(spark, name, table):
    assert QUERIES[name](spark, str(SF)).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def dense_rates(n, p, targets):
    """The rates >= 0 nearest to 1 that meet the targets, by turns of solving the dense optimality system and clamping rates at 0."""
    weight = n / n.sum()
    free = np.ones(len(n), dtype=bool)
    for _ in range(200):
        a = (p * weight[:, None])[free]
        m = np.linalg.lstsq(a.T @ p[free], targets - a.sum(0), rcond=None)[0]
        now = 1 + p @ m > 0
        if (now == free).all():
            return np.maximum(0.0, 1 + p @ m)
        free = now
    raise AssertionError("no active set found")


def test_rates_of_the_query_are_the_least_squares(spark):
    rows = QUERIES["op6_soft_membership_mixing"](spark, str(SF)).toPandas()
    p = rows[[f"p_{d}" for d in source_mixing.DOMAINS]].to_numpy()
    want = dense_rates(rows["tokens"].to_numpy().astype(float), p, np.array(source_mixing.TARGETS))
    assert np.abs(rows["rate"].to_numpy() - want).max() < 1e-2 * max(1.0, want.max())
    assert np.abs((rows["tokens"] * rows["rate"]).to_numpy() @ p / rows["tokens"].sum() - source_mixing.TARGETS).max() < 2e-4


def test_labels_that_repeat_or_say_nothing(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, None), (3, None, 1), (4, 0, None), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted(((r.doc_id, r.domain) for r in source_mixing.domain_labels(labels).collect()), key=repr)
    assert got == sorted([(1, "high"), (1, "toxic"), (2, None), (3, "toxic"), (4, "low"), (5, None), (None, "high")], key=repr)


def test_scores_of_the_query_are_sums_over_pairs(spark):
    """Every document's score from the fitted machine, term by term and pair by pair."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity_fm.train(docs.select("doc_id", "text"), labels)
    terms = Terms(machine.vocabulary)
    got = {r.doc_id: r for r in QUERIES["op3_factorization_machine"](spark, str(SF)).collect()}
    for r in docs.select("doc_id", "text").collect():
        t = terms(r.text)[0]
        z = machine.bias + sum(machine.linear[i] for i in t) + sum(float(machine.factors[a] @ machine.factors[b]) for a, b in combinations(t, 2))
        assert abs(got[r.doc_id].score - 1 / (1 + math.exp(-z))) < 1e-6
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
