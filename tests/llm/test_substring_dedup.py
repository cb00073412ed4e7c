import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from copse.llm.substring_dedup import FingerprintIndex, _few, remove_repeats, substring_dedup
from copse.llm.words import runs_of, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def test_random_texts_with_edges(spark):
    rng = random.Random(3)
    words = ["a", "b", "ab", "ü", "漢字", "c,", "Abc"]
    passage = " ".join(rng.choice(words) for _ in range(12))
    rows = [(i, rng.choice([" ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(100 + i, f"x{i} y{i}\t{passage} z{i}") for i in range(5)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (None, "one two three"), (None, passage), (203, passage), (203, passage), (203, "other words here"), (204, "a " * 3000)]
    rows += [(205, "p q r s t u v w"), (206, "p q r s t u v w")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, th int, copied string")
    assert rows_of(substring_dedup(docs, width=6, piece=3)) == brute(rows, 6)


def test_production_width(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, just, short = fresh(60), fresh(35), fresh(34)
    rows = [(i, " ".join(fresh(20) + part + fresh(20))) for i, part in enumerate([passage, passage, just, just, short, short, fresh(50)])]
    rows += [(10, " ".join(fresh(10))), (11, " ".join(passage[:50]))]
    got = rows_of(substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows, 35)
    assert {r[0]: r[2] for r in got}[0] == 60 and {r[0]: r[2] for r in got}[4] == 0


def test_batches_equal_one_load(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(30))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = FingerprintIndex(spark, width=8, piece=4, ratio=1)
    for b in range(3):
        index.append(docs.where(f"doc_id % 3 = {b}"))
    assert len(index.runs) == 3 and index.candidates().count() > 0
    want = {r.fp for r in index.documents().selectExpr("explode(fps) AS fp").groupBy("fp").count().where("count > 1").collect()}
    assert {r.fp for r in index.candidates().collect()} == want
    assert rows_of(remove_repeats(docs, index)) == brute(rows, 8)
    index.ratio = 100
    index.compact()
    ((run, _),) = index.runs
    merged = {r.fp: r.n for r in spark.table(run).collect()}
    assert {fp for fp, n in merged.items() if n > 1} == want
    assert rows_of(remove_repeats(docs, index)) == brute(rows, 8)
    index.remove()


def test_runs_meet_without_a_shuffle(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{i // 2}x{j}" for j in range(40))) for i in range(8)], "doc_id long, text string")
    index = FingerprintIndex(spark, width=8, piece=4, ratio=1)
    for b in range(2):
        index.append(docs.where(f"doc_id % 2 = {b}"))
    plan = index.hits()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert index.hits().count() == index.candidates().count() > 0
    index.remove()


def test_packed_texts_are_cut_by_unpacked_size():
    packed = [zstandard.compress(b"a" * n) for n in (3_000_000, 3_000_000, 10, 9_000_000, 10, 10)]
    batch = pa.RecordBatch.from_arrays([pa.array(packed)], names=["packed"])
    assert [b.num_rows for b in _few([batch])] == [1, 2, 1, 2]


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_are_cut_and_hashed_alike():
    texts = ["one two", "  two\tone ", None, "", "one\x0btwo"]
    (lo, hi, words), *rest = slices(pa.array(texts))
    assert (lo, hi, rest) == (0, 5, []) and words.counts.tolist() == [2, 2, 0, 0, 2]
    h = words.hashes()
    assert h[0] == h[3] == h[4] and h[1] == h[2] == h[5] and h[0] != h[1]
    for k in range(1, 40):
        got = runs_of(np.tile(np.arange(50, dtype=np.uint64), 2), k)
        assert len(got) == 101 - k and got[0] == got[50] and len(set(got.tolist())) == 50
    assert len(runs_of(np.zeros(3, dtype=np.uint64), 4)) == 0


def test_very_long_words_are_hashed_in_stretches(monkeypatch):
    texts = ["ab" * 100 + "c", "ab" * 100 + "d", "x " + "ab" * 100 + "c"]
    whole = [w.hashes() for _, _, w in slices(pa.array(texts))][0]
    monkeypatch.setattr("copse.llm.words.SLICE", 16)
    parts = np.concatenate([w.hashes() for _, _, w in slices(pa.array(texts))])
    assert (parts == whole).all() and len(set(parts.tolist())) == 3


def symbols(n, of, turned=False):
    """A sequence that sums of powers cannot tell from its turned one, whatever the base."""
    return [of[(bin(i).count("1") + turned) % 2] for i in range(n)]


@pytest.mark.parametrize("n", [1024, 4096])
def test_balanced_sequences_differ(spark, n):
    words = ["".join(symbols(n, "ab", t)) for t in (False, True)]
    rng = random.Random(1)
    start = [f"w{rng.randrange(10**9)}" for _ in range(34)]
    rows = [(i, " ".join([*start, w])) for i, w in enumerate(words)]
    rows += [(10 + t, " ".join(symbols(n, ["x", "y"], t))) for t in (False, True)] + [(-(1 << 63), "one"), ((1 << 63) - 1, "two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(substring_dedup(docs))
    assert got == brute(rows, 35) and [r[2] for r in got if r[0] in (0, 1)] == [0, 0]
