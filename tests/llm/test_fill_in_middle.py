import hashlib
import random
import re

import numpy as np
import pytest

from copse.llm.fill_in_middle import Chunks, fill_in_middle, restored

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text, seed=1, fim=90, spm=20):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return doc_id, len(units), "plain", None, None, text, text
    lo, hi = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(units), form, len(prefix), len(middle), out, text


def texts():
    rng = random.Random(11)
    pieces = ["ab", "Z", " ", "\n", "é", "漢", "😀", "<", "P>", "1", ".", "x" * 40]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(200)] + ["", "a", "abc def", "é", "<P", "a<S>b", "<M>", "\n\n", "q" * 50_000, "a1" * 40_000, "漢字 " * 20_000]


def test_forms_and_restoring(spark):
    rows = list(enumerate(texts())) + [(None, "one two"), (7, "again"), (7, "again"), (8, None), (1 << 62, "far")]
    docs = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, form string, n int")
    got = fill_in_middle(docs)
    got = got.withColumn("restored", restored(got.output, got.form)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute(d, t) for d, t in rows), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize(("chunk", "stretch"), [(1, 1), (3, 7), (5, 1000), (1 << 14, 1 << 20)])
def test_every_rank_in_chunks_of_any_size(chunk, stretch):
    some = [t.encode() for t in texts()[:60] + ["", "ab cd", ""]]
    offsets = np.append(0, np.cumsum([len(t) for t in some])).astype(np.int64)
    chunks = Chunks(np.frombuffer(b"".join(some), dtype=np.uint8), offsets, chunk, stretch)
    units = [UNIT.findall(t.decode()) for t in some]
    assert chunks.counts.tolist() == [len(u) for u in units]
    asked = [(i, r) for i, u in enumerate(units) for r in range(len(u) + 1)]
    random.Random(1).shuffle(asked)
    got = chunks.places(*np.array(asked).T) - offsets[:-1][[i for i, _ in asked]]
    assert got.tolist() == [len("".join(units[i][:r]).encode()) for i, r in asked]


def test_shares_and_sentinels(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('some words ', id) AS text")
    forms = dict(map(tuple, fill_in_middle(docs, fim=50, spm=100).groupBy("form").count().collect()))
    assert set(forms) == {"plain", "spm"} and 1350 < forms["spm"] < 1650
    own = fill_in_middle(docs, seed=5, fim=100, sentinels=("<|pre.fix|>", "<|suf|>", "<|mid|>"))
    assert own.select(restored(own.output, own.form, ("<|pre.fix|>", "<|suf|>", "<|mid|>")).alias("t")).exceptAll(docs.select("text")).isEmpty()
    for bad in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<>", "<S>", "<M>"), ("<P<>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, sentinels=bad)


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
