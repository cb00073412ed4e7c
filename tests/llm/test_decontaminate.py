import random
import re

import pytest

from copse.llm import decontaminate
from copse.llm.decontaminate import hits, without_benchmark

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, found = [False] * len(w), set()
        for window, of in windows.items():
            k = len(window)
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) == window:
                    hit[i : i + k] = [True] * k
                    found |= of
        out.append((doc, len(w), sum(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in df.collect()), key=repr)


def tables(spark, n):
    rng = random.Random(n)
    vocabulary = ["a", "B", "ab", "Über", "漢字", "x1", "É", "zz"]
    say = lambda k: rng.choice([" ", ", ", "\n", "--"]).join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, say(rng.choice([n - 1, n, n + 1, 3 * n]))) for i in range(12)] + [(50, "zz zz"), (50, "B"), (None, say(n)), (60, None), (61, ""), (62, "!?"), (10, "never said"), (63, "É")]
    docs = [(i, say(rng.randrange(40))) for i in range(80)] + [(100 + i, f"{say(5)} {t} {say(5)}") for i, (_, t) in enumerate(items) if t]
    docs += [(200, None), (201, ""), (202, "...") , (None, items[0][1]), (203, items[1][1]), (203, items[1][1]), (204, "zz " * 3000), (205, items[2][1].upper().replace(" ", "_"))]
    frame = lambda rows, key: spark.createDataFrame([(k, t, "x", [1]) for k, t in rows], f"{key} long, text string, items string, hits array<int>")
    return docs, items, frame(docs, "doc_id"), frame(items, "item_id")


@pytest.mark.parametrize(("n", "most"), [(3, 1 << 20), (10, 1 << 20), (4, 9)])
def test_hits_against_plain_search(spark, n, most, monkeypatch):
    """The last case takes several scans, each with a part of the windows."""
    docs, items, d, b = tables(spark, n)
    if most < 100:
        monkeypatch.setattr(decontaminate, "PIECE", 2)
    assert rows_of(hits(d, b, n, most=most)) == brute(docs, items, n)


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    """Were all windows of one hash, every hit would still be verified."""
    docs, items, d, b = tables(spark, 3)
    monkeypatch.setattr(decontaminate.Matcher, "_hash", staticmethod(lambda ids, k: ids[: max(0, len(ids) - k + 1)].astype("uint64") * 0))
    matcher = decontaminate.Matcher([(str(i), " ".join(words_of(t)), min(3, len(words_of(t)))) for i, t in items if i is not None and words_of(t)])
    want = {r[0]: r for r in brute(docs, [x for x in items if x[0] is not None], 3)}
    for doc, text in docs[:40]:
        found = set()
        for _, _, words in decontaminate.slices(decontaminate.pa.array([text]), decontaminate._NORMAL):
            for k, _, which in matcher.hits(words):
                w = matcher.windows[k]
                found |= {matcher.names[i] for x in which.tolist() for i in w.items[w.bounds[x] : w.bounds[x + 1]]}
        assert sorted(found) == want[doc][3]


def test_spans_and_documents_go(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Before, {item.upper()}! after"), (2, "clean é text"), (3, item), (4, None), (5, f"{item} x {item}."), (6, " ".join(item.split()[1:10]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert dict(map(tuple, without_benchmark(docs, items).collect())) == {1: "Before, ! after", 2: "clean é text", 3: "", 4: None, 5: " x .", 6: "two three four five six seven eight nine ten"}
    assert sorted(r.doc_id for r in without_benchmark(docs, items, spans=False).collect()) == [2, 4, 6]
    assert sorted(r.doc_id for r in without_benchmark(docs, items, spans=False, share=0.9).collect()) == [1, 2, 4, 6]
    got = {r.doc_id: r.hits for r in hits(docs, items).collect()}
    assert got[5] == [0, 11, 12, 23] and got[2] == [] and got[1] == [1, 12]


def test_empty_tables(spark):
    none, item = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert hits(none, item).collect() == [] and rows_of(hits(one, item)) == [(1, 2, 0, [])]
