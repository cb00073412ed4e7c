import random
import re

import numpy as np

from copse.llm import chosen_path
from copse.llm.chosen_path import chosen_path_join
from copse.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    group, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    low = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return sorted(((rows[i][0], low[group[i]], links[i]) for i in range(len(rows))), key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=repr)


def corpus():
    rng = random.Random(4)
    rows = []
    for g in range(25):
        base = [f"{g}w{rng.randrange(500)}" for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    shared = " ".join(f"s{i}" for i in range(40))
    rows += [(1000 + i, shared + " " + " ".join(f"u{i}_{j}" for j in range(80))) for i in range(12)]
    rows += [(2000, None), (2001, ""), (2002, "a b"), (2003, "a  b"), (2004, "a b c"), (None, "a b"), (2005, "x " * 3000), (2006, "a b"), (2006, "a b"), (2007, " \n")]
    return rows


def test_links_and_classes(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 0, 0) for d, t in rows], "doc_id long, text string, component long, id int")
    assert rows_of(chosen_path_join(docs, recall=0.9999)) == brute(rows)


def test_small_buckets_and_blocks_lose_nothing(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(chosen_path_join(docs, recall=0.9999, bucket=3, depth=2, block=3)) == brute(rows)


def test_default_recall_counts_the_shared_min_hashes():
    """Isolated pairs at the threshold with the default parameters: a simulation of the min-hashes, the paths and the search."""
    defaults = dict(zip(reversed(chosen_path_join.__code__.co_varnames[: chosen_path_join.__code__.co_argcount]), reversed(chosen_path_join.__defaults__), strict=False))
    runs = chosen_path.runs_for(0.8, defaults["depth"], defaults["recall"])
    rng = np.random.default_rng(1)
    agree = rng.random((200_000, chosen_path.COORDS)) < 0.8
    m = agree.sum(axis=1)
    lost = np.mean(np.where(m >= chosen_path.agreeing(0.8), (1 - (m / chosen_path.COORDS) ** defaults["depth"]) ** runs, 1.0))
    assert lost < 1.5e-4


def test_defaults_meet_pairs_in_hot_buckets(spark):
    """Pairs at 0.80 to 0.85 that are nobody else's near copies, among many texts that share half their words, so that buckets are split."""
    rng = random.Random(6)
    half = [f"s{i}" for i in range(100)]
    rows = []
    for g in range(400):
        a = half + [f"{g}w{i}" for i in range(100)]
        b = list(a)
        for at in rng.sample([110, 125, 140, 155, 170, 185], 4):
            b[at] = f"{g}c{at}"
        b[199:] = [f"{g}e"]
        rows += [(2 * g, " ".join(a)), (2 * g + 1, " ".join(b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(chosen_path_join(docs, bucket=8))
    assert got == sorted(((d, d - d % 2, 1) for d, _ in rows), key=repr)


def test_empty(spark):
    assert chosen_path_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_near_copies_of_more_than_one_block(spark):
    """A group larger than a bucket's block: every text is linked with every other, each pair counted once."""
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, f"u{i} {shared}") for i in range(1500)] + [(5000 + i, " ".join(f"o{i}x{j}" for j in range(60))) for i in range(50)]
    got = rows_of(chosen_path_join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == sorted([(i, 0, 1499) for i in range(1500)] + [(5000 + i, 5000 + i, 0) for i in range(50)], key=repr)


def test_balanced_sequences_are_no_copies(spark):
    turned = lambda n, of, t: [of[(bin(i).count("1") + t) % 2] for i in range(n)]
    rows = [(t, "".join(turned(1024, "ab", t)) + " one two three") for t in (0, 1)] + [(10 + t, " ".join(turned(2048, ["x", "y"], t))) for t in (0, 1)]
    rows += [(-(1 << 63), "p q"), ((1 << 63) - 1, "p q"), (None, "p q"), (0, "p q")]
    assert rows_of(chosen_path_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
