import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.llm import source_mixing, toxicity_fm


def corpus(n=3000):
    """Toxic if it holds a bad word, but for the two that are bad only together."""
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 60))]
        kind = rng.random()
        toxic = 0
        if kind < 0.2:
            words.insert(rng.randrange(len(words) + 1), rng.choice(["Scumbags!", "scumbag,"]))
            toxic = 1
        elif kind < 0.4:
            words += ["pack", "groupname"]
            toxic = 1
        elif kind < 0.7:
            words += [rng.choice(["pack", "groupname"])]
        docs.append((i, " ".join(words), 0.0, 1))
        labels.append((i, 1, toxic))
    return docs, labels


DOCS = "doc_id long, text string, toxicity double, y int"


def test_toxicity_learns_pairs(spark):
    docs, labels = corpus()
    extra = [(5000, None, 0.0, 0), (5001, "", 0.0, 0), (None, "scumbag", 0.0, 0), (5002, "w1 " * 30000 + "scumbags", 0.0, 0), (5003, "w1", 0.0, 0), (5003, "w1", 0.0, 0)]
    df, lab = spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity_fm.toxicity_scores(df, lab).collect()
    assert len(got) == len(docs) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {d: t for d, _, t in labels}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    by = {r.doc_id: r for r in got}
    assert by[5002].predicted == 1 and by[None].predicted == 1 and by[5000].score == by[5001].score < 0.5


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = corpus(20)
    df, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert all(r.predicted == 0 for r in toxicity_fm.toxicity_scores(df, lab.where("false")).collect())
    assert all(r.predicted == 0 for r in toxicity_fm.toxicity_scores(df, lab.withColumn("toxic", F.lit(0))).collect())
    assert toxicity_fm.toxicity_scores(df.where("false"), lab).collect() == []


def test_pairs_beyond_linear_weights():
    """Only the pair is toxic: a machine with factors tells it, one without cannot."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (2000, 2))
    y = (x[:, 0] ^ x[:, 1]).astype(float)
    lists = [np.flatnonzero(r) for r in x]
    flat, bounds = np.concatenate(lists).astype(np.int64), np.append(0, np.cumsum([len(v) for v in lists]))
    fm = toxicity_fm.fit(y, flat, bounds, np.arange(2), epochs=40)
    assert ((fm.logits(flat, bounds) > 0) == (y == 1)).mean() > 0.99
    linear = toxicity_fm.fit(y, flat, bounds, np.arange(2), size=1, epochs=40)
    assert linear.factors.shape == (2, 1)


def test_toxicity_of_pairs_alone(spark):
    """Toxic is one of two words, not both and not none: neither says anything alone."""
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(3000):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 60))]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words += ["alpha"] * a + ["omega"] * b
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(a != b)))
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = [r for r in toxicity_fm.toxicity_scores(df, lab).collect() if r.held_out]
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in got]) > 0.95


def mixed(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        d = rng.choice(["a", "a", "a", "b", "c"])
        rows.append((i, " ".join(rng.choice([f"{d}{j}" for j in range(20)] + ["x", "y"]) for _ in range(rng.randint(5, 40))), 1.0, 7))
        labels.append((i, d)) if i % 3 else None
    rows += [(900, None, 1.0, 7), (901, "", 1.0, 7), (None, "b1 b2 b3", 1.0, 7), (902, "a1 " * 5000, 1.0, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, rate double, tokens int"), spark.createDataFrame([*labels, (None, "a"), (4, None), (5, "other")], "doc_id long, domain string"), len(rows)


@pytest.mark.parametrize(("targets", "low"), [([0.3, 0.4, 0.3], 0.0), ([0.5, 0.3, 0.2], 1.0)])
def test_rates_meet_targets(spark, targets, low):
    docs, labels, n = mixed(spark)
    got = source_mixing.mixing_rates(docs, labels, ["a", "b", "c"], targets, None if low else 1.0, low, 20.0).collect()
    assert len(got) == n and all(low <= r.rate <= 20 for r in got)
    mass = np.sum([np.array(r.posterior) * r.tokens * r.rate for r in got], axis=0)
    assert np.abs(mass / mass.sum() - targets).max() < 0.02
    assert all(abs(sum(r.posterior) - 1) < 1e-9 for r in got)


def soft(spark, shares, n=6000, sure=0.95):
    """(tokens, posterior) of documents that are mostly of one domain, by shares."""
    rng = np.random.default_rng(5)
    rows = []
    for d in rng.choice(len(shares), n, p=shares):
        top = rng.uniform(sure - 0.04, sure + 0.04)
        rows.append((int(rng.integers(5, 60)), [float(top if i == d else (1 - top) / (len(shares) - 1)) for i in range(len(shares))]))
    return spark.createDataFrame(rows, "tokens long, posterior array<double>").repartition(4).cache()


@pytest.mark.filterwarnings("error:no rates")
@pytest.mark.parametrize(("shares", "targets", "budget", "low", "sure"), [([0.8, 0.198, 0.002], source_mixing.TARGETS, 1.0, 0.0, 0.958), ([0.97, 0.03], [0.8, 0.2], None, 1.0, 0.95), ([0.88, 0.12], [0.8, 0.2], None, 1.0, 0.85), ([0.002, 0.998], [0.8, 0.2], None, 1.0, 0.958)])
def test_default_bounds_meet_targets_of_rare_domains(spark, shares, targets, budget, low, sure):
    table = soft(spark, shares, sure=sure)
    got = table.withColumn("rate", source_mixing.rate_at(source_mixing.fitted(table, targets, budget, low), low)).collect()
    mass = np.sum([np.array(r.posterior) * r.tokens * r.rate for r in got], axis=0)
    assert np.abs(mass / mass.sum() - targets).max() < 2e-4 and min(r.rate for r in got) >= low
    assert budget is None or abs(mass.sum() / sum(r.tokens for r in got) - budget) < 1e-3


def test_rare_domain_of_the_whole_query(spark):
    """Toxic texts are under 1 % of the tokens and are to have 5 %, with the defaults of op6."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(3000):
        d = "toxic" if i % 250 == 7 else "low" if i % 5 == 0 else "high"
        rows.append((i, " ".join(f"{d}{rng.randrange(20)}" for _ in range(30))))
        labels.append((i, d))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string")
    got = source_mixing.mixing_rates(docs, labels, source_mixing.DOMAINS, source_mixing.TARGETS).collect()
    start = np.sum([np.array(r.posterior) * r.tokens for r in got], axis=0)
    mass = np.sum([np.array(r.posterior) * r.tokens * r.rate for r in got], axis=0)
    assert start[2] / start.sum() < 0.01 and np.abs(mass / start.sum() - source_mixing.TARGETS).max() < 2e-4


def test_unreachable_targets_are_reported(spark):
    table = soft(spark, [0.9, 0.1], 500, sure=0.6)
    with pytest.warns(UserWarning, match="reached"):
        move = source_mixing.fitted(table, [0.3, 0.7], 1.0)
    got = table.withColumn("rate", source_mixing.rate_at(move, 0.0)).collect()
    mass = np.sum([np.array(r.posterior) * r.tokens * r.rate for r in got], axis=0)
    assert max(r.posterior[1] for r in got) - 0.05 < mass[1] / mass.sum() < 0.7  # gradient steps approach it only


def test_mixing_without_labels_or_rows(spark):
    docs, labels, n = mixed(spark)
    got = source_mixing.mixing_rates(docs, labels.where("false"), ["a", "b"], [0.5, 0.5]).collect()
    assert len(got) == n and all(abs(r.posterior[0] - 0.5) < 1e-9 for r in got)
    assert source_mixing.mixing_rates(docs.where("false"), labels, ["a", "b"], [0.5, 0.5]).collect() == []


def test_copies_follow_rates(spark):
    rows = spark.range(20000).withColumn("n", source_mixing.copies(F.lit(1.3), F.col("id")))
    assert abs(rows.agg(F.avg("n")).first()[0] - 1.3) < 0.02 and rows.where("n < 1 or n > 2").count() == 0
