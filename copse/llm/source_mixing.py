"""Mixing sources to target weights by soft membership.

A document belongs to every domain by degrees: a softmax classifier over hashed terms and style marks, fitted on at most `sample`
rows of the labelled table (the documented bound), gives each document a posterior p over the domains. Documents get rates w >= low
so that the expected tokens of every domain, sum of w n p over the corpus with n a document's words, meet their targets:

    A w = t,   A w = sum_d w_d (n_d / N) p_d,   t: target share x `budget`

or, without a `budget`, so that their shares do: sum_d w_d (n_d / N) (p_d - target share) = 0. This least-squares problem is solved by projected
gradient, from w = 1: with r the miss A w - t, every rate moves against its gradient p_d . G r and is then put back within its bounds,

    w_d <- max(low, w_d - s p_d . G r)

where G is the inverse of the Gram matrix of the rows above `low` (of all rows, where none is), for which a step of s = 1 just meets the targets as long as no more rows
reach a bound. Smaller s are tried, and a plain gradient step at last, until the squares of the miss fall. A step is one distributed sum of K numbers and that matrix, over a table of (tokens, posterior, rate) that is written anew every few steps. What
reaches the driver are these sums of each step; a rate is a column folded over the steps, never collected. Steps end when
the targets are met to `close` of the tokens, when rates or misses hardly change any more, or after `steps`.

Behaviour: null and empty texts have no tokens; their rate 1 is moved like any other by their posterior. Documents without
a domain label are scored like the rest. Labels repeated for a document count once (the domain named last in `domains`); labels that say nothing are none. A domain without labelled rows has posterior 0;
without any label all domains are equally likely. Targets must be nonnegative; they are scaled to sum 1. Rows keep their doc_id; repeated
rows count each. Rates have no upper bound unless `high` is given. Targets that no rates meet are approached for at most `steps` steps, with a warning that names
the shares reached. Empty tables give no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.llm.shared import drop, over_texts, settle
from copse.llm.terms import Terms, counted, examples, sampled, telling


@dataclass(frozen=True)
class Softmax:
    vocabulary: np.ndarray
    bias: np.ndarray
    weights: np.ndarray  # (terms, classes)

    def posteriors(self, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        z = np.stack([np.bincount(row, self.weights[flat, c], minlength=len(bounds) - 1) for c in range(len(self.bias))], axis=1) + self.bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit(y: np.ndarray, flat: np.ndarray, bounds: np.ndarray, vocabulary: np.ndarray, classes: int, epochs: int = 12, batch: int = 256, rate: float = 0.2, decay: float = 1e-3, seed: int = 13) -> Softmax:
    rng = np.random.default_rng(seed)
    seen = np.bincount(y, minlength=classes) if len(y) else np.ones(classes)
    bias = np.where(seen > 0, np.log(np.maximum(seen, 1) / seen.sum()), -1e3)
    w = np.zeros((len(vocabulary), classes))
    gw = np.full_like(w, 1e-3)
    for _ in range(epochs if len(y) and len(vocabulary) else 0):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            n = bounds[rows + 1] - bounds[rows]
            row = np.repeat(np.arange(len(rows)), n)
            term = flat[np.repeat(bounds[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            p = Softmax(vocabulary, bias, w).posteriors(term, np.append(0, np.cumsum(n)))
            p[np.arange(len(rows)), y[rows]] -= 1
            used, at = np.unique(term, return_inverse=True)
            d = np.stack([np.bincount(at, p[row, c], minlength=len(used)) for c in range(classes)], axis=1) / len(rows) + decay * w[used] / len(rows)
            gw[used] += d * d
            w[used] -= rate * d / np.sqrt(gw[used])
    return Softmax(vocabulary, bias, w)


def train(docs: DataFrame, labels: DataFrame, domains: list[str], sample: int = 20_000, terms: int = 4096) -> Softmax:
    """`labels`: (doc_id, domain); names not in `domains` are ignored."""
    number = F.element_at(F.create_map(*(x for i, d in enumerate(domains) for x in (F.lit(d), F.lit(i)))), F.col("domain"))
    rows = sampled(docs, labels.where(F.col("domain").isin(domains)).select("doc_id", number.cast("int").alias("y")), sample)
    counts, totals = counted(rows, len(domains), style=True)
    vocabulary = telling(counts, totals, terms)
    y, flat, bounds = examples(rows, vocabulary, style=True)
    drop(counts, rows)
    return fit(y.astype(np.int64), flat, bounds, vocabulary, len(domains))


def _posterior(model: Softmax):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(model.vocabulary, style=True)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                got = [terms(t) for t in batch.column("text").to_pylist()]
                p = model.posteriors(np.array([t for x, _ in got for t in x], dtype=np.int64), np.append(0, np.cumsum([len(x) for x, _ in got])).astype(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1) * p.shape[1], type=pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array([n for _, n in got], type=pa.int64()), lists], names=[*(c for c in batch.schema.names if c != "text"), "tokens", "posterior"])

    return run


def posteriors(docs: DataFrame, model: Softmax) -> DataFrame:
    """`docs` with `tokens` and `posterior` in place of `text`."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return over_texts(docs, _posterior(model), f"{columns}, tokens long, posterior array<double>")


def _dot(values: list[Column], move: np.ndarray) -> Column:
    out = F.lit(0.0)
    for v, x in zip(values, move, strict=True):
        out = out + v * F.lit(float(x))
    return out


def _clipped(rate: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), rate))


def _stepped(rate: Column, moves: np.ndarray, low: float, high: float, q: list[Column]) -> Column:
    for move in moves:
        rate = _clipped(rate - _dot(q, move), low, high)
    return rate


def rate_at(moves: np.ndarray, low: float, high: float = np.inf) -> Column:
    """The rate of a row: 1, moved by its posterior at every step and put back within the bounds."""
    start = _clipped(F.lit(1.0), low, high)
    k = moves.shape[1]
    if len(moves) <= 16:
        return _stepped(start, moves, low, high, [F.element_at("posterior", i + 1) for i in range(k)])
    return F.aggregate(F.array(*(F.array(*(F.lit(float(x)) for x in m)) for m in moves)), start, lambda w, m: _clipped(w - sum((m[i] * F.element_at("posterior", i + 1) for i in range(k)), F.lit(0.0)), low, high))


#: Steps between two writings of the rates.
_WRITE = 6


def fitted(table: DataFrame, targets: list[float], budget: float | None = None, low: float = 0.0, high: float = np.inf, close: float = 1e-4, steps: int = 60) -> np.ndarray:
    """The moves for `rate_at` over `table`(tokens, posterior). `budget`: tokens wanted over tokens there; if None, as many as `low` and the targets need."""
    k = len(targets)
    goal = np.array(targets, dtype=np.float64) / sum(targets)
    n = table.agg(F.sum("tokens")).first()[0]
    if not n:
        return np.zeros((0, k))
    if budget is None and low <= 0:
        budget = 1.0
    want, less = (np.zeros(k), goal) if budget is None else (budget * goal, np.zeros(k))
    p = [F.element_at("posterior", i + 1) for i in range(k)]
    q = [x - F.lit(float(g)) for x, g in zip(p, less, strict=True)]
    weight = F.col("tokens") / F.lit(float(n))
    pairs = list(zip(*np.triu_indices(k), strict=True))

    def look(base: DataFrame, moves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
        """After the moves: tokens by domain, the miss, how far the last one led, and the Gram matrix of the rows above `low`."""
        held = base.select(weight.alias("weight"), _stepped(F.col("rate"), moves[:-1], low, high, q).alias("w"), *(x.alias(f"q{i}") for i, x in enumerate(q)))
        own = [F.col(f"q{i}") for i in range(k)]
        held = held.withColumn("v", _stepped(F.col("w"), moves[-1:], low, high, own))
        free = F.when(F.col("v") > low, F.col("weight")).otherwise(0.0)
        got = held.agg(F.sum(F.col("weight") * F.col("v")), *(F.sum(F.col("weight") * F.col("v") * x) for x in own), F.sum(F.col("weight") * (F.col("v") - F.col("w")) ** 2), *(F.sum(free * own[i] * own[j]) for i, j in pairs)).first()
        sums, gram = np.array(got[1 : k + 1], dtype=np.float64), np.zeros((k, k))
        for (i, j), x in zip(pairs, got[k + 2 :], strict=True):
            gram[i, j] = gram[j, i] = x
        return sums + less * got[0], sums - want, float(got[k + 1]), gram

    def settled(base: DataFrame, moves: list[np.ndarray]) -> DataFrame:
        return settle(base.select("tokens", "posterior", _stepped(F.col("rate"), moves, low, high, q).alias("rate")), "rates")

    def missed() -> bool:
        return np.abs(miss).max() >= close * (tokens.sum() if budget is None else 1.0)

    base = settle(table.select("tokens", "posterior", _clipped(F.lit(1.0), low, high).alias("rate")), "rates")
    done, pending = [], []
    every = np.array(table.agg(*(F.sum(weight * q[i] * q[j]) for i, j in pairs)).first(), dtype=np.float64)
    whole = np.zeros((k, k))
    for (i, j), x in zip(pairs, every, strict=True):
        whole[i, j] = whole[j, i] = x
    plain = np.eye(k) / np.linalg.eigvalsh(whole)[-1]
    tokens, miss, _, gram = look(base, [np.zeros(k)])
    while missed() and len(done) + len(pending) < steps:
        metric = np.linalg.pinv(gram if gram.any() else whole, rcond=1e-9, hermitian=True)
        for move in (*(s * metric @ miss for s in (1.0, 0.25, 1 / 16)), plain @ miss):
            near = look(base, [*pending, move])
            if near[1] @ near[1] < (1 - 1e-3) * miss @ miss:
                break
        pending.append(move)
        gain, moved = miss @ miss - near[1] @ near[1], near[2]
        tokens, miss, _, gram = near
        if gain < 1e-6 * (close**2 + miss @ miss) or moved < 1e-18:
            break
        if len(pending) == _WRITE:
            base, old = settled(base, pending), base
            drop(old)
            done, pending = done + pending, []
    drop(base)
    if missed():
        warnings.warn(f"no rates of {low} to {high} were found that meet the shares {goal.round(6).tolist()}: {(tokens / max(tokens.sum(), 1e-300)).round(6).tolist()} reached, with {tokens.sum():.6g} of the tokens", stacklevel=2)
    moves = np.array(done + pending, dtype=np.float64).reshape(-1, k)
    return moves - (moves @ less)[:, None]


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled table: toxic, else high or low quality; null where quality is unknown too."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality").isNotNull(), "low").alias("domain"))


DOMAINS = ["high", "low", "toxic"]
TARGETS = [0.80, 0.15, 0.05]


def mixing_rates(docs: DataFrame, labels: DataFrame, domains: list[str], targets: list[float], budget: float | None = 1.0, low: float = 0.0, high: float = np.inf, sample: int = 20_000) -> DataFrame:
    """(doc_id, tokens, posterior, rate) for every row of `docs`(doc_id, text); `labels`: (doc_id, domain)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = settle(posteriors(rows, train(rows, labels, domains, sample)), "posteriors")
    return table.withColumn("rate", rate_at(fitted(table, targets, budget, low, high), low, high))


def copies(rate: Column, doc_id: Column) -> Column:
    """Whole copies of a document at its rate: the floor, and one more with the fraction's probability, by a hash of doc_id."""
    chance = F.pmod(F.xxhash64(doc_id, F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int")
