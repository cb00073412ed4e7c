"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms (words, and prefixes that inflected forms share) among those that tell the classes apart. Its
logit is b + sum w_i + sum_{i<j} <v_i, v_j>: beside linear weights, every pair of terms present adds the product of their factors,
so an insult that means something else next to a group mention, or the other way round, gets a weight of its own. Terms are
picked by chi squared, alone (at most `terms`) or, of the `often` most frequent ones, in pairs (at most `terms` more), so that
words which say nothing alone are kept for what they say together. The machine is fitted (AdaGrad, fixed seed) on at most `sample` labelled rows, the documented bound; all
texts are scored whole.

Behaviour: null and empty texts have no terms and get the logit b. Labels repeated for a document count once (1 wins); documents
repeated are scored each. With one class only, the score is a constant near it; without labelled rows it is near 0. Rows keep their doc_id, null or
not (null is held out or not as the empty text is). Columns other than doc_id and text are no input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.llm.shared import drop, over_texts
from copse.llm.terms import Terms, counted, examples, frequent, held_out, sampled, telling, telling_pairs


#: Small samples are gone through more often, for so many steps at least.
STEPS = 600


@dataclass(frozen=True)
class Machine:
    vocabulary: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        n = len(bounds) - 1
        lin = np.bincount(row, self.linear[flat], minlength=n)
        v = self.factors[flat]
        total = np.stack([np.bincount(row, v[:, f], minlength=n) for f in range(v.shape[1])], axis=1)
        square = np.bincount(row, (v * v).sum(1), minlength=n)
        return self.bias + lin + 0.5 * ((total * total).sum(1) - square)


def fit(y: np.ndarray, flat: np.ndarray, bounds: np.ndarray, vocabulary: np.ndarray, size: int = 8, epochs: int = 12, batch: int = 256, rate: float = 0.1, decay: float = 1e-4, seed: int = 11) -> Machine:
    rng = np.random.default_rng(seed)
    terms = len(vocabulary)
    w, v = np.zeros(terms), rng.normal(0, 0.05, (terms, size))
    share = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    b = float(np.log(share / (1 - share)))
    if not len(y) or share in (1e-3, 1 - 1e-3) or not terms:
        return Machine(vocabulary, b, w, v)
    gw, gv, gb = np.full(terms, 1e-3), np.full((terms, size), 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            n = bounds[rows + 1] - bounds[rows]
            row = np.repeat(np.arange(len(rows)), n)
            term = flat[np.repeat(bounds[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            vt = v[term]
            total = np.stack([np.bincount(row, vt[:, f], minlength=len(rows)) for f in range(size)], axis=1)
            z = b + np.bincount(row, w[term], minlength=len(rows)) + 0.5 * ((total * total).sum(1) - np.bincount(row, (vt * vt).sum(1), minlength=len(rows)))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            used, at = np.unique(term, return_inverse=True)
            dw = np.bincount(at, g[row]) + decay * w[used] / len(rows)
            pair = g[row, None] * (total[row] - vt)
            dv = np.stack([np.bincount(at, pair[:, f]) for f in range(size)], axis=1) + decay * v[used] / len(rows)
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += g.sum() ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
            b -= rate * g.sum() / np.sqrt(gb)
    return Machine(vocabulary, float(b), w, v)


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, terms: int = 4096, often: int = 2048) -> Machine:
    """A machine fitted on labelled, not held-out documents; `labels`: (doc_id, toxic)."""
    rows = sampled(docs, labels.where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("y")), sample)
    counts, totals = counted(rows, 2)
    alone, common = telling(counts, totals, terms), frequent(counts, totals, often)
    drop(counts)
    vocabulary = np.concatenate([alone, common[~np.isin(common, alone)]])
    y, flat, bounds = examples(rows, vocabulary)
    drop(rows)
    asked = np.isin(vocabulary, common)
    pairs = np.flatnonzero(asked)[telling_pairs(y, *_only(flat, bounds, asked), int(asked.sum()), terms)]
    kept = np.arange(len(vocabulary)) < len(alone)
    kept[pairs] = True
    flat, bounds = _only(flat, bounds, kept)
    return fit(y.astype(np.float64), flat, bounds, vocabulary[kept], epochs=max(12, -(-STEPS * 256 // max(len(y), 1))))


def _only(flat: np.ndarray, bounds: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' terms that are kept, renumbered."""
    stays = kept[flat] if len(flat) else np.zeros(0, dtype=bool)
    return (np.cumsum(kept) - 1)[flat[stays]], np.append(0, np.cumsum(stays))[bounds]


def _scored(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(machine.vocabulary)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                lists = [terms(t)[0] for t in batch.column("text").to_pylist()]
                z = machine.logits(np.array([t for x in lists for t in x], dtype=np.int64), np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64))
                arrays = [c for name, c in zip(batch.schema.names, batch.columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], names=[*batch.schema.names, "toxicity"])

    return run


def with_toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """`docs` with a column `toxicity`, 0 to 1, of every row's whole text."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return over_texts(docs, _scored(machine), f"{columns}, toxicity double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = 20_000, terms: int = 4096) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = with_toxicity(rows, train(rows, labels, sample, terms))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
