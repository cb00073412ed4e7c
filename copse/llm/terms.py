"""Hashed terms of texts, the telling ones among them, and the labelled sample that classifiers are fitted on."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.llm.shared import over_texts, settle
from copse.llm.words import mix

BUCKETS = 1 << 22
PREFIXES = (4, 5, 6)
#: Terms whose chi squared chance alone exceeds once in a thousand are not telling.
CHANCE = 10.83
#: The same for a pair, as there are millions of them.
CHANCE_PAIR = 40.0
_CAPITALS, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!*$%&#@+=<>{}[]|\\~^_"
_WORD = re.compile(r"\w+")
_WHOLE, _BEGUN = zlib.crc32(b"w "), zlib.crc32(b"p ")


def word_terms(word: str) -> list[int]:
    """Buckets of a lower-case word and of its prefixes, which inflected forms share."""
    out = [zlib.crc32(word.encode(errors="replace"), _WHOLE) % BUCKETS]
    for n in PREFIXES:
        if len(word) > n:
            out.append(zlib.crc32(word[:n].encode(errors="replace"), _BEGUN) % BUCKETS)
    return out


def style_terms(text: str, words: list[str], distinct: int) -> list[int]:
    """Buckets of coarse shares that mark junk: capitals, repeated words, symbols, digits, lines, length."""
    data = text.encode(errors="replace")
    n = max(1, len(data))
    marks = {
        "upper": (len(data) - len(data.translate(None, _CAPITALS))) / n,
        "distinct": distinct / max(1, len(words)),
        "symbols": (len(data) - len(data.translate(None, _SYMBOLS))) / n,
        "lines": data.count(b"\n") / max(1, len(words)),
    }
    out = [f"s {k} {min(19, int(20 * v))}" for k, v in marks.items()]
    out.append(f"s length {len(words).bit_length()}")
    return [zlib.crc32(x.encode()) % BUCKETS for x in out]


class Terms:
    """Distinct term buckets of a text, or their positions in `vocabulary`; words seen before are looked up."""

    def __init__(self, vocabulary: np.ndarray | None = None, style: bool = False, memory: int = 200_000):
        self.at = None if vocabulary is None else {int(b): i for i, b in enumerate(vocabulary)}
        self.style, self.memory = style, memory
        self.known: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        found = word_terms(word)
        out = tuple(found) if self.at is None else tuple(self.at[t] for t in found if t in self.at)
        if len(self.known) >= self.memory:
            self.known.clear()
        self.known[word] = out
        return out

    def __call__(self, text: str | None) -> tuple[list[int], int]:
        """(sorted distinct terms, number of words) of the whole text; null counts as empty."""
        text = text or ""
        words = _WORD.findall(text.lower())
        own = set(words)
        found: set[int] = set()
        known = self.known
        for w in own:
            hit = known.get(w)
            if hit is None:
                hit = self._of(w)
            if hit:
                found.update(hit)
        if self.style:
            marks = style_terms(text, words, len(own))
            found.update(marks if self.at is None else (self.at[t] for t in marks if t in self.at))
        return sorted(found), len(words)


def _listed(vocabulary: np.ndarray | None, style: bool, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(vocabulary, style)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                lists = [terms(t)[0] for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lists, type=pa.list_(pa.int32()))], names=[*keep, "terms"])

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 5, is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sampled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(y, text) of at most `rows` labelled documents, those of the least hash of doc_id. `labels`: (doc_id, y), y an integer class.

    The labels' sample is bounded by `rows`, so it goes to every task and no text is shuffled; the sample is written once.
    """
    picked = labels.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return settle(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("y", "text"), "sample")


def counted(sample: DataFrame, classes: int, style: bool = False) -> tuple[DataFrame, dict[int, int]]:
    """(term, n, c0, c1, ...): in how many texts of `sample`(y, text), of each class, every term of five texts or more stands; and the classes' sizes."""
    totals = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    listed = over_texts(sample, _listed(None, style, ["y"]), "y int, terms array<int>").select("y", F.explode("terms").alias("term"))
    return settle(listed.groupBy("term").agg(F.count("*").alias("n"), *(F.count_if(F.col("y") == c).alias(f"c{c}") for c in range(classes))).where("n >= 5"), "terms"), totals


def telling(counts: DataFrame, totals: dict[int, int], most: int) -> np.ndarray:
    """The at most `most` terms whose presence tells the classes apart best, by chi squared."""
    n = sum(totals.values())
    chi = F.lit(0.0)
    for c in range(len(counts.columns) - 2):
        share = totals.get(c, 0) / max(n, 1)
        if 0 < share < 1:
            chi = chi + F.pow(F.col(f"c{c}") - F.col("n") * share, 2) / (F.col("n") * share * (1 - share) * (1 - F.col("n") / n + 1e-9))
    best = counts.select("term", chi.alias("chi")).where(F.col("chi") >= CHANCE).orderBy(F.col("chi").desc(), "term").limit(most).collect()
    return np.array([r[0] for r in best], dtype=np.int64)


def frequent(counts: DataFrame, totals: dict[int, int], most: int) -> np.ndarray:
    """The at most `most` terms that stand in most texts, but not in nearly all."""
    few = counts.where(F.col("n") <= 0.95 * sum(totals.values())).orderBy(F.col("n").desc(), "term").limit(most)
    return np.array([r[0] for r in few.select("term").collect()], dtype=np.int64)


def telling_pairs(y: np.ndarray, flat: np.ndarray, bounds: np.ndarray, terms: int, most: int) -> np.ndarray:
    """Positions of at most `most` of the `terms` that, in a pair, tell class 1 apart better than either term alone; the best pairs first.

    A pair's chi squared is that of both terms' presence, over the bounded sample, a stretch of rows at a time.
    """
    both, ones = np.zeros((terms, terms), dtype=np.float32), np.zeros((terms, terms), dtype=np.float32)
    for lo in range(0, len(y), 1024):
        hi = min(lo + 1024, len(y))
        grid = np.zeros((hi - lo, terms), dtype=np.float32)
        grid[np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1])), flat[bounds[lo] : bounds[hi]]] = 1
        both += grid.T @ grid
        grid = grid[y[lo:hi] == 1]
        ones += grid.T @ grid
    share = float((y == 1).mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return np.zeros(0, dtype=np.int64)
    ones -= both * np.float32(share)
    both[both < 5] = np.inf
    chi = ones * ones / (both * (share * (1 - share)) * (1 - np.minimum(both, len(y)) / len(y) + 1e-9))
    own = np.diag(chi).copy()
    chi = np.triu(chi - np.maximum(own[:, None], own[None, :]), 1)
    a, b = np.nonzero(chi >= CHANCE_PAIR)
    order = np.argsort(-chi[a, b], kind="stable")
    found = np.stack([a[order], b[order]], axis=1).ravel()
    _, first = np.unique(found, return_index=True)
    return found[np.sort(first)][:most]


def examples(sample: DataFrame, vocabulary: np.ndarray, style: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes, term positions of all rows, where each row's begin) of the bounded sample, on the driver, in an order that its partitions do not change."""
    got = over_texts(sample, _listed(vocabulary, style, ["y"]), "y int, terms array<int>").toArrow().combine_chunks()
    y, lists = got.column("y").to_numpy(), got.column("terms").combine_chunks()
    flat, n = lists.flatten().to_numpy().astype(np.int64), lists.value_lengths().to_numpy().astype(np.int64)
    sums = np.append(np.uint64(0), np.cumsum(mix(flat.astype(np.uint64) + np.uint64(1)), dtype=np.uint64))
    starts = np.cumsum(n) - n
    order = np.lexsort((sums[starts + n] - sums[starts], n, y))
    starts, n = starts[order], n[order]
    bounds = np.append(0, np.cumsum(n)).astype(np.int64)
    return y[order], flat[np.repeat(starts - bounds[:-1], n) + np.arange(len(flat))], bounds
