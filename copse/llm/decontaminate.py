"""Benchmark decontamination by a broadcast hash set of n-grams.

Texts are lower-cased (A-Z) and cut into words of letters, digits and all characters beyond ASCII. A benchmark item's windows are its runs
of `n` words, or the whole item if it has fewer. They are broadcast as a hash set: word ids, the hash of every window over them, its ids, and
the items that hold it. One scan over the documents gives every word its id (by hash, then byte by byte), looks up the windows all of whose words are known, and verifies
each hit id by id. What a document's hits cover is reported, removed as spans, or takes the document with it.

What is broadcast is bounded: items are cut into pieces of at most `PIECE` windows, dealt by hash over as many parts as keep a part under `most` windows on
average, and each part gets a broadcast and a scan of its own, which adds to what the scans before it found (written in between). So a benchmark under the bound
takes one scan without a shuffle, and a larger one more scans, not more memory. Texts are hashed in slices; a task holds one
batch and one part.

Behaviour: null texts, documents' or items', have no words. Repeated rows are reported each. Items of one item_id count once; an item without item_id hits
words but is not counted or listed. A document shorter than every window has no hits. Columns other than doc_id and text, item_id and text are not read.
An empty benchmark hits nothing; no documents give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.llm.shared import drop, ints, over_texts, settle
from copse.llm.words import Words, mix, places, runs_of, slices

PIECE = 4096
_U = np.uint64
#: Letters in lower case, digits, and bytes of characters beyond ASCII stand for themselves, all others for a space.
_NORMAL = np.full(256, 0x20, dtype=np.uint8)
_NORMAL[0x30:0x3A], _NORMAL[0x61:0x7B], _NORMAL[0x80:] = np.arange(0x30, 0x3A), np.arange(0x61, 0x7B), np.arange(0x80, 0x100)
_NORMAL[0x41:0x5B] = np.arange(0x61, 0x7B)
_WORD = re.compile(rb"[^ ]+")


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return places(sizes) + np.repeat(starts, sizes)


@dataclass(frozen=True)
class Windows:
    """Distinct windows of one length: their hashes in order, word ids, and the items of each (`items[bounds[i]:bounds[i + 1]]`)."""

    hashes: np.ndarray
    ids: np.ndarray
    bounds: np.ndarray
    items: np.ndarray


class Matcher:
    """The hash set of one part of a benchmark."""

    def __init__(self, pieces: list[tuple[str | None, str, int]]):
        """`pieces`: (item, its words joined by spaces, the length of its windows)."""
        split = [text.split(" ") for _, text, _ in pieces]
        vocabulary = sorted({w for words in split for w in words})
        data = "".join(vocabulary).encode()
        ends = np.append(0, np.cumsum([len(w.encode()) for w in vocabulary])).astype(np.int64)
        hashes, self.seed = np.zeros(0, dtype=_U), -1
        while not self.seed + 1 or len(np.unique(hashes)) < len(vocabulary):  # no two words of one hash
            self.seed += 1
            hashes = Words(np.frombuffer(data, dtype=np.uint8), ends).hashes(self.seed)
        order = np.argsort(hashes)
        self.hashes, self.data = hashes[order], np.frombuffer(data, dtype=np.uint8)
        self.start, self.size = ends[:-1][order], np.diff(ends)[order]
        number = {vocabulary[j]: i for i, j in enumerate(order.tolist())}
        self.names = sorted({item for item, _, _ in pieces if item is not None})
        place = {item: i for i, item in enumerate(self.names)}
        lengths: dict[int, list[tuple[int, list[int]]]] = {}
        for (item, _, k), words in zip(pieces, split, strict=True):
            lengths.setdefault(k, []).append((place.get(item, -1), [number[w] for w in words]))
        self.windows = {k: self._of(k, rows) for k, rows in sorted(lengths.items())}

    @staticmethod
    def _hash(ids: np.ndarray, k: int) -> np.ndarray:
        return runs_of(mix(ids.astype(_U) + _U(1)), k, 31)

    def _of(self, k: int, rows: list[tuple[int, list[int]]]) -> Windows:
        grid = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.array(ids, dtype=np.int32), k) for _, ids in rows])
        item = np.repeat([i for i, _ in rows], [len(ids) - k + 1 for _, ids in rows])
        ids, which = np.unique(grid, axis=0, return_inverse=True)
        hashes = self._hash(ids.ravel(), k)[::k]
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        pairs = np.unique(np.stack([rank[which.ravel()], item], axis=1)[item >= 0], axis=0)
        return Windows(hashes[order], ids[order], np.searchsorted(pairs[:, 0], np.arange(len(order) + 1)), pairs[:, 1])

    def ids(self, words: Words) -> np.ndarray:
        """The id of every word, -1 for words that no item has: equal hashes first, then equal bytes."""
        out = np.full(len(words.start), -1, dtype=np.int64)
        if not len(self.hashes) or not len(out):
            return out
        h = words.hashes(self.seed)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        size = words.end - words.start
        like = np.flatnonzero((self.hashes[at] == h) & (self.size[at] == size))
        same = np.ones(len(like), dtype=bool)
        differ = words.data[_spans(words.start[like], size[like])] != self.data[_spans(self.start[at[like]], size[like])]
        same[np.repeat(np.arange(len(like)), size[like])[differ]] = False
        out[like[same]] = at[like[same]]
        return out

    def hits(self, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, first words, windows) of the verified hits."""
        ids = self.ids(words)
        unknown = np.append(0, np.cumsum(ids < 0))
        last = np.repeat(words.first[1:], words.counts)
        at = np.arange(len(ids))
        for k, windows in self.windows.items():
            inside = at[at + k <= last]
            inside = inside[unknown[inside + k] == unknown[inside]]
            if not len(inside):
                continue
            h = self._hash(ids, k)[inside]
            lo, hi = np.searchsorted(windows.hashes, h), np.searchsorted(windows.hashes, h, side="right")
            found = np.flatnonzero(lo < hi)
            start, which = np.repeat(inside[found], (hi - lo)[found]), _spans(lo[found], (hi - lo)[found])
            for lo_ in range(0, len(start), 1 << 16):
                s, w = start[lo_ : lo_ + (1 << 16)], which[lo_ : lo_ + (1 << 16)]
                same = (ids[s[:, None] + np.arange(k)] == windows.ids[w]).all(1)
                yield k, s[same], w[same]


def _pieces(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = _WORD.findall(_NORMAL[np.frombuffer((text or "").encode(), dtype=np.uint8)].tobytes())
                k = min(n, len(words))
                rows += [(item, i, b" ".join(words[i : i + PIECE + k - 1]).decode(), k, min(PIECE, len(words) - k + 1 - i)) for i in range(0, len(words) - k + 1 if k else 0, PIECE)]
            yield pa.RecordBatch.from_pylist([dict(zip(("item", "at", "words", "k", "windows"), r, strict=True)) for r in rows], schema=pa.schema([("item", pa.string()), ("at", pa.int64()), ("words", pa.string()), ("k", pa.int64()), ("windows", pa.int64())]))

    return run


def _scanned(matcher, last: bool, texts: str | None):
    """Adds to `hits` (first word and word after the last, in turns) and `items` of each document; the last scan counts, and cuts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Matcher = matcher.value
        for batch in batches:
            before, known = batch.column("hits"), batch.column("items").to_pylist()
            for lo, hi, words in slices(batch.column("text"), _NORMAL):
                n = len(words.start)
                old = before.slice(lo, hi - lo)
                ranges = old.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(words.first[:-1], old.value_lengths().to_numpy(zero_copy_only=False))
                change = np.bincount(ranges[::2], minlength=n + 1) - np.bincount(ranges[1::2], minlength=n + 1)
                found: dict[int, set[str]] = {}
                for k, start, which in m.hits(words):
                    change += np.bincount(start, minlength=n + 1) - np.bincount(start + k, minlength=n + 1)
                    windows = m.windows[k]
                    text = np.searchsorted(words.first, start, side="right") - 1
                    order = np.lexsort((which, text))
                    cuts = np.flatnonzero(np.diff(text[order], prepend=-1))
                    for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                        own = np.unique(which[order[a:b]])
                        items = np.unique(windows.items[_spans(windows.bounds[own], np.diff(windows.bounds)[own])])
                        found.setdefault(int(text[order[a]]), set()).update(m.names[i] for i in items.tolist())
                hit = np.cumsum(change)[:-1] > 0
                text = np.repeat(np.arange(hi - lo), words.counts)
                edge = np.diff(hit.astype(np.int8), prepend=0)
                edge[words.first[:-1][words.counts > 0]] = hit[words.first[:-1][words.counts > 0]]  # a stretch ends with its text
                firsts = np.flatnonzero(edge == 1)
                ends = np.flatnonzero(hit & ~np.append(hit[1:] & (edge[1:] != 1), False)) + 1
                many = np.bincount(text[firsts], minlength=hi - lo)
                items = [sorted(found.get(i, set()).union(known[lo + i])) for i in range(hi - lo)]
                own = [batch.column("doc_id").slice(lo, hi - lo)]
                names = ["doc_id"]
                if last:
                    own += [ints(words.counts), ints(np.bincount(text, hit, hi - lo))]
                    names += ["n_words", "n_hit"]
                if texts or not last:
                    whole = batch.column("text").slice(lo, hi - lo)
                    own.append(_cut(whole, words, firsts, ends, many) if last and texts == "cut" else whole)
                    names.append("text")
                base = np.repeat(words.first[:-1], many)
                flat = np.stack([firsts - base, ends - base], axis=1).ravel()
                own += [pa.ListArray.from_arrays(pa.array(np.append(0, 2 * np.cumsum(many)), type=pa.int32()), ints(flat)), pa.array(items, type=pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(own, names=[*names, "hits", "items"])

    return run


def _cut(column: pa.Array, words: Words, firsts: np.ndarray, ends: np.ndarray, many: np.ndarray) -> pa.Array:
    """The texts without their hit stretches, from the first byte of the first word to the last of the last."""
    out, at = [], 0
    for i, text in enumerate(column.cast(pa.binary()).to_pylist()):
        kept, done = [], 0
        for j in range(at, at + int(many[i])):
            kept.append(text[done : words.start[firsts[j]] - words.offsets[i]])
            done = int(words.end[ends[j] - 1] - words.offsets[i])
        at += int(many[i])
        out.append(text if text is None else b"".join([*kept, text[done:]]))
    return pa.array(out, type=pa.binary()).cast(pa.string())


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, texts: str | None = None, most: int = 1 << 20) -> DataFrame:
    """(doc_id, n_words, n_hit[, text], hits, items) for every row of `docs`(doc_id, text), against `benchmark`(item_id, text).

    hits: the first word and the word after the last of every hit stretch, in turns; items: the item_ids, as sorted strings; text, if
    `texts` asks for it: `whole`, or `cut`, what is left without the hit stretches.
    """
    spark = docs.sparkSession
    pieces = over_texts(benchmark.select(F.col("item_id").cast("string").alias("item"), "text"), _pieces(n), "item string, at long, words string, k long, windows long")
    pieces = settle(pieces, "pieces")
    windows = pieces.agg(F.sum("windows")).first()[0] or 0
    parts = max(1, -(-windows // most))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.array().cast("array<long>").alias("hits"), F.array().cast("array<string>").alias("items"))
    old = None
    for i in range(parts):
        own = pieces.where(F.pmod(F.xxhash64("item", "at", "words"), F.lit(parts)) == i).select("item", "words", "k").toArrow()
        matcher = spark.sparkContext.broadcast(Matcher(list(zip(*(own.column(c).to_pylist() for c in own.column_names), strict=True)) if own.num_rows else []))
        last = i == parts - 1
        columns = "doc_id long, " + ("n_words long, n_hit long, " + "text string, " * bool(texts) if last else "text string, ") + "hits array<long>, items array<string>"
        rows = over_texts(rows, _scanned(matcher, last, texts), columns)
        if not last:
            rows = settle(rows, "scanned")
            if old is not None:
                drop(old)
            old = rows
    drop(pieces)
    return rows


def contaminated(share: float = 0.0) -> Column:
    return F.col("n_hit") > share * F.col("n_words")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, n: int = 10, spans: bool = True, share: float = 0.0, most: int = 1 << 20) -> DataFrame:
    """(doc_id, text) of `docs` without the hit stretches (`spans`), or without the documents of whose words more than `share` are hit."""
    if spans:
        return hits(docs, benchmark, n, "cut", most).select("doc_id", "text")
    return hits(docs, benchmark, n, "whole", most).where(~contaminated(share)).select("doc_id", "text")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), held AS (
  SELECT DISTINCT item_id, array_to_string(w[p:p + 9], ' ') AS g, len(w[p:p + 9]) AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)
), windows AS (SELECT DISTINCT g, k FROM held), lengths AS (SELECT DISTINCT k FROM windows), hit AS (
  SELECT r, p, k, g FROM (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, lengths)) JOIN windows USING (g, k)
), covered AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, p + unnest(range(0, k)) AS place FROM hit) GROUP BY r
), found AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT r, g, k FROM hit) JOIN held USING (g, k) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
