"""Fill-in-the-middle transformation by overlapping chunks.

A text's units are runs of A-Z and a-z, and every other character by itself. Two ranks drawn for a document say how many units come
before each cut. Texts are cut into chunks that overlap by one byte: whether a unit begins at a byte depends on that byte and the one before it alone, so
every chunk's units are counted by itself, many chunks (of many texts, or of one long one) at once. Prefix sums of the counts route both ranks
of every text to the chunks that own them, and only those are scanned again for the places. Then prefix, middle and suffix
are put in the order of the text's form.

The documents' rows are spread as Spark reads them, without a shuffle; what is drawn depends on doc_id alone, so a lost task's rows come out the same again.
Besides a batch's texts and outputs a task holds one byte a byte of them and a bounded stretch of chunks.

Behaviour: null texts count as empty; empty texts, texts that hold a sentinel, and those drawn so stay as they are (form `plain`, no cuts).
A null doc_id draws as the text `null`. Repeated rows come out alike. Ranks may be 0, equal, or the number of units: then parts are empty.
Columns other than doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.llm.shared import ints, over_texts

CHUNK, STRETCH = 1 << 14, 1 << 20
SENTINELS = ("<P>", "<S>", "<M>")
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _begins(now: np.ndarray, before: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Whether a unit begins at each byte, by the byte before it; a text's first byte always begins one."""
    return ((now & 0xC0) != 0x80) & ~(_LETTER[now] & _LETTER[before]) | head


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the spans, one span after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Chunks:
    """The chunks of a batch of texts; no chunk holds bytes of two texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK, stretch: int = STRETCH):
        self.data, self.offsets, self.stretch = data, offsets, stretch
        sizes = np.diff(offsets)
        many = -(-sizes // chunk)
        self.first = np.append(0, np.cumsum(many))
        nth = np.arange(self.first[-1]) - np.repeat(self.first[:-1], many)
        self.start = np.repeat(offsets[:-1], many) + nth * chunk
        self.size = np.minimum(chunk, np.repeat(offsets[1:], many) - self.start)
        self.head = np.zeros(len(data), dtype=bool)
        self.head[offsets[:-1][sizes > 0]] = True
        self.units = np.zeros(len(self.start), dtype=np.int64)
        for own in self._stretches(np.arange(len(self.start))):
            begun = self._scan(own)
            self.units[own] = np.add.reduceat(begun.view(np.uint8), np.cumsum(self.size[own]) - self.size[own], dtype=np.int64)
        self.upto = np.cumsum(self.units)
        before = np.append(0, self.upto)
        self.base = before[self.first[:-1]]
        self.counts = before[self.first[1:]] - self.base

    def _stretches(self, chunks: np.ndarray) -> Iterator[np.ndarray]:
        """The chunks some at a time: one at least, and no more than a stretch of bytes."""
        total = np.cumsum(self.size[chunks])
        lo = 0
        while lo < len(chunks):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + self.stretch, side="right")))
            yield chunks[lo:hi]
            lo = hi

    def _scan(self, chunks: np.ndarray) -> np.ndarray:
        at = _spans(self.start[chunks], self.size[chunks])
        return _begins(self.data[at], self.data[np.maximum(at - 1, 0)], self.head[at])

    def places(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The byte where each text's unit of that rank begins; its end for the rank after the last."""
        out = self.offsets[1:][text].copy()
        inner = np.flatnonzero(rank < self.counts[text])
        whole = self.base[text[inner]] + rank[inner]
        owner = np.searchsorted(self.upto, whole, side="right")
        asked, which = np.unique(owner, return_inverse=True)
        nth = whole - (self.upto[owner] - self.units[owner])
        order = np.argsort(which, kind="stable")
        done = 0
        for own in self._stretches(asked):
            at = _spans(self.start[own], self.size[own])[self._scan(own)]
            first = np.cumsum(self.units[own]) - self.units[own]
            mine = order[np.searchsorted(which[order], done) : np.searchsorted(which[order], done + len(own))]
            out[inner[mine]] = at[first[which[mine] - done] + nth[mine]]
            done += len(own)
        return out


def _arranged(fim: int, spm: int, sentinels: tuple[str, str, str]):
    p, s, m = (x.encode() for x in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
            chunks = Chunks(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
            h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy() for i in range(1, 5))
            n, row = chunks.counts, np.arange(len(texts))
            cuts = np.sort([h1 % (n + 1), h2 % (n + 1)], axis=0)
            a, b = (chunks.places(row, c) - offsets[:-1] for c in cuts)
            forms = np.where(h3 % 100 >= fim, "plain", np.where(h4 % 100 < spm, "spm", "psm")).tolist()
            out, prefixes, middles = [], [], []
            for i, (t, lo, hi) in enumerate(zip(texts, a.tolist(), b.tolist(), strict=True)):
                if forms[i] == "plain" or not t or p in t or s in t or m in t:
                    forms[i] = "plain"
                    parts, chars = [t], [None, None]
                else:
                    prefix, middle, suffix = t[:lo], t[lo:hi], t[hi:]
                    parts = [s, suffix, p, prefix, m, middle] if forms[i] == "spm" else [p, prefix, s, suffix, m, middle]
                    chars = [len(prefix.decode()), len(middle.decode())]
                out.append(b"".join(parts))
                prefixes.append(chars[0])
                middles.append(chars[1])
            arrays = [batch.column("doc_id"), ints(n), pa.array(forms), pa.array(prefixes, type=pa.int64()), pa.array(middles, type=pa.int64()), pa.array(out, type=pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def drawn(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 that a document draws: the first 8-digit groups of the hex SHA-256 of `seed:doc_id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, fim: int = 90, spm: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of `docs`(doc_id, text).

    `fim` of 100 documents are cut, and `spm` of 100 of those have the suffix first. `sentinels` (prefix, suffix, middle) are `<`, other characters, `>`.
    """
    if len(set(sentinels)) < 3 or not all(re.fullmatch("<[^<>]+>", x) for x in sentinels):
        raise ValueError("sentinels must be three different texts like <P>, so that none arises where two parts meet")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.select("*", *(h.alias(f"h{i + 1}") for i, h in enumerate(drawn(F.col("doc_id"), seed))))
    return over_texts(rows, _arranged(fim, spm, sentinels), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of that form was made of."""
    parts = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


ORACLE_SQL = """
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS x FROM documents
), h AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM u
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:], ''), '') AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
