"""Cross-tokenizer alignment: where two tokenizers' tokens end together, and which ids are linked how often over the corpus.

Tokenizer A is a byte-level BPE, B a BPE of pieces with byte fallback that puts a space before the text; A gets that space too, so both cover the same bytes.
Running sums of the tokens' byte lengths are their ends; ends that A and B share are the common cuts, and the place of an end among them
is a token's group. Links are made by repeating each A token once for each B token that ends at its cut. All this is done for a batch of texts at once, as one
stretch of bytes: every text's end is a common cut.

Texts are encoded in pieces: neither tokenizer joins across a space that stands between two other characters (white space of any kind apart), so the
ids of a piece, once made, are looked up. Long pieces, and those beyond a bounded table, are encoded each time.

How often ids are linked: rows are cut into blocks of about `BLOCK` bytes of text; each block sends each of its pairs once, with a count. Pairs are summed
in two stages, first with a salt, then without, so a pair that every block holds is spread; the highest count of a B id is a table of B's vocabulary at most, which is
broadcast. The counts go back to the blocks that hold the pair, not to each document, and a block's rows look them up.

Behaviour: null and empty texts, and texts whose bytes a tokenizer does not give back, have no tokens: zeros, and an empty digest. Rows keep their doc_id, null or
repeated; repeated rows are counted each. Columns other than doc_id and text are not read. An empty table gives no rows. One text's tokens are in
memory at once. Special tokens are ordinary text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.llm.shared import drop, groups, ints, over_texts, settle
from copse.llm.words import places

BLOCK, SLICE, SALTS = 8 << 20, 1 << 18, 16
#: Characters that some definition of white space, or none, may count as such; a space before one is no place to cut.
_BLANK = r"\s\x00-\x20\x7f-\xa0" + "".join(f"{chr(a)}-{chr(b)}" for a, b in [(0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x206F), (0x2581, 0x2581), (0x3000, 0x3000), (0xFEFF, 0xFEFF)])
_WORD = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]{1,48})([!-&(-/:-@[-`{-~]{0,16})")  # letters, then signs without the apostrophe
_MARK = chr(0x2581)  # what B writes a space as
_CUT, _NO_CUT = re.compile(f"(?<=[^ {_MARK}]) (?=[^{_BLANK}])"), re.compile(f" [{_BLANK}]")


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return places(sizes) + np.repeat(starts, sizes)


def split(text: str) -> list[str]:
    """The pieces of a text; each stands for itself with a space before it."""
    if text[0] == " " or text[-1] == " " or _MARK in text or _NO_CUT.search(text):
        return _CUT.split(text)
    return text.split(" ")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: visible ones themselves, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, and the ids of pieces seen before."""

    def __init__(self, a: bytes, b: bytes, memory: int = 100_000, short: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        letters = byte_letters()
        names = sorted(self.a.get_vocab().items(), key=lambda x: x[1])
        self.bytes_a = {i: bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode() for name, i in names}
        self.bytes_b = {i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(_MARK, " ").encode() for i in range(self.b.vocab_size())}
        self.size_a, self.size_b = (np.array([len(x.get(i, b"")) for i in range(max(x) + 1)], dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        inner = re.compile(f"[^{_MARK}]{_MARK}")
        self.whole = any(inner.search(self.b.id_to_piece(i)) for i in range(self.b.vocab_size()))  # then pieces of B may cross the cuts
        self.merge = self._merges(json.loads(a))
        self.memory, self.short = memory, short
        self._clear()

    def _merges(self, file: dict):
        """A's merges of one word, by the ids' order; none, if A's file does not merge in that order or writes bytes or words otherwise."""
        model, steps = file["model"], file.get("pre_tokenizer") or {}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        made = [model["vocab"].get("".join(m), -1) for m in pairs]
        plain = steps.get("type") == "ByteLevel" and not steps.get("add_prefix_space") and not file.get("normalizer") and not model.get("dropout")
        if model.get("type") != "BPE" or not plain or any(x >= y for x, y in pairwise(made)) or made and made[0] < 256:
            return None
        import tiktoken

        ranks = {self.bytes_a[i]: i for i in sorted({*(model["vocab"][c] for c in byte_letters()), *made})}
        return tiktoken.Encoding("words", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool))

    def _of_a(self, pieces: list[str]) -> list[list[int]]:
        """A's ids of each piece. Letters, and signs behind them, which any reading of A's pattern parts just there, go straight to the merges, by rank; all others go through A itself."""
        out: list = [None] * len(pieces)
        if self.merge:
            merge = self.merge
            for i, m in enumerate(map(_WORD.fullmatch, pieces)):
                if m:
                    out[i] = merge(" " + m[1]) + merge(m[2]) if m[2] else merge(" " + m[1])
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.a.encode_batch_fast([f" {pieces[i]}" for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, ...]:
        """A's ids and their number for each piece, B's, and whether both give the piece's bytes back."""
        a = self._of_a(pieces)
        b = self.b.encode(pieces, num_threads=1)
        flat = lambda lists: np.fromiter(chain.from_iterable(lists), dtype=np.int32)
        sizes = lambda lists: np.fromiter(map(len, lists), dtype=np.int64)
        made = flat(a), sizes(a), flat(b), sizes(b)
        said = [f" {p}".encode(errors="replace") for p in pieces]
        whole, length, owner = b"".join(said), sizes(said), np.arange(len(pieces))
        good = np.ones(len(pieces), dtype=bool)
        for ids, n, lists, of, size in ((made[0], made[1], a, self.bytes_a, self.size_a), (made[2], made[3], b, self.bytes_b, self.size_b)):
            same = (np.bincount(np.repeat(owner, n), size[ids], len(pieces)) == length).all()
            if not same or b"".join(map(of.__getitem__, ids.tolist())) != whole:  # then piece by piece
                good &= np.array([b"".join(map(of.__getitem__, x)) == t for x, t in zip(lists, said, strict=True)])
        return *made, good

    def encode(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(A's ids, A's number of ids a text, B's ids, B's number, whether the text's bytes come back); a text without has no ids."""
        parts = [([t] if self.whole else split(t)) if t else [] for t in texts]
        if len(self.known) >= self.memory:
            self._clear()
        new = {p for s in parts for p in s if p not in self.known}
        short, long = [p for p in new if len(p) <= self.short], [p for p in new if len(p) > self.short]
        if short:
            self.known.update(zip(short, range(len(self.table[1]), len(self.table[1]) + len(short)), strict=True))
            self.table = self._more(short)
        table, at = self.table, self.known
        if long:
            at = ChainMap(dict(zip(long, range(len(table[1]), len(table[1]) + len(long)), strict=True)), at)
            table = self._more(long)
        piece = np.fromiter((at[p] for s in parts for p in s), dtype=np.int64)
        n = np.array([len(s) for s in parts], dtype=np.int64)
        bad = np.bincount(np.repeat(np.arange(len(n)), n), ~table[4][piece], len(n)) if len(piece) else np.zeros(len(n))
        good = (n > 0) & (bad == 0)
        piece, owner = piece[np.repeat(good, n)], np.repeat(np.arange(len(n)), n)[np.repeat(good, n)]
        out = []
        for ids, sizes in (table[0:2], table[2:4]):
            first = np.cumsum(sizes) - sizes
            out += [ids[_spans(first[piece], sizes[piece])], np.bincount(owner, sizes[piece], len(n)).astype(np.int64)]
        return *out, good

    def _more(self, pieces: list[str]) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(self.table, self._encoded(pieces), strict=True))


def linked(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a place in `left` and one in `right` of the same label; both hold labels below n in order."""
    count = np.bincount(right, minlength=n)
    many = count[left]
    return np.repeat(np.arange(len(left)), many), _spans((np.cumsum(count) - count)[left], many)


class Aligned:
    """Groups and links of a batch of texts, by both tokenizers' ids (`a`, `b`), their byte lengths, and how many of them each text has."""

    def __init__(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        distinct = bool((size_a > 0).all() and (size_b > 0).all())
        cuts = np.intersect1d(end_a, end_b, assume_unique=distinct)
        self.of_a, self.of_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        text_a, text_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        self.text_of = np.zeros(len(cuts), dtype=np.int64)
        self.text_of[self.of_a] = text_a
        self.n_groups = np.bincount(self.text_of, minlength=len(n_a))
        last_a, last_b = np.flatnonzero(cuts[self.of_a] == end_a), np.flatnonzero(cuts[self.of_b] == end_b)
        left, right = linked(self.of_a[last_a], self.of_b[last_b], len(cuts))
        self.link_a, self.link_b = last_a[left], last_b[right]
        self.n_links = np.bincount(text_a[self.link_a], minlength=len(n_a))
        self.text_a, self.text_b = text_a, text_b

    def digests(self, stretch: int = 1 << 18) -> list[str]:
        """SHA-256 of each text's groups, as `a1,a2|b1;a3|b2,b3`; empty for a text without tokens."""
        groups_ = len(self.text_of)
        held_a, held_b = np.bincount(self.of_a, minlength=groups_), np.bincount(self.of_b, minlength=groups_)
        upto_a, upto_b = np.cumsum(held_a), np.cumsum(held_b)
        n = len(self.a) + len(self.b)
        ids, mark, text = np.empty(n, dtype=np.int64), np.full(n, ord(","), dtype=np.uint8), np.empty(n, dtype=np.int64)
        at_a = np.arange(len(self.a)) + (upto_b - held_b)[self.of_a]  # B's tokens of the groups before stand before them
        at_b = np.arange(len(self.b)) + upto_a[self.of_b]
        ids[at_a], ids[at_b], text[at_a], text[at_b] = self.a, self.b, self.text_a, self.text_b
        mark[at_a[upto_a - 1]], mark[at_b[upto_b - 1]] = ord("|"), ord(";")
        ends = np.cumsum(self.n_a + self.n_b)
        some = self.n_a + self.n_b > 0
        mark[ends[some] - 1] = 0
        width = len(str(int(ids.max()))) if n else 1
        shas = [hashlib.sha256() if x else None for x in some]
        for lo in range(0, n, stretch):
            x, m, t = ids[lo : lo + stretch], mark[lo : lo + stretch], text[lo : lo + stretch]
            digits = np.ones(len(x), dtype=np.int64)
            for k in range(1, width):
                digits += x >= 10**k
            grid = np.zeros((len(x), width + 1), dtype=np.uint8)
            for k in range(width):  # the k-th digit from the left
                power = 10 ** np.maximum(digits - 1 - k, 0)
                grid[:, k] = np.where(k < digits, 48 + x // power % 10, 0)
            grid[np.arange(len(x)), digits] = m
            data = grid[grid > 0].tobytes()
            sizes = np.cumsum(digits + (m > 0))
            cut = np.flatnonzero(np.diff(t)) + 1
            for first, last in zip(np.append(0, cut), np.append(cut, len(t)), strict=True):
                shas[t[first]].update(data[sizes[first - 1] if first else 0 : sizes[last - 1]])
        return [x.hexdigest() if x else "" for x in shas]


@lru_cache(maxsize=2)
def _pair(a: bytes, b: bytes) -> Pair:
    return Pair(a, b)


def _kind(pair: Pair) -> type:
    """The type of a pair's code, a * (size of B's vocabulary) + b."""
    return np.uint32 if len(pair.size_a) * len(pair.size_b) <= 1 << 32 else np.int64


ROWS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def _rows(files):
    """A row a document: its figures, and its links as codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*files.value)
        wide, kind, done = len(pair.size_b), _kind(pair), 0
        task = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            upto = np.cumsum([len(t) for t in texts])
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SLICE, side="right")))
                a, n_a, b, n_b, _ = pair.encode(texts[lo:hi])
                x = Aligned(a, b, pair.size_a[a], pair.size_b[b], n_a, n_b)
                codes = (x.a[x.link_a].astype(np.int64) * wide + x.b[x.link_b]).astype(kind).tobytes()
                at = np.dtype(kind).itemsize * np.append(0, np.cumsum(x.n_links))
                links = [codes[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ints(np.full(hi - lo, task | done // BLOCK)), batch.column("doc_id").slice(lo, hi - lo), ints(n_a), ints(n_b), ints(x.n_groups), ints(x.n_links), pa.array(x.digests()), pa.array(links, type=pa.binary())], names=["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])
                done += int(upto[hi - 1] - (upto[lo - 1] if lo else 0))
                lo = hi

    return run


def _links(lists: list[bytes], n_links: np.ndarray) -> np.ndarray:
    """The codes of several rows' links; their size tells their type."""
    data = b"".join(lists)
    return np.frombuffer(data, dtype=np.uint32 if len(data) == 4 * n_links.sum() else np.int64).astype(np.int64)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's pairs, once a batch, with their number."""
    for batch in batches:
        block, many = batch.column("block").to_numpy(), batch.column("n_links").to_numpy()
        lists = batch.column("links").to_pylist()
        for own in np.unique(block):
            at = np.flatnonzero(block == own)
            pairs, n = np.unique(_links([lists[i] for i in at], many[at]), return_counts=True)
            yield pa.RecordBatch.from_arrays([ints(np.full(len(pairs), own)), ints(pairs), ints(n)], names=["block", "pair", "n"])


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's links, looked up among its block's counts."""
    for _, rows in groups(batches, ["block"]):
        count = rows.filter(rows.column("pair").is_valid())
        docs = rows.filter(rows.column("pair").is_null()).combine_chunks()
        if not docs.num_rows:
            continue
        pairs = count.column("pair").to_numpy()
        order = np.argsort(pairs)
        pairs, n, best = pairs[order], count.column("n").to_numpy()[order], count.column("best").to_numpy(zero_copy_only=False)[order]
        for lo in range(0, docs.num_rows, 1024):
            part = docs.slice(lo, 1024)
            links = _links(part.column("links").to_pylist(), part.column("n_links").to_numpy())
            at = np.searchsorted(pairs, links)
            ends = np.append(0, np.cumsum(part.column("n_links").to_numpy()))
            sums = lambda x: np.diff(np.append(0, np.cumsum(x))[ends])  # noqa: E731, B023
            kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
            yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in kept), ints(sums(best[at].astype(np.int64))), ints(sums(n[at])), part.column("groups_sha256").combine_chunks()], names=[*kept, "n_best", "count_sum", "groups_sha256"])


def aligned(docs: DataFrame, file_a: str, file_b: str) -> tuple[DataFrame, int]:
    """`ROWS` of every row of `docs`(doc_id, text), written once, and the size of B's vocabulary, which pairs are coded by.

    The tokenizers' files, of a fixed size of a few MB, are read where the job is started and sent to the tasks once.
    """
    with open(file_a, "rb") as a, open(file_b, "rb") as b:
        files = a.read(), b.read()
    sent = docs.sparkSession.sparkContext.broadcast(files)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return settle(over_texts(rows, _rows(sent), ROWS), "aligned"), len(_pair(*files).size_b)


def pairs(rows: DataFrame, wide: int, held: DataFrame | None = None) -> DataFrame:
    """(a, b, pair, n, best): how many links of the corpus hold an id pair linked, and whether no other pair of its B id has more."""
    held = blocks(rows) if held is None else held
    salted = held.groupBy("pair", F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    counts = settle(salted.groupBy("pair").agg(F.sum("n").alias("n")), "counts").withColumn("b", F.col("pair") % wide)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of B
    counts = counts.join(F.broadcast(most), "b")
    return counts.select(F.floor(F.col("pair") / wide).alias("a"), "b", "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def blocks(rows: DataFrame) -> DataFrame:
    """(block, pair, n): the links of each block, counted."""
    return over_texts(rows.select("block", "n_links", "links"), _held, "block long, pair long, n long").groupBy("block", "pair").agg(F.sum("n").alias("n"))


def alignment(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of `docs`(doc_id, text).

    n_best: links whose pair no other pair of the same B id exceeds; count_sum: the pairs' numbers, summed over the links.
    """
    rows, wide = aligned(docs, file_a, file_b)
    held = settle(blocks(rows), "held")
    rated = settle(pairs(rows, wide, held).select("pair", "n", "best"), "rated")
    found = held.select("block", "pair").join(rated, "pair").select("block", "pair", "n", "best")
    both = rows.unionByName(found, allowMissingColumns=True).repartition("block").sortWithinPartitions("block")
    out = settle(both.mapInArrow(_looked_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"), "aligned_rows")
    drop(rows, held, rated)
    return out
