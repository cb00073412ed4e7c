"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. For every adjacent pair that the ranks hold, its position is put in the bucket of that
rank; a bitmap of three levels of 64-bit words tells the least rank whose bucket is not empty by three find-first-set steps. The
bucket's positions are merged from the left, their neighbours' new pairs are put in, and entries that the list has meanwhile outgrown are
skipped when they come up. Should a new pair have a lower rank, it goes first, and what is left of the bucket is a heap from then on, which is taken
from and added to one position at a time. So a pre-token of n bytes takes O(n log n), however long it is and whatever the ranks. The new
pre-tokens of a batch share one list and one queue; short ones seen before are looked up in a bounded table.

Behaviour: null texts count as empty and have no ids. No special tokens: their strings are ordinary text. Rows are encoded each,
repeated or not, and keep their doc_id, null or not. Further columns are not read. Ids that the ranks lack cannot be decoded (an error).
"""

from __future__ import annotations

import base64
import hashlib
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.llm.shared import over_texts


class RankQueue:
    """Positions by rank. Three levels of 64-bit words say which buckets hold any."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def put(self, rank: int, positions: list[int]) -> None:
        """A new bucket."""
        self.buckets[rank] = positions
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | (1 << (rank & 63))
        self.mid[b] = self.mid.get(b, 0) | (1 << (a & 63))
        self.top |= 1 << b

    def take(self) -> tuple[int, list[int]]:
        """The least rank and its whole bucket; the bucket is gone from the queue."""
        b = (self.top & -self.top).bit_length() - 1
        m = self.mid[b]
        a = b << 6 | ((m & -m).bit_length() - 1)
        x = self.low[a]
        rank = a << 6 | ((x & -x).bit_length() - 1)
        self.low[a] = x & (x - 1)
        if not self.low[a]:
            self.mid[b] = m & (m - 1)
            if not self.mid[b]:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = 300_000, short: int = 64):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.words = {str(i): b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.two = np.full(1 << 16, -1, dtype=np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.two[token[0] << 8 | token[1]] = rank
        self.memory, self.short = memory, short
        self.known: dict[str, str] = {}

    def pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token: all stand in one linked list and one queue, and no pair crosses an edge between them."""
        ranks, size = self.ranks, self.size
        data = b"".join(pieces)
        n = len(data)
        bounds = [0, *accumulate(map(len, pieces))]
        edge = bytearray(n + 1)
        for i in bounds:
            edge[i] = 1
        end = list(range(1, n + 1))  # where the part that begins here ends; 0 once it is merged away
        before = list(range(-1, n - 1))
        queue = RankQueue()
        buckets, put, get = queue.buckets, queue.put, ranks.get
        raw = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
        first = self.two[raw[:-1] << 8 | raw[1:]]
        at = np.flatnonzero((first >= 0) & (np.frombuffer(edge, dtype=np.uint8)[1:n] == 0))
        at = at[np.argsort(first[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(first[at], prepend=-1))
        for lo, hi in pairwise([*cuts.tolist(), len(at)]):
            put(int(first[at[lo]]), at[lo:hi].tolist())
        heaps: set[int] = set()

        while queue.top:
            rank, bucket = queue.take()
            if rank in heaps:
                rest = iter(lambda: heappop(bucket) if bucket else -1, -1)  # noqa: B023
            else:
                bucket.sort()
                rest = iter(bucket)
            span = size[rank]
            for i in rest:
                mid = end[i]
                if not mid or edge[mid]:
                    continue
                stop = end[mid]
                if stop - i != span:
                    continue
                end[i] = stop
                end[mid] = 0
                lower = False
                if not edge[stop]:
                    before[stop] = i
                    r = get(data[i : end[stop]])
                    if r is not None:
                        if r not in buckets:
                            put(r, [i])
                        elif r in heaps:
                            heappush(buckets[r], i)
                        else:
                            buckets[r].append(i)
                        lower = r < rank
                if not edge[i]:
                    left = before[i]
                    r = get(data[left:stop])
                    if r is not None:
                        if r not in buckets:
                            put(r, [left])
                        elif r in heaps:
                            heappush(buckets[r], left)
                        else:
                            buckets[r].append(left)
                        lower = lower or r < rank
                if lower:  # that pair goes first
                    if rank not in heaps:
                        bucket = list(rest)  # sorted, so a heap
                        heaps.add(rank)
                    if bucket:
                        put(rank, bucket)
                    break
            else:
                heaps.discard(rank)
        out = []
        for lo, hi in pairwise(bounds):
            ids = []
            while lo < hi:
                ids.append(ranks[data[lo : end[lo]]])
                lo = end[lo]
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> list[str]:
        """Decimal ids joined by commas for each whole text."""
        split = [self.find(t) for t in texts]
        if len(self.known) >= self.memory:
            self.known.clear()
        known = self.known
        new = {p for s in split for p in s if p not in known}
        hard, long = [], {}
        for p in new:
            whole = self.ranks.get(p.encode())
            if whole is not None:
                known[p] = str(whole)
            else:
                hard.append(p)
        if hard:
            for p, ids in zip(hard, self.pieces([p.encode() for p in hard]), strict=True):
                (known if len(p) <= self.short else long)[p] = ",".join(map(str, ids))
        if long:
            known = ChainMap(long, known)
        of = known.__getitem__
        return [",".join(map(of, s)) for s in split]

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.words.__getitem__, ids.split(","))) if ids else b""


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


@lru_cache(maxsize=2)
def _encoder(data: bytes, pattern: str) -> Encoder:
    return Encoder(read_ranks(data), pattern)


def _coded(ranks, pattern: str, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                batch = whole.slice(lo, 128)
                got = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
                names = [*(c for c in batch.schema.names if c != "text"), "n_tokens", "ids_sha256", "decoded_sha256"]
                arrays = [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array([x.count(",") + bool(x) for x in got], type=pa.int64()), pa.array([sha(x.encode()) for x in got]), pa.array([sha(encoder.decode(x)) for x in got])]
                if ids:
                    names.append("ids")
                    arrays.append(pa.array([list(map(int, x.split(","))) if x else [] for x in got], type=pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def bpe(docs: DataFrame, rank_file: str, pattern: str, ids: bool = False) -> DataFrame:
    """The rows of `docs` with, in place of `text`, n_tokens, ids_sha256, decoded_sha256 (and `ids`), encoded and decoded.

    The rank file, of a fixed size of about 1 MB, is read where the job is started and sent to the tasks once.
    """
    with open(rank_file, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    schema = f"{columns}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return over_texts(docs, _coded(ranks, pattern, ids), schema)


def token_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of `docs`(doc_id, text)."""
    return bpe(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rank_file, pattern)
