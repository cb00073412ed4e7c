"""Substring dedup by a log-structured fingerprint index.

Each window of `width` words is filed under its anchor: the smallest hash among the pieces of `piece` words inside it. Equal
windows have equal anchors at equal places, so an index of anchors loses no repeated window, and holds about
2 / (width - piece + 2) entries a word. The index is a set of immutable runs, each a table bucketed and sorted by anchor. A new batch
of texts becomes a run; it is merge-joined with every historical run, bucket by bucket without a shuffle, and the anchors met twice, there
or in the batch itself, are its hits. Then runs of like size are compacted by merge-joins that add their counts, so few runs are ever there.

The hits of all batches are the candidates, which are verified over the whole index in two steps: occurrences whose whole
neighbourhood (all windows of that anchor) has the same 128-bit hash are repeated throughout; of the other neighbourhoods
one each sends its windows' 128-bit hashes, and a window is repeated if its hash comes from two places. (A batch may make words of
older texts repeated; so texts are verified when results are asked for, once, and not batch by batch.)

Behaviour: null and empty texts have no words and lose none. Copies of a text count as other places, so a text of `width`
words or more that stands twice goes entirely; so do repeated rows, each row being a place of its own. doc_id may be null or
repeated: rows are told apart by doc_id and text together. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm.shared import drop, fresh_path, ints, over_texts, remove, settle
from copse.llm.words import Words, mix, runs_of, slices

WIDTH, PIECE = 35, 8
_U = np.uint64
_KEEP = _U(28)


class Anchored:
    """Anchors of a slice: for each, its hash `fp`, the first and last window that it stands for, and a hash of all their words."""

    def __init__(self, words: Words, width: int = WIDTH, piece: int = PIECE):
        h = words.hashes(0)
        self.words, self.width, self.h = words, width, h
        span = width - piece + 1
        self.lo = self.hi = np.zeros(0, dtype=np.int64)
        self.fp = self.sp = np.zeros(0, dtype=np.int64)
        if len(h) < width:
            return
        pieces, _ = words.windows(h, piece)
        n = len(h) - width + 1
        key = (pieces >> _KEEP << _KEEP) | np.arange(len(h), dtype=_U)
        least, reach = key, 1
        while reach * 2 <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[:n], least[span - reach :][:n])
        least = least[:n]
        valid = np.arange(n) + width <= np.repeat(words.first[1:], words.counts)[:n]
        at = np.flatnonzero(valid)
        if not len(at):
            return
        least, doc = least[at], np.repeat(np.arange(len(words.counts)), words.counts)[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        self.lo, self.hi, self.doc = at[first], at[last], doc[first]
        where = (least[first] & _U((1 << 28) - 1)).astype(np.int64)
        self.fp = pieces[where].view(np.int64)
        self.wide = runs_of(h, width, 7)
        self.sp = mix(mix(self.wide[self.lo]) + self.wide[self.hi] + (self.hi - self.lo).astype(_U)).view(np.int64)  # first and last window overlap

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the windows that begin at `starts`."""
        other = runs_of(self.words.hashes(5), self.width, 11)
        return self.wide[starts].view(np.int64), other[starts].view(np.int64)


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges lo..hi, and the range that each is from."""
    n = hi - lo + 1
    which = np.repeat(np.arange(len(lo)), n)
    return lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n), which


def _lists(values: list[np.ndarray], sizes: np.ndarray) -> pa.Array:
    flat = np.concatenate(values) if values else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), type=pa.int32()), pa.array(flat, type=pa.int64()))


PARTS = "doc_id long, unknown boolean, th long, n_words long, h1 long, h2 long, fps array<long>, sps array<long>"


#: What tells rows apart: doc_id (0 where it is null, which `unknown` says) and a hash of the text.
KEY = ["doc_id", "unknown", "th"]


def keyed(docs: DataFrame) -> DataFrame:
    """`KEY` and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("unknown"), F.xxhash64("text").alias("th"), "text")


def _own(batch: pa.RecordBatch, lo: int, hi: int) -> list[pa.Array]:
    return [batch.column(k).slice(lo, hi - lo) for k in KEY]


def _few(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few texts are unpacked at once; packed ones by their unpacked size."""
    for batch in batches:
        lo = 0
        if "packed" in batch.schema.names:
            sizes = np.cumsum([zstandard.frame_content_size(x) for x in batch.column("packed").to_pylist()])
        while lo < batch.num_rows:
            hi = min(lo + rows, batch.num_rows)
            if "packed" in batch.schema.names:
                hi = min(hi, max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + size, side="right"))))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _parts(width: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in slices(batch.column("text")):
                a = Anchored(words, width, piece)
                n = np.bincount(a.doc, minlength=hi - lo) if len(a.lo) else np.zeros(hi - lo, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*_own(batch, lo, hi), ints(words.counts), ints(words.whole(a.h).view(np.int64)), ints(words.whole(words.hashes(5), 3).view(np.int64)), _lists([a.fp], n), _lists([a.sp], n)],
                    names=[*KEY, "n_words", "h1", "h2", "fps", "sps"],
                )

    return run


class FingerprintIndex:
    """Runs of anchors under one folder of the shared store, each a table, bucketed and sorted by anchor, of a database of the index's own.

    Runs less than `ratio` times as large as another are merged with it after each append. `buckets`: as many as the session's shuffle
    partitions, if not given. `remove`, or the end of a `with` around the index, deletes tables, database and folder.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, width: int = WIDTH, piece: int = PIECE, ratio: int = 4, buckets: int | None = None):
        self.spark, self.root, self.width, self.piece, self.ratio = spark, root or fresh_path(spark, "fingerprints"), width, piece, ratio
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.database = f"copse_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {self.database}")
        self.parts: list[str] = []
        self.met: list[str] = []
        self.runs: list[tuple[str, int]] = []
        self.made = 0

    def _path(self, kind: str) -> str:
        self.made += 1
        return f"{self.root}/{kind}-{self.made:06d}"

    def _run(self, counts: DataFrame) -> tuple[str, int]:
        """(table, anchors) of a new run. An aggregate or a join by anchor has dealt its rows as the buckets are: one file a bucket."""
        name = f"{self.database}.run_{uuid.uuid4().hex}"
        counts.select("fp", "n").write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", self._path("run")).saveAsTable(name)
        return name, self.spark.table(name).count()

    def append(self, docs: DataFrame) -> None:
        """Adds a batch of (doc_id, text): its per-document anchors, its run of (anchor, occurrences), its hits; then compacts."""
        path = self._path("part")
        over_texts(keyed(docs), _parts(self.width, self.piece), PARTS).write.parquet(path)
        self.parts.append(path)
        part = self.spark.read.schema(PARTS).parquet(path)
        self.runs.append(self._run(part.select(F.explode("fps").alias("fp")).groupBy("fp").agg(F.count("*").alias("n"))))
        self.hits().write.parquet(path := self._path("hits"))
        self.met.append(path)
        self.compact()

    def hits(self) -> DataFrame:
        """Anchors of the newest run that it holds twice, or that a historical run holds too: the merge-join of a batch with the index."""
        new = self.spark.table(self.runs[-1][0])
        seen = new.withColumn("twice", F.col("n") >= 2)
        for run, _ in self.runs[:-1]:
            old = self.spark.table(run).select("fp", F.lit(True).alias("old")).hint("merge")
            seen = seen.join(old, "fp", "left").select("fp", (F.col("twice") | F.col("old").isNotNull()).alias("twice"))
        return seen.where("twice").select("fp")

    def compact(self) -> None:
        """Merges runs of like size, smallest first, until sizes lie `ratio` apart."""
        while True:
            self.runs.sort(key=lambda r: r[1])
            like = next((i for i in range(len(self.runs) - 1) if self.runs[i + 1][1] < self.ratio * max(self.runs[i][1], 1)), None)
            if like is None:
                return
            (a, _), (b, _) = self.runs[like : like + 2]
            other = self.spark.table(b).withColumnRenamed("n", "m").hint("merge")
            n = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
            self.runs[like : like + 2] = [self._run(self.spark.table(a).join(other, "fp", "full_outer").select("fp", n.alias("n")))]
            for old in (a, b):
                self._forget(old)

    def _forget(self, run: str) -> None:
        where = self.spark.sql(f"DESCRIBE FORMATTED {run}").where("col_name = 'Location'").first()[1]
        self.spark.sql(f"DROP TABLE {run}")
        remove(self.spark, where)

    def remove(self) -> None:
        """Deletes the whole index."""
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")
        remove(self.spark, self.root)

    def __enter__(self) -> FingerprintIndex:
        return self

    def __exit__(self, *_) -> None:
        self.remove()

    def documents(self) -> DataFrame:
        return self.spark.read.schema(PARTS).parquet(*self.parts) if self.parts else self.spark.createDataFrame([], PARTS)

    def candidates(self) -> DataFrame:
        """Anchors with two occurrences or more: the hits of all batches."""
        found = self.spark.read.schema("fp long").parquet(*self.met) if self.met else self.spark.createDataFrame([], "fp long")
        return found.distinct() if len(self.met) > 1 else found


def _windows(width: int, piece: int):
    """Windows of the asked-for neighbourhoods of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            for lo, hi, words in slices(_unpacked(batch.column("packed"))):
                a = Anchored(words, width, piece)
                if not len(a.lo):
                    continue
                asked = batch.column("asked").slice(lo, hi - lo)
                pick = _members(a, asked)
                starts, which = _spread(a.lo[pick], a.hi[pick])
                if len(starts):
                    w1, w2 = a.windows(starts)
                    doc = a.doc[pick][which]
                    own = [c.take(ints(doc)) for c in _own(batch, lo, hi)]
                    yield pa.RecordBatch.from_arrays([*own, ints(starts - words.first[doc]), ints(w1), ints(w2)], names=[*KEY, "at", "w1", "w2"])

    return run


def _members(a: Anchored, lists: pa.Array) -> np.ndarray:
    """Indexes of the anchors whose neighbourhood hash is in their own text's list."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(n)), n).astype(_U)
    salt = mix(owner + _U(1)) if len(owner) else owner
    mine = mix(a.doc.astype(_U) + _U(1)) ^ a.sp.view(_U)
    return np.flatnonzero(np.isin(mine, salt ^ flat.astype(np.int64).view(_U))) if len(flat) else np.zeros(0, dtype=np.int64)


def _packed():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in _few(batches):
            data = [press.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*_own(batch, 0, batch.num_rows), pa.array(data, type=pa.binary())], names=[*KEY, "packed"])

    return run


def pack(docs: DataFrame) -> DataFrame:
    """`KEY` and packed: texts compressed for a shuffle; null counts as empty."""
    return over_texts(keyed(docs), _packed(), "doc_id long, unknown boolean, th long, packed binary")


def _unpacked(column: pa.Array) -> pa.Array:
    press = zstandard.ZstdDecompressor()
    return pa.array([press.decompress(x).decode() for x in column.to_pylist()], type=pa.large_string())


def _kept(width: int, piece: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            column = _unpacked(batch.column("packed"))
            for lo, hi, words in slices(column):
                a = Anchored(words, width, piece)
                cover = np.zeros(len(words.start) + 1, dtype=np.int64)
                starts = np.zeros(0, dtype=np.int64)
                if len(a.lo):
                    pick = _members(a, batch.column("whole").slice(lo, hi - lo))
                    starts = _spread(a.lo[pick], a.hi[pick])[0]
                ats = batch.column("ats").slice(lo, hi - lo)
                n = ats.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                single = ats.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(words.first[:-1], n)
                starts = np.concatenate([starts, single])
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + width, -1)
                gone = np.cumsum(cover)[:-1] > 0
                copied = batch.column("copied").slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool) & (words.counts >= width)
                gone |= np.repeat(copied, words.counts)
                total = np.append(0, np.cumsum(gone))
                removed = total[words.first[1:]] - total[words.first[:-1]]
                raw = words.data.tobytes()
                out = []
                for i in range(hi - lo):
                    f, t = int(words.first[i]), int(words.first[i + 1])
                    stay = np.flatnonzero(~gone[f:t]) + f if removed[i] else np.arange(f, t)
                    out.append(b" ".join([raw[s:e] for s, e in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)]))
                arrays = [*_own(batch, lo, hi), ints(words.counts), ints(removed), pa.array([hashlib.sha256(x).hexdigest() for x in out])]
                names = [*KEY, "n_words", "n_removed", "kept_sha256"]
                if texts:
                    arrays.append(pa.array([x.decode() for x in out], type=pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def remove_repeats(docs: DataFrame, index: FingerprintIndex, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of `docs`, the documents that `index` holds.

    Text crosses the network twice, compressed: to verify candidate neighbourhoods, and to drop the words at last.
    """
    width, piece = index.width, index.piece
    parts = index.documents()
    copies = parts.groupBy("h1", "h2", "n_words").agg(F.min(F.struct(*KEY)).alias("rep"), F.count("*").alias("copies"))
    copies = settle(copies.select("h1", "h2", "n_words", "rep.*", "copies"), "copies")
    reps = parts.select(*KEY, "fps", "sps").join(copies.select(*KEY, "copies"), KEY)
    occurrences = reps.select(*KEY, "copies", F.explode(F.arrays_zip("fps", "sps")).alias("x")).select(*KEY, "copies", F.col("x.fps").alias("fp"), F.col("x.sps").alias("sp"))
    asked_for = settle(index.candidates(), "hits")  # the joins by anchor and window meet plain tables: Spark splits a very common one
    found = settle(occurrences.join(asked_for.hint("merge"), "fp"), "candidates")
    spans = settle(found.groupBy("fp", "sp").agg(F.sum("copies").alias("n"), F.min(F.struct(*KEY)).alias("rep")).select("fp", "sp", "n", "rep.*"), "spans")
    several = settle(spans.groupBy("fp").agg(F.count("*").alias("k")).where("k >= 2").select("fp"), "several")
    asked = spans.join(several, "fp", "left_semi").groupBy(*KEY).agg(F.collect_set("sp").alias("asked"))
    windows = settle(over_texts(pack(docs).join(asked, KEY), _windows(width, piece), "doc_id long, unknown boolean, th long, at long, w1 long, w2 long"), "windows")
    twice = settle(windows.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c >= 2").select("w1", "w2"), "twice")
    single = windows.join(twice, ["w1", "w2"], "left_semi").groupBy(*KEY).agg(F.collect_set("at").alias("ats"))
    whole = found.select(*KEY, "fp", "sp").join(spans.where("n >= 2").select("fp", "sp"), ["fp", "sp"], "left_semi").groupBy(*KEY).agg(F.collect_set("sp").alias("whole"))
    copied = copies.where("copies >= 2").select("h1", "h2", F.lit(True).alias("copied"))
    twins = parts.select(*KEY, "h1", "h2").join(copied, ["h1", "h2"]).groupBy(*KEY).agg(F.first("copied").alias("copied"))
    flags = settle(single.join(whole, KEY, "full_outer").join(twins, KEY, "full_outer"), "flags")
    drop(copies, asked_for, found, spans, several, windows, twice)
    ready = pack(docs).join(flags, KEY, "left").withColumn("copied", F.coalesce("copied", F.lit(False)))
    schema = "doc_id long, unknown boolean, th long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    out = over_texts(ready, _kept(width, piece, texts), schema)
    return out.withColumn("doc_id", F.when(~F.col("unknown"), F.col("doc_id"))).drop("unknown", *([] if texts else ["th"]))


def substring_dedup(docs: DataFrame, width: int = WIDTH, piece: int = PIECE, batches: int = 2, texts: bool = False) -> DataFrame:
    """Whole job: `docs`(doc_id, text) arrive in `batches` of doc_id ranges, each appended to a fresh index; then the repeats go, and the index."""
    with FingerprintIndex(docs.sparkSession, width=width, piece=piece) as index:
        low, high = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
        if low is None:
            index.append(docs)
        else:
            cuts = [low + (high - low + 1) * b // batches for b in range(1, batches)]
            batch = sum((F.when(F.col("doc_id") >= x, 1).otherwise(0) for x in cuts), F.lit(0))  # a null doc_id counts to the first
            for b in range(batches):
                index.append(docs.where(batch == b))
        return remove_repeats(docs, index, texts)
