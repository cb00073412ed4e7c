"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards, a run of Parquet files each. Runs that are less than
3/4 `fanout` times as large as the smallest of them form a tier; once a tier has `fanout` runs they are merged into files of about `target` bytes, by reading several old files into
one new (no shuffle, no rewriting of larger runs). What the store holds is said by a manifest alone: a JSON file per version,
written aside and put in place by an operation that fails if that version exists (a hard link on local disks, elsewhere a rename that
does not overwrite, atomic on HDFS; stores that have neither need a single writer), so a commit is whole or absent. A writer that
loses the race reads the newer manifest and tries again; a compaction whose runs that manifest has no longer is given up and its files go.
Readers pin a version. `vacuum` removes manifests older than the last `keep` and the runs that only those name; runs that no manifest
names yet may be an append in flight, and stay for `grace` seconds. An append that takes longer from its first file to its commit finds its files gone and fails.

Behaviour: empty arrivals add no run. Columns, nulls and repeated rows are kept as they come; arrivals may lack columns that others have
(nulls then). A job that dies leaves files that no manifest names. Folder and manifest live where Spark's file systems reach.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm.shared import fresh_path


class ShardStore:
    def __init__(self, spark: SparkSession, root: str | None = None, target: int = 128 << 20, fanout: int = 4, keep: int = 1, grace: float = 86_400):
        self.spark, self.root, self.target, self.fanout, self.keep, self.grace = spark, (root or fresh_path(spark, "shards")).rstrip("/"), target, fanout, keep, grace
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "runs": [{"name", "bytes", "rows", "files"}]}; version 0 is the empty store."""
        found = self.versions()
        version = version if version is not None else (found[-1] if found else 0)
        if not version:
            return {"version": 0, "runs": []}
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version:09d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _linked(self, aside, place) -> bool:
        try:
            os.link(aside.toUri().getPath(), place.toUri().getPath())
        except FileExistsError:
            return False
        return True

    def _renamed(self, aside, place) -> bool:
        """A rename without the option to overwrite."""
        hadoop = self._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        options[0] = getattr(hadoop, "Options$Rename").NONE
        files = hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(self._fs.makeQualified(aside), self._fs.makeQualified(place), options)
        except Exception:
            if self._fs.exists(place):
                return False
            raise
        return True

    def _commit(self, change) -> dict | None:
        """Applies `change` to the newest manifest's runs and commits the result as the next version, again if another came first.

        None if `change` gives None: what it wanted to change is no longer there.
        """
        while True:
            old = self.manifest()
            runs = change(old["runs"])
            if runs is None:
                return None
            new = {"version": old["version"] + 1, "runs": runs}
            aside, place = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest/v{new['version']:09d}.json")
            out = self._fs.create(aside, False)
            out.write(bytearray(json.dumps(new).encode()))
            out.close()
            try:
                if (self._linked if self._fs.getUri().getScheme() == "file" else self._renamed)(aside, place):
                    return new
            finally:
                self._fs.delete(aside, False)

    def _write(self, df: DataFrame) -> dict | None:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/data/{name}")
        files = [s for s in self._fs.listStatus(self._path(f"{self.root}/data/{name}")) if s.getPath().getName().startswith("part-")]
        rows = self.spark.read.parquet(f"{self.root}/data/{name}").count() if files else 0
        if not rows:
            self._fs.delete(self._path(f"{self.root}/data/{name}"), True)
            return None
        return {"name": name, "rows": rows, "bytes": sum(int(s.getLen()) for s in files), "files": sorted(s.getPath().getName() for s in files)}

    def append(self, df: DataFrame) -> None:
        """One arrival as a run of its own."""
        if run := self._write(df):
            self._added(run)

    def _added(self, run: dict) -> None:
        def change(runs: list[dict]) -> list[dict]:
            if not all(self._fs.exists(self._path(f"{self.root}/data/{run['name']}/{f}")) for f in run["files"]):
                raise RuntimeError(f"the files of {run['name']} were vacuumed before they were committed")
            return [*runs, run]

        self._commit(change)

    def _full(self, runs: list[dict]) -> list[dict]:
        """The runs of the lowest tier that is full. Sizes are compared with each other; what a tier was merged into is beyond it."""
        runs = sorted(runs, key=lambda r: r["bytes"])
        for i, least in enumerate(runs):
            tier = [r for r in runs[i:] if 4 * r["bytes"] <= 3 * self.fanout * max(least["bytes"], 1)]
            if len(tier) >= self.fanout:
                return tier
        return []

    def compact(self) -> int:
        """Merges tiers that are full until none is; returns how many merges it made."""
        merges = 0
        while old := self._full(self.manifest()["runs"]):
            merges += self._replaced(old, self._merged(old))
        return merges

    def _merged(self, old: list[dict]) -> dict:
        size = sum(r["bytes"] for r in old)
        return self._write(self._read(old).coalesce(max(1, math.ceil(size / self.target))))

    def _replaced(self, old: list[dict], merged: dict) -> bool:
        """Commits a merged run for its old ones; if another writer replaced any of these meanwhile, the merged run is discarded."""
        names = {r["name"] for r in old}

        def change(runs: list[dict]) -> list[dict] | None:
            left = [r for r in runs if r["name"] not in names]
            return [*left, merged] if len(left) == len(runs) - len(names) else None

        if self._commit(change):
            return True
        self._fs.delete(self._path(f"{self.root}/data/{merged['name']}"), True)
        return False

    def _read(self, runs: list[dict]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.root}/data/{r['name']}" for r in runs))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of that version, None for an empty store."""
        runs = self.manifest(version)["runs"]
        return self._read(runs) if runs else None

    def vacuum(self) -> None:
        """Removes old manifests and the runs that only those name, and runs without any manifest that are older than `grace`."""
        found = self.versions()
        named = {v: {r["name"] for r in self.manifest(v)["runs"]} for v in found}
        needed = set().union(*(named[v] for v in found[-self.keep :]))
        past = set().union(*named.values()) - needed
        data, now = self._path(f"{self.root}/data"), time.time()
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = s.getPath().getName()
            if name in past or (name not in needed and now - self._changed(s) > self.grace):
                self._fs.delete(s.getPath(), True)
        for v in found[: -self.keep]:
            self._fs.delete(self._path(f"{self.root}/manifest/v{v:09d}.json"), False)

    def _changed(self, run) -> float:
        """When a run's folder or a file in it was written last."""
        inside = self._fs.listStatus(run.getPath()) if run.isDirectory() else []
        return max(x.getModificationTime() for x in [run, *inside]) / 1000


def arrivals(docs: DataFrame, n: int) -> list[DataFrame]:
    """`docs` as they would arrive: `n` parts even in rows, by a hash of doc_id and text."""
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))
    return [docs.where(part == i) for i in range(n)]


def sharded(docs: DataFrame, n: int = 5, target: int = 128 << 20, fanout: int = 4) -> ShardStore:
    """A store that `docs` reached in `n` arrivals, compacted and vacuumed after each."""
    store = ShardStore(docs.sparkSession, target=target, fanout=fanout)
    for part in arrivals(docs, n):
        store.append(part)
        if store.compact():
            store.vacuum()
    return store


def shard_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_chars, text_sha256) of every row, read back through the newest manifest."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    back = sharded(docs.select(*cols)).read()
    back = docs.select(*cols).where("false") if back is None else back
    return back.select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE_SQL = "SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents"
