import hashlib

import pytest

from copse.llm.shard_store import ShardStore, shard_digests, sharded


def docs(spark, n=200):
    rows = [(i, f"text {i} " * (i % 7), "en", f"s{i % 3}", 5) for i in range(n)] + [(None, None, None, None, None), (3, "again", "en", "s", 1), (3, "again", "en", "s", 1), (900, "x" * 200_000, "de", "s", 2)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_whole_table_comes_back(spark):
    rows, df = docs(spark)
    got = sorted(map(tuple, shard_digests(df.selectExpr("*", "1 AS name", "2 AS bytes")).collect()), key=repr)
    assert got == sorted(((r[0], r[2], r[3], r[4], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows), key=repr)


def test_tiers_merge_and_versions_hold(spark):
    _, df = docs(spark)
    store = ShardStore(spark, fanout=3, keep=10)
    parts = [df.where(f"doc_id % 9 = {i}").where("doc_id < 200") for i in range(9)]
    for p in parts[:2]:
        store.append(p)
    assert store.compact() == 0 and len(store.manifest()["runs"]) == 2
    pinned = store.manifest()["version"]
    for p in parts[2:]:
        store.append(p)
    assert store.compact() >= 1
    new = store.manifest()
    assert len(new["runs"]) < 9 and sum(r["rows"] for r in new["runs"]) == store.read().count()
    assert store.read(pinned).count() == parts[0].count() + parts[1].count()
    store.keep = 1
    store.vacuum()
    assert store.versions() == [new["version"]] and store.read().count() == sum(p.count() for p in parts)
    assert all(len(r["files"]) == 1 for r in new["runs"] if r["rows"] > 60)


def test_racing_commits_keep_both(spark):
    _, df = docs(spark, 10)
    a = ShardStore(spark)
    b = ShardStore(spark, a.root)
    raced = []

    def change(runs):
        if not raced:
            raced.append(b.append(df))
        return [*runs, run]

    run = a._write(df)
    a._commit(change)
    assert len(a.manifest()["runs"]) == 2 and a.manifest()["version"] == 2


def test_empty_and_differing_columns(spark):
    _, df = docs(spark, 5)
    assert sharded(df.where("false")).read() is None and shard_digests(df.where("false")).collect() == []
    store = ShardStore(spark)
    store.append(df.where("false"))
    assert store.manifest()["runs"] == []
    store.append(df.select("doc_id"))
    store.append(df.select("doc_id", "text"))
    assert sorted(store.read().columns) == ["doc_id", "text"] and store.read().where("text is null").count() >= 9


def test_defaults_merge_whatever_the_ids(spark):
    _, df = docs(spark)
    df = df.unionByName(df.where("doc_id = 5").selectExpr("1000000000000 AS doc_id", "text", "lang", "source", "n_chars"))
    store = sharded(df)
    assert len(store.manifest()["runs"]) <= 2 and store.read().count() == df.count()


def test_tiers_have_no_fixed_edges(spark):
    store = ShardStore(spark)
    runs = lambda *sizes: [{"name": str(i), "bytes": x} for i, x in enumerate(sizes)]
    sizes = lambda *given: [r["bytes"] for r in store._full(runs(*given))]
    edge = 16 << 20
    assert sizes(edge - 3, edge + 2, edge - 1, edge + 1, edge - 2) == [edge - 3, edge - 2, edge - 1, edge + 1, edge + 2]
    assert sizes(100, 100, 100, 390) == [] and sizes(1, 100, 110, 120, 290, 400) == [100, 110, 120, 290]


def test_two_compactors_and_a_late_one_keep_rows_once(spark):
    _, df = docs(spark, 10)
    a = ShardStore(spark, fanout=2, grace=0)
    b = ShardStore(spark, a.root, fanout=2, grace=0)
    a.append(df)
    a.append(df)
    n, old = 2 * df.count(), a.manifest()["runs"]
    one, two = a._merged(old), b._merged(old)
    assert a._replaced(old, one) and not b._replaced(old, two)
    assert a.read().count() == b.read().count() == n and len(a.manifest()["runs"]) == 1
    assert not a._fs.exists(a._path(f"{a.root}/data/{two['name']}"))


def test_vacuum_spares_appends_in_flight(spark):
    _, df = docs(spark, 10)
    store, other = ShardStore(spark, keep=1), None
    store.append(df)
    run = store._write(df)
    other = ShardStore(spark, store.root)
    other.vacuum()
    store._added(run)
    assert store.read().count() == 2 * df.count()
    late = store._write(df)
    other.grace = -1
    other.vacuum()
    with pytest.raises(RuntimeError, match="vacuumed"):
        store._added(late)
    assert store.read().count() == 2 * df.count()


def test_a_version_is_put_in_place_once(spark):
    store = ShardStore(spark)
    for put in (store._linked, store._renamed):
        done = []
        for text in ("a", "b"):
            aside, place = store._path(f"{store.root}/manifest/.{put.__name__}{text}"), store._path(f"{store.root}/manifest/{put.__name__}")
            store._fs.create(aside, False).close()
            done.append(put(aside, place))
        assert done == [True, False]
