import random

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from copse.llm.bpe_queue import read_ranks
from tests.llm.test_chosen_path import brute as groups
from tests.llm.test_substring_dedup import brute as repeats


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    text = lambda n: [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(3000)) for _ in range(n)]
    passage = text(60)
    docs, labels = [], []
    for i in range(400):
        w = text(rng.randint(20, 90))
        toxic = i % 5 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["vilename", "badword"])
        elif i % 10 == 1:
            w = w[:10] + passage + w[10:]
        low = i % 4 == 2
        if low:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w), "en", "s", None))
        if i < 300:
            labels.append((i, int(not low), int(toxic)))
    clean = [d for d in docs if d[0] % 5 not in (0, 1)]
    for j in range(20):
        docs.append((1000 + j, clean[j][1], "en", "s", None))
        w = clean[j + 20][1].split()
        w[3] = "changed"
        docs.append((2000 + j, " ".join(w), "en", "s", None))
    docs += [(3000, None, None, None, None), (3001, "", "en", "s", 0), (None, "one two three", "en", "s", 3), (7777, "same row", "en", "s", 8), (7777, "same row", "en", "s", 8), (7777, "other text", "en", "s", 8)]
    docs = [(*d[:4], len(d[1] or ""), 1) for d in docs]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, kept int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), docs


def test_stages(spark, folder):
    path, rows = folder
    df = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, path)
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{path}/out-{name}.parquet")
        df = spark.read.parquet(f"{path}/out-{name}.parquet")
        kept[name] = df.collect()
    bad = {r[0] for r in rows if r[1] and ("vilename" in r[1].lower() or "badword" in r[1].lower())}
    assert {r.doc_id for r in kept["toxicity"]} == {r[0] for r in rows} - bad

    pairs = [(r.doc_id, r.text) for r in kept["toxicity"]]
    want = {d for d, low, _ in groups(pairs) if d == low}
    got = [r.doc_id for r in kept["near_copies"]]
    assert set(got) == want and len(got) == len(want) + 1  # 7777 has two texts
    assert 1000 not in got

    judged = {}
    for d, n, removed, sha in repeats([(r.doc_id, r.text) for r in kept["near_copies"]], 35):
        judged.setdefault(d, []).append(n - removed)
    assert len(kept["repeated_passages"]) == len(got)
    for r in kept["repeated_passages"]:
        assert len((r.text or "").split()) in judged[r.doc_id] and (r.text is None or r.doc_id in (None, 7777) or r.n_chars == len(r.text))
    assert sum(len((r.text or "").split()) for r in kept["repeated_passages"]) < sum(len((r.text or "").split()) for r in kept["near_copies"]) - 1500

    texts = lambda name: {(r.doc_id, r.text) for r in kept[name]}
    assert texts("mixing") == texts("repeated_passages") and len(kept["mixing"]) >= len(kept["repeated_passages"])
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(f.read()), special_tokens={})
    want = sorted(((r.doc_id or -1, theirs.encode_ordinary(r.text or "")) for r in kept["mixing"]))
    assert sorted((r.doc_id or -1, r.ids) for r in kept["tokens"]) == want


def test_run_gives_the_same_documents(spark, folder):
    path, _ = folder
    got = {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, path).collect()}
    assert got == {(r.doc_id, tuple(r.ids)) for r in spark.read.parquet(f"{path}/out-tokens.parquet").collect()}


def test_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_one_near_copy_stays_whatever_the_ids(spark):
    words = lambda name, *changed: " ".join("changed" if j in changed else f"{name}{j}" for j in range(80))
    rows = [(None, words("a")), (None, words("a", 3)), (None, words("a").replace(" ", "  "))]
    rows += [(5, words("b")), (5, words("b", 40)), (5, words("b", 40)), (8, words("b", 79))]
    rows += [(None, words("c")), (9, words("c", 2)), (10, words("c", 2)), (5, words("d")), (11, words("e")), (11, words("e")), (12, None), (13, None), (None, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, (r.text or "").split(" ")[0]) for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted([(None, "a0"), (5, "b0"), (9, "c0"), (5, "d0"), (11, "e0"), (12, ""), (13, ""), (None, "")], key=repr)
