import hashlib
import random
import time

import public_tokenizers
import pytest
import tiktoken

from copse.llm.bpe_queue import Encoder, RankQueue, bpe, read_ranks, token_digests

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    with open(FILE, "rb") as f:
        ranks = read_ranks(f.read())
    return Encoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    out = ["", " ", "\n\n  x", "hello world", "<|endoftext|>", "naïve façade 漢字 😀", "a" * 5000, "ab" * 3000, " " * 700 + "x", "!?" * 999, "\u0000\u200d"]
    for _ in range(150):
        out.append("".join(rng.choice("abc éö漢😀\n\t1.,'s<|>") for _ in range(rng.randint(0, 300))))
    return out


def test_as_the_library(both):
    mine, theirs = both
    got = mine.encode(texts())
    for t, ids in zip(texts(), got, strict=True):
        assert ids == ",".join(map(str, theirs.encode_ordinary(t))) and mine.decode(ids) == t.encode()


def test_a_lower_rank_goes_first():
    """Merging makes a pair of lower rank than the one at work; the rest of the bucket waits."""
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"abc": 299, b"cab": 298, b"abab": 301}
    theirs = tiktoken.Encoding("t", pat_str=r"[\s\S]+", mergeable_ranks=ranks | {b"zz%d" % i: 302 + i for i in range(3)}, special_tokens={}, explicit_n_vocab=None)
    mine = Encoder(ranks, r"[\s\S]+")
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("abcz") for _ in range(rng.randint(1, 40)))
        assert mine.encode([t])[0] == ",".join(map(str, theirs.encode_ordinary(t)))


def test_lower_ranks_all_along_a_long_text():
    """Each merge of the common pair makes a pair that goes first: the bucket is left 200,000 times."""
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"abc": 299}
    began = time.process_time()
    assert Encoder(ranks, r"[\s\S]+").encode(["abc" * 200_000]) == [",".join(["299"] * 200_000)]
    assert time.process_time() - began < 20


def test_queue_finds_the_least():
    q, rng = RankQueue(), random.Random(4)
    want = sorted(rng.sample(range(200_000), 500))
    for r in rng.sample(want, len(want)):
        q.put(r, [r + 2, r])
    got = []
    while q.top:
        rank, bucket = q.take()
        assert sorted(bucket) == [rank, rank + 2]
        got.append(rank)
    assert got == want


def test_table(spark, both):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(None, None, 1), (7, "twice", 1), (7, "twice", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(map(tuple, token_digests(docs, FILE, public_tokenizers.PATTERN).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t, _ in rows:
        ids = both[1].encode_ordinary(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want, key=repr)
    assert token_digests(docs.where("false"), FILE, public_tokenizers.PATTERN).collect() == []
    lists = bpe(docs.select("doc_id", "text"), FILE, public_tokenizers.PATTERN, ids=True).where("doc_id = 3").first()
    assert lists.ids == both[1].encode_ordinary("hello world")
