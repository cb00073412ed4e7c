import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from copse.llm import token_alignment
from copse.llm.queries import QUERIES
from copse.llm.token_alignment import Aligned, Pair, alignment, linked, pairs

SF = Path("/root/testdata/sf0.001")
FILES = [public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def whole():
    """Both tokenizers, over whole texts."""
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    letters = token_alignment.byte_letters()

    def encode(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        good = b"".join(bytes_a) == (" " + text).encode() == b"".join(bytes_b)
        return (list(zip(ids_a, bytes_a, strict=True)), list(zip(ids_b, bytes_b, strict=True))) if text and good else ([], [])

    return encode


def brute(rows, encode):
    docs, counts = [], Counter()
    for doc, text in rows:
        a, b = encode(text or "")
        ends = []
        for tokens in (a, b):
            end, at = {}, 0
            for i, (token, raw) in enumerate(tokens):
                at += len(raw)
                end[at] = (i, token)
            ends.append(end)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for c in cuts:
            ni, nj = ends[0][c][0] + 1, ends[1][c][0] + 1
            groups.append(",".join(str(t) for t, _ in a[i:ni]) + "|" + ",".join(str(t) for t, _ in b[j:nj]))
            i, j = ni, nj
        links = [(ends[0][c][1], ends[1][c][1]) for c in cuts]
        counts.update(links)
        docs.append((doc, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = {}
    for (_, t), n in counts.items():
        most[t] = max(most.get(t, 0), n)
    return sorted(((d, na, nb, len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha) for d, na, nb, links, sha in docs), key=repr), counts


def texts():
    rng = random.Random(2)
    bits = ["a", "the", "Überraschung", "漢字", "😀", " ", "  ", "\n", "\t", " ", " ", "\u0085", "​", "᠎", "　", "\x1f", ".", "don't", "1234", "<s>", "<0x41>", "<|endoftext|>", "é", "\r\n", "!!!", "x" * 70]
    return ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(30))) for _ in range(400)] + ["", " ", "  a", "a ", "\n", "a▁b", "▁", "word " * 3000, "q" * 30_000, "漢" * 5_000]


def test_pieces_give_the_ids_of_whole_texts(whole):
    pair = Pair(*(Path(f).read_bytes() for f in FILES), memory=300, short=5)
    some = texts()
    for lo in range(0, len(some), 70):
        part = some[lo : lo + 70]
        a, n_a, b, n_b, good = pair.encode(part)
        for t, ids_a, ids_b, ok in zip(part, np.split(a, np.cumsum(n_a)[:-1]), np.split(b, np.cumsum(n_b)[:-1]), good, strict=True):
            want = whole(t)
            assert (ids_a.tolist(), ids_b.tolist()) == tuple([i for i, _ in x] for x in want), repr(t)
            assert ok == bool(want[0])


def test_alignment_against_plain_loops(spark, whole, monkeypatch):
    rows = list(enumerate(texts())) + [(None, "one two"), (3, "again and again"), (3, "again and again"), (900, None)]
    docs = spark.createDataFrame([(d, t, 5, "x") for d, t in rows], "doc_id long, text string, block int, links string").repartition(3)
    want, counts = brute(rows, whole)
    assert sorted(map(tuple, alignment(docs, *FILES).collect()), key=repr) == want
    table = pairs(*token_alignment.aligned(docs, *FILES))
    got = {(r.a, r.b): (r.n, r.best) for r in table.collect()}
    assert {k: n for k, (n, _) in got.items()} == counts
    assert all(best == (n == max(m for (_, y), m in counts.items() if y == b)) for (_, b), (n, best) in got.items())


def test_query(spark, whole):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op13_token_alignment"](spark, str(SF)).collect()), key=repr) == brute(rows, whole)[0]


def test_links_repeat_for_every_token_at_a_cut():
    left, right = linked(np.array([0, 0, 2, 3]), np.array([0, 0, 0, 1, 3]), 4)
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (3, 4)]
    x = Aligned(np.array([7, 8, 9]), np.array([1, 2]), np.array([2, 0, 1]), np.array([2, 1]), np.array([3]), np.array([2]))  # 8 has no bytes
    assert x.n_groups.tolist() == [2] and x.n_links.tolist() == [3]
    assert x.digests(2) == [hashlib.sha256(b"7,8|1;9|2").hexdigest()] == x.digests()


def test_empty_table(spark):
    assert alignment(spark.createDataFrame([], "doc_id long, text string"), *FILES).collect() == []
