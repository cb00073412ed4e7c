import hashlib
import random

from copse.llm.chat_events import PLANTED, conversation_digests, digest, messages, render

SCHEMA = "conv_id long, seq long, op string, msg long, role string, text string"


def test_fold_of_events(spark):
    log = [
        (1, 1, "message", 1, "user", "hi"),
        (1, 2, "message", 2, "assistant", ""),
        (1, 4, "delta", 2, None, "lo"),
        (1, 3, "delta", 2, None, "hel"),
        (1, 5, "regenerate", 2, None, None),
        (1, 6, "delta", 2, None, "new "),
        (1, 7, "delta", 2, None, "text"),
        (1, 8, "edit", 1, None, "hi there"),
        (1, 9, "message", 3, "user", "gone"),
        (1, 10, "delete", 3, None, None),
        (2, 1, "delta", 1, "assistant", "unopened"),
        (None, 1, None, None, None, None),
        (3, 1, "message", 1, "user", "same"),
        (3, 1, "message", 1, "user", "same"),
    ]
    got = sorted(((r.conv_id, r.no, r.role, r.text) for r in messages(spark.createDataFrame(log, SCHEMA)).collect()), key=repr)
    want = [(1, 1, "user", "hi there"), (1, 2, "assistant", "new text"), (2, 1, "assistant", "unopened"), (None, 1, "", ""), (3, 1, "user", "same"), (3, 2, "user", "same")]
    assert got == sorted(want, key=repr)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_read_back(spark):
    rng = random.Random(6)
    bits = ["\\", "<", "#", "### user: ", " </turn>\n", "</turn>", "\\h", "\\b", "\\l", "a", "é😀", "\n", ":", ": ", ""]
    rows = []
    for conv in range(12):
        for turn in range(rng.choice([1, 3, 200 if conv == 0 else 5])):
            rows.append((conv, turn, rng.choice(["user", "assistant", "a: #<\\", ""]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))))
    rows += [(50, 1, "user", None), (50, 2, None, "x"), (50, 2, None, "x"), (50, None, "assistant", "first"), (51, 1, "assistant", "long " * 20000), (None, 1, "assistant", "z")]
    table = spark.createDataFrame([(*r, "y", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, piece int")
    got = {r.conv_id: r for r in conversation_digests(table).collect()}
    rows += [(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)]
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_mask_spans_and_no_marks_inside(spark):
    log = [(1, 1, "message", 1, "user", PLANTED), (1, 2, "message", 2, "assistant", PLANTED)]
    row = render(messages(spark.createDataFrame(log, SCHEMA))).first()
    assert row.formatted.count("### ") == 2 and row.formatted.count("</turn>") == 2
    (start, size), = row.mask
    assert row.formatted[start - 1 : start - 1 + size].replace("\\h", "#").replace("\\l", "<").replace("\\b", "\\") == PLANTED


def test_empty_log(spark):
    assert digest(render(messages(spark.createDataFrame([], SCHEMA)))).collect() == []
