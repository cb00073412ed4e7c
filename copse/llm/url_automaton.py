"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed, one bit a literal character and one for each rule's start, into Shift-And masks of as many 64-bit
words as they need. One step a character moves every rule of every URL of a batch at once:

    state = ((state << 1) & match[c]) | (state & stay[c])

where `match[c]` marks the positions that the byte c fits and `stay[c]` those followed by a wildcard that c may extend. In a rule,
`*` stands for any bytes but `/`, `**` for any bytes, `?` for one byte but `/`; the rest is literal. Rules are matched against a
canonical URL: a dot, the lower-case host, the path, so `*.org/**` is the host org and its subdomains, with any path.

Behaviour: a null url, and one without `://`, has an empty host and path, fits no rule and gets the default verdict. Of the rules
that fit, the longest text wins, then the smaller text. Fragments and query strings never count. Repeated rows are judged each;
rows keep their page_id, null or not; further columns are not read. An empty table, or no rules, needs no special care.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64
#: Verdict and rule (host, path), as the query's contract states them.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Further globs of the method itself, without a rule's name: what no rule fits is blocked if one of these does.
GLOBS = ["**/ads/**", "**/login**"]


#: So few texts that still run, the very long ones, are quicker one by one.
FEW = 8


@dataclass(frozen=True)
class Automaton:
    """`match`, `stay`: (256, words); `first`: (words,); `last`: each rule's final word and bit."""

    match: np.ndarray
    stay: np.ndarray
    first: np.ndarray
    last: list[tuple[int, int]]

    @staticmethod
    def of(globs: list[str]) -> Automaton:
        cells: list[tuple[set[int], set[int]]] = []  # bytes that lead to a position, bytes that stay there
        starts, last = [], []
        every, within = set(range(256)), set(range(256)) - {0x2F}
        for glob in globs:
            starts.append(len(cells))
            cells.append((set(), set()))
            data, i = glob.encode(), 0
            while i < len(data):
                if data[i : i + 2] == b"**":
                    cells[-1][1].update(every)
                    i += 2
                    continue
                if data[i : i + 1] == b"*":
                    cells[-1][1].update(within)
                else:
                    cells.append((set(within) if data[i : i + 1] == b"?" else {data[i]}, set()))
                i += 1
            last.append(divmod(len(cells) - 1, 64))
        words = max(1, -(-len(cells) // 64))
        match, stay, first = (np.zeros((256, words), dtype=_U) for _ in range(3))
        for p, (to, at) in enumerate(cells):
            for table, chars in ((match, to), (stay, at)):
                for c in chars:
                    table[c, p // 64] |= _U(1 << (p % 64))
        for p in starts:
            first[0, p // 64] |= _U(1 << (p % 64))
        return Automaton(match, stay, first[0], last)

    def run(self, texts: list[bytes]) -> np.ndarray:
        """Which rules (columns) fit each whole text (rows). Texts go longest first, so those still running are a prefix."""
        n = len(texts)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        data = np.frombuffer(b"".join(texts[i] for i in order), dtype=np.uint8)
        begin = np.append(0, np.cumsum(size))[:-1]
        state = np.tile(self.first, (n, 1))
        live, at = n, 0
        for at in range(int(size[0]) if n else 0):
            live = int(np.searchsorted(-size[:live], -at, side="left"))
            if live <= FEW:
                break
            c = data[begin[:live] + at]
            s = state[:live]
            moved = s << _U(1)
            moved[:, 1:] |= s[:, :-1] >> _U(63)
            state[:live] = (moved & self.match[c]) | (s & self.stay[c])
        for i in range(live if n and live <= FEW else 0):
            state[i] = self._alone(state[i], data[begin[i] + at : begin[i] + size[i]].tobytes())
        fits = np.zeros((n, len(self.last)), dtype=bool)
        for r, (w, b) in enumerate(self.last):
            fits[order, r] = (state[:, w] >> _U(b)) & _U(1) == 1
        return fits


    def _alone(self, state: np.ndarray, text: bytes) -> np.ndarray:
        """The same steps for one text, all words as one integer."""
        match, stay = ([int.from_bytes(row.tobytes(), "little") for row in t] for t in (self.match, self.stay))
        now = int.from_bytes(state.tobytes(), "little")
        for c in text:
            now = ((now << 1) & match[c]) | (now & stay[c])
        return np.frombuffer(now.to_bytes(8 * len(state), "little"), dtype=_U)


def split(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://`."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((p for p in map(rest.find, "/?#") if p >= 0), default=len(rest))
    tail = rest[cut:]
    end = min((p for p in map(tail.find, "?#") if p >= 0), default=len(tail))
    return rest[:cut].translate(_LOWER), tail[:end]


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _judge(rules: list[tuple[str, str]], globs: list[str]):
    named = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    machine = Automaton.of([*("*." + r + "**" for _, r in named), *globs])
    verdicts = [v for v, _ in named] + ["block"] * len(globs) + ["allow"]
    names = [r for _, r in named] + [None] * (len(globs) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                parts = [split(u) for u in batch.column("url").to_pylist()]
                fits = machine.run([f".{h}{p}".encode() if h or p else b"" for h, p in parts])
                win = np.hstack([fits, np.ones((len(parts), 1), dtype=bool)]).argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), pa.array([h for h, _ in parts]), pa.array([p for _, p in parts]), pa.array([names[w] for w in win], type=pa.string()), pa.array([verdicts[w] for w in win])],
                    names=["page_id", "host", "path", "rule", "verdict"],
                )

    return run


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]] = RULES, globs: list[str] = GLOBS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of `pages`(page_id, url)."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(_judge(rules, globs), "page_id long, host string, path string, rule string, verdict string")


ORACLE_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), fits AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN path LIKE '%/ads/%' OR path LIKE '%/login%' THEN 'block'
    ELSE 'allow' END AS verdict
FROM fits
"""
