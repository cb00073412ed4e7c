"""Blocks run for each element of a list, tokenising scans, and chains that carry a value from one step to the next."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copse.functions.standard import _signs, java_pattern, numbered_groups


def for_each(matches: DataFrame, items: str | Column, name: str, at: str = "at") -> DataFrame:
    """One row for each element of a list, with its place; a row without elements is gone after the loop's block."""
    return matches.select("*", F.posexplode(items).alias(at, name))


def gathered(rows: DataFrame, by: list[str], at: str, value: Column, name: str) -> DataFrame:
    """Back from one row an element to one list a match, in the elements' order: a comprehension whose element needed a join."""
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(at, value.alias("value")))), lambda x: x["value"]).alias(name))


def fold(items: str | Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """A loop that carries a value: `step(carried, element)` in order."""
    return F.aggregate(items, start, step)


def chained(matches: DataFrame, by: list[str], order: list[str], value: Column, start: Column, name: str) -> DataFrame:
    """The value of the step before within a chain, `start` for the first: what `set` leaves for the next round."""
    window = Window.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(window) == 1
    return matches.withColumn(name, F.when(first, start).otherwise(F.lag(value).over(window)))


#: Stands for an arm that matched nothing where it was tried.
_FAILED = "EmptyRegexCapture: an arm matched an empty text"


def _arm(arm: str) -> tuple[str, dict[str, int]]:
    """An arm for a search of the whole text: what looks at the text's start (`^`, `\\b`) looks at the place where the scan is, which is where the search before ended."""
    if re.search(r"\(\?[a-zA-Z]*m", arm):
        raise ValueError("arms look at the text's start and end, not at those of lines")
    plain, number = numbered_groups(arm)
    start = {"^": r"\G", r"\A": r"\G", r"\b": r"(?:\G(?=\w)|(?!\G)\b)", r"\B": r"(?:\G(?!\w)|(?!\G)\B)"}
    java = java_pattern(plain).removeprefix("(?U)")
    return "".join(start.get(sign, sign) if not inside else sign for sign, inside in _signs(java)), number


def _may_be_empty(arm: str) -> bool:
    """Whether an arm could match an empty text somewhere: what only looks is taken to be true. In doubt it could."""
    bare = "".join("" if sign in ("^", "$", r"\A", r"\z", r"\b", r"\B") and not inside else sign for sign, inside in _signs(re.sub(r"\\[pP](\{\w+\}|\w)", "x", numbered_groups(arm)[0])))
    try:
        return re.search(f"^(?:{bare})$", "") is not None
    except re.error:
        return True


def _search(arms: list[str]) -> tuple[str, int, list[tuple[int, int]]]:
    """One pattern that finds the next token of a scan; the group that is filled if an arm failed, and for each arm its group and how many follow inside it.

    Every search begins where the last ended (`\\G`) and takes in the gap before its token. An arm that could be empty is first sought by itself: where it is
    found first, it must not be empty there (what is left of the text would be the same before and after it).
    """
    made = [_arm(a) for a in arms]
    checks = []
    for arm, (java, _) in zip(arms, made, strict=True):
        if _may_be_empty(arm):
            bare = numbered_groups(java, capture=False)[0]
            checks.append(rf"(?=(?s:(?!{bare}).)*+(?=(?s:(.*))\z)(?>{bare})(?=(?s:\{len(checks) + 1})\z))")
    failed = len(checks) + 1 if checks else 0
    group, places = failed, []
    for _, number in made:
        inner = len([k for k in number if k.isdigit()]) - 1
        places.append((group + 1, inner))
        group += 1 + inner
    body = "|".join(f"({java})" for java, _ in made)
    head = f"(?:{'|'.join(checks)})((?s:.))|" if checks else ""
    return rf"(?U)\G(?!\z)(?:{head}(?s:.*?)(?:{body}))", failed, places


def _looks_at_start(arm: str) -> bool:
    return any(sign in ("^", r"\A", r"\b", r"\B") and not inside for sign, inside in _signs(arm))


def tokens(text: Column, arms: list[str]) -> Column:
    """Tokens of `text`, without their arms, as `scan` finds them."""
    if not any(_may_be_empty(a) or _looks_at_start(a) for a in arms):
        body = "|".join(f"(?:{java_pattern(numbered_groups(a, capture=False)[0]).removeprefix('(?U)')})" for a in arms)
        return F.regexp_extract_all(text, F.lit(f"(?U)((?:{body}))"), F.lit(1))
    return F.transform(scan(text, arms), lambda t: t["token"])


def scan(text: Column, arms: list[str]) -> Column:
    """Tokens of `text`: array of (arm, token, groups), as regular expressions tried together from left to right find them.

    At each place the leftmost match wins, of those that start there the first arm; the text between tokens is skipped, and the scan goes on behind the token as if the text
    began there. If any arm, be it one that would lose, matches an empty text where it is found first, the job fails; an empty or null text has no places. Arms do not look around or refer
    back, and not at the ends of lines. `groups` holds the token, then the arm's groups; one that took no part is empty.
    """
    pattern, failed, places = _search(arms)
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for first, inner in places for g in range(first, first + inner + 1)]

    def one(x: Column) -> Column:
        arm, token, groups = F.lit(None).cast("int"), F.lit(""), F.array().cast("array<string>")
        at = len(found)
        for i in reversed(range(len(arms))):
            at -= places[i][1] + 1
            own = [x[f"g{at + n}"] for n in range(places[i][1] + 1)]
            arm, token, groups = F.when(own[0] != "", F.lit(i)).otherwise(arm), F.when(own[0] != "", own[0]).otherwise(token), F.when(own[0] != "", F.array(*own)).otherwise(groups)
        return F.struct(arm.alias("arm"), token.alias("token"), groups.alias("groups"))

    out = F.transform(F.arrays_zip(*(x.alias(f"g{i}") for i, x in enumerate(found))), one)
    if not failed:
        return out
    wrong = F.exists(F.regexp_extract_all(text, F.lit(pattern), F.lit(failed)), lambda x: x != "")
    return F.when(wrong, F.raise_error(F.lit(_FAILED)).cast("array<struct<arm:int,token:string,groups:array<string>>>")).otherwise(out)
