"""The standard functions as Column builders, and a registry for further ones."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from copse.functions import values


def eq(a: Column, b: Column) -> Column:
    """null equals null alone; comparing values of different types fails the job (nothing is cast, but among integer widths).

    Lists are one type: those of unlike elements are unequal.
    """

    def family(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.typeof(x), "^array<.*", "list"), "^(tinyint|smallint|bigint)$", "int")

    def text(x: Column) -> Column:
        return F.to_json(F.array(x))

    differ = F.raise_error(F.concat(F.lit("eq: cannot compare values of different types: "), F.typeof(a), F.lit(" and "), F.typeof(b))).cast("boolean")
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(family(a) != family(b), differ).otherwise(text(a) == text(b))


def is_null(a: Column) -> Column:
    return a.isNull()


def _boolean(x: Column, name: str) -> Column:
    return F.when(x.isNull(), F.raise_error(F.lit(f"{name}: ExpectedBoolean: got #null")).cast("boolean")).otherwise(x)


def not_(a: Column) -> Column:
    """The opposite; null, which is no boolean, fails the job, as in `and_` and `or_`."""
    return ~_boolean(a, "not")


def and_(*xs: Column) -> Column:
    return _all(xs, "and", lambda a, b: a & b, True)


def or_(*xs: Column) -> Column:
    return _all(xs, "or", lambda a, b: a | b, False)


def _all(xs: tuple[Column, ...], name: str, both: Callable[[Column, Column], Column], start: bool) -> Column:
    """Every operand is looked at, so that a null behind a deciding one fails too."""
    if not xs:
        return F.lit(start)
    null = reduce(lambda a, b: a | b, (x.isNull() for x in xs))
    return F.when(null, _boolean(F.lit(None).cast("boolean"), name)).otherwise(reduce(both, xs))


def plus(*xs: Column) -> Column:
    """Sum of integers 0 to 2^32 - 1; an operand that is not one, or a larger sum, fails the job."""
    wrong = F.raise_error(F.lit("integer out of range")).cast("long")
    total = reduce(lambda a, b: a + F.when((b < 0) | (b > values.TOP), wrong).otherwise(b.cast("long")), xs, F.lit(0).cast("long"))
    return F.when(total > values.TOP, wrong).otherwise(total)


def format_(template: str, *args: tuple[Column, str]) -> Column:
    """`{}` is the next argument (column, type), `{{` and `}}` are braces; any other brace, and a missing or extra argument, is an error."""
    parts, rest, text = [], list(args), ""
    for piece in re.findall(r"\{\}|\{\{|\}\}|[^{}]+|[{}]", template):
        if piece == "{}":
            if not rest:
                raise ValueError("too few arguments")
            parts += [F.lit(text), values.display(*rest.pop(0))]
            text = ""
        elif piece in ("{", "}"):
            raise ValueError("lone brace")
        else:
            text += piece[0] if piece in ("{{", "}}") else piece
    if rest:
        raise ValueError("too many arguments")
    return F.concat(*parts, F.lit(text))


def _signs(pattern: str) -> Iterator[tuple[str, bool]]:
    """A pattern's signs, escapes whole, and whether each stands in a class."""
    i, depth = 0, 0
    while i < len(pattern):
        sign = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        depth += sign == "["
        yield sign, depth > 0
        depth -= sign == "]" and depth > 0
        i += len(sign)


def java_pattern(pattern: str) -> str:
    """A pattern of the RE2 family for Spark: Unicode classes, and `$` at the very end only; look-around and back-references are refused."""
    if re.search(r"\(\?(=|!|<=|<!)|\\[1-9]", pattern):
        raise ValueError("look-around and back-references are not supported")
    return "(?U)" + "".join(r"\z" if sign == "$" and not inside else sign for sign, inside in _signs(pattern))


def numbered_groups(pattern: str, capture: bool = True) -> tuple[str, dict[str, int]]:
    """The pattern with plain groups in place of named ones (or none that capture), and each group's number by its name and by itself; 0 is the whole match."""
    found, out, signs = {"0": 0}, "", [*_signs(pattern)]
    at = 0
    while at < len(signs):
        sign, inside = signs[at]
        at += 1
        rest = "".join(x for x, _ in signs[at : at + 64])
        named = re.match(r"\?P?<(\w+)>", rest) if sign == "(" and not inside else None
        if sign == "(" and not inside and (named or not rest.startswith("?")):
            number = str(len([k for k in found if k.isdigit()]))
            found[number] = int(number)
            if named:
                found[named[1]] = int(number)
                at += len(named[0])
            sign = "(" if capture else "(?:"
        out += sign
    return out, found


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern, of the one dialect that scans and `replace` use, is found in the text."""
    return F.regexp_like(text, F.lit(java_pattern(pattern)))


def replace(text: Column, pattern: str, by: str) -> Column:
    """Every match, `$1`, `${name}` and `$$` as usual; a name is as long as letters, digits and underscores go, and that of no group stands for nothing."""
    plain, number = numbered_groups(pattern)
    out, after = "", False
    for piece in re.findall(r"\$\$|\$\{\w+\}|\$\w+|.", by, re.DOTALL):
        name = re.fullmatch(r"\$\{?(\w+)\}?", piece)
        if name:
            out += f"${number[name[1]]}" if name[1] in number else ""
            after = after or name[1] in number
        else:
            sign = piece[0]
            out += "\\" + sign if sign in "\\$" or after and sign.isdigit() else sign
            after = False
    return F.regexp_replace(text, java_pattern(plain), out)


def concat(*lists: Column) -> Column:
    return F.concat(*lists) if lists else F.array()


def is_empty(items: Column) -> Column:
    return F.size(items) == 0


def join(items: Column, kind: str, separator: str = "") -> Column:
    """Elements as they read, null as #null."""
    return F.array_join(F.transform(items, lambda x: values.display(x, kind)), separator)


def length(items: Column) -> Column:
    return F.size(items).cast("long")


def to_set(items: Column) -> Column:
    """A set of native values of one type: sorted, each element once. Sets of encoded values are `values.set_of`."""
    return F.array_sort(F.array_distinct(items))


def of_node(field: str) -> Callable[[Column], Column]:
    """A syntax node's own field, read off its capture."""
    return lambda node: node[field]


def named_child_index(node: Column) -> Column:
    """A node's place among its parent's named children; roots and anonymous nodes have none, which fails the job."""
    index = node["named_child_index"]
    return F.when(index.isNull(), F.raise_error(F.lit("named-child-index: called on a root or a node that is not named")).cast("long")).otherwise(index)


class Registry:
    """Functions by name; a later one of the same name takes its place."""

    def __init__(self) -> None:
        self.by_name: dict[str, Callable[..., Column]] = {}

    def add(self, name: str, builder: Callable[..., Column]) -> None:
        """`builder`'s own parameters say what may be given: needed ones, those with a default, and any number more (`*args`)."""
        self.by_name[name] = builder

    def call(self, name: str, *args) -> Column:
        """The function's column; an unknown name, or too few or too many arguments, is an error when the plan is made."""
        if name not in self.by_name:
            raise KeyError(f"UndefinedFunction: {name}")
        builder = self.by_name[name]
        try:
            inspect.signature(builder).bind(*args)
        except TypeError as error:
            raise TypeError(f"InvalidParameters: {name}: {error}") from error
        return builder(*args)


#: Functions of a syntax node, and the field of a capture that each reads.
NODE_FIELDS = {"source-text": "text", "node-type": "kind", "start-row": "start_row", "start-column": "start_column", "end-row": "end_row", "end-column": "end_column", "named-child-count": "named_child_count"}


def standard() -> Registry:
    """The functions that take and give columns; `node`, which makes rows, is `graphs.numbered`."""
    out = Registry()
    for name, builder in {"eq": eq, "is-null": is_null, "not": not_, "and": and_, "or": or_, "plus": plus, "format": format_, "replace": replace, "concat": concat, "is-empty": is_empty, "join": join, "length": length, "named-child-index": named_child_index}.items():
        out.add(name, builder)
    for name, field in NODE_FIELDS.items():
        out.add(name, of_node(field))
    return out
