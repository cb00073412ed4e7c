"""Values as tagged JSON texts, and how they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags of the stored form, fixed values.
TAGS = {"null": '{"type":"null"}', "true": '{"type":"bool","bool":true}', "false": '{"type":"bool","bool":false}'}
TOP = (1 << 32) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)`, with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def null() -> Column:
    return F.lit(TAGS["null"])


def boolean(x: Column) -> Column:
    return F.when(x, TAGS["true"]).when(~x, TAGS["false"]).otherwise(null())


def integer(x: Column) -> Column:
    """Integers are 0 to 2^32 - 1; others fail the job."""
    checked = F.when((x < 0) | (x > TOP), F.raise_error(F.lit("integer out of range")).cast("long")).otherwise(x.cast("long"))
    return F.coalesce(F.concat(F.lit('{"type":"int","int":'), checked.cast("string"), F.lit("}")), null())


def quoted(x: Column) -> Column:
    body = F.to_json(F.array(x))
    return F.substring(body, F.lit(2), F.length(body) - 2)


def string(x: Column) -> Column:
    return F.when(x.isNotNull(), F.concat(F.lit('{"type":"string","string":'), quoted(x), F.lit("}"))).otherwise(null())


def syntax_node(x: Column) -> Column:
    return F.coalesce(F.concat(F.lit('{"type":"syntaxNode","id":'), x.cast("string"), F.lit("}")), null())


def graph_node(x: Column) -> Column:
    return F.coalesce(F.concat(F.lit('{"type":"graphNode","id":'), x.cast("string"), F.lit("}")), null())


def sequence(items: Column, kind: str = "list") -> Column:
    """A list or set of encoded values; a set has each once, in the order of values."""
    return F.concat(F.lit(f'{{"type":"{kind}","values":['), F.array_join(set_of(items) if kind == "set" else items, ","), F.lit("]}"))


#: Parts of an encoded value: the heads of lists and sets, whole scalars, closers and commas. A quote inside a string is escaped,
#: so a head never begins inside one. What repeats does so possessively, so a long string takes no stack.
_PART = r'\{"type":"(?:list|set)","values":\[|\{"type":"string","string":"(?:[^"\\]++|\\.)*+"\}|\{"type":"[a-zA-Z]+"(?:,"[a-z]+":[a-z0-9-]+)?\}|\]\}|,'
#: What an encoded value may hold, read in one go; the elements of lists and sets stay encoded.
_HELD = "type string, bool boolean, int long, string string, id long, values array<string>"


def decoded(v: Column) -> Column:
    """An encoded value as a struct of its type and what that type holds."""
    return F.from_json(v, _HELD)


def parts(v: Column) -> Column:
    """An encoded value's parts in order."""
    return F.regexp_extract_all(v, F.lit(f"({_PART})"), F.lit(1))


def _scalar(v: Column, quote: bool) -> Column:
    def said(d: Column) -> Column:
        text = F.when(d["type"] == "null", "#null").when(d["type"] == "bool", F.concat(F.lit("#"), d["bool"].cast("string"))).when(d["type"] == "int", d["int"].cast("string"))
        text = text.when(d["type"] == "string", quoted(d["string"]) if quote else d["string"])
        for tag, name in (("graphNode", "graph node"), ("syntaxNode", "syntax node")):
            text = text.when(d["type"] == tag, F.concat(F.lit(f"[{name} "), d["id"].cast("string"), F.lit("]")))
        return text.otherwise(v)

    return let(decoded(v), said)


def read(v: Column, quote: bool) -> Column:
    """How an encoded value reads: null and booleans with a hash sign, nodes and lists in brackets, sets in braces, lists and sets however deep.

    Strings are quoted in a debug reading, raw in a plain one; null reads as itself.
    """

    def add(state: Column, part: Column) -> Column:
        text, open_ = state["text"], state["open"]
        closer = F.when(part.startswith('{"type":"list"'), "]").otherwise("}")
        said = F.when(part.endswith("["), F.when(closer == "]", "[").otherwise("{")).when(part == "]}", F.left(open_, F.lit(1))).when(part == ",", ", ").otherwise(_scalar(part, quote))
        left = F.when(part.endswith("["), F.concat(closer, open_)).when(part == "]}", F.substring(open_, F.lit(2), F.length(open_))).otherwise(open_)
        return F.struct(F.array_append(text, said).alias("text"), left.alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("text"), F.lit("").alias("open"))
    nested = F.array_join(F.aggregate(parts(v), start, add)["text"], "")
    return F.when(v.startswith('{"type":"list"') | v.startswith('{"type":"set"'), nested).otherwise(_scalar(v, quote))


def sort_key(v: Column) -> Column:
    """A text that sorts as values do: null, booleans, integers by number, strings, lists, sets, syntax nodes, graph nodes; lists and sets by their elements, a shorter one first.

    Every kind begins with its rank. A string ends with two zero bytes (one inside it is followed by a one), a list or set with a sign below all ranks.
    """

    def one(part: Column) -> Column:
        def ranked(d: Column) -> Column:
            nodes = F.lpad((d["id"].cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")
            text = F.replace(d["string"], F.lit("\x00"), F.lit("\x00\x01"))
            out = F.when(d["type"] == "null", "0").when(d["type"] == "bool", F.concat(F.lit("1"), d["bool"].cast("int").cast("string")))
            out = out.when(d["type"] == "int", F.concat(F.lit("2"), F.lpad(d["int"].cast("string"), 10, "0"))).when(d["type"] == "string", F.concat(F.lit("3"), text, F.lit("\x00\x00")))
            return out.when(d["type"] == "syntaxNode", F.concat(F.lit("6"), nodes)).otherwise(F.concat(F.lit("7"), nodes))

        head = F.when(part.startswith('{"type":"list"'), "4").otherwise("5")
        return F.when(part.endswith('"values":['), head).when(part == "]}", "!").when(part == ",", "").otherwise(let(decoded(part), ranked))

    return F.array_join(F.transform(parts(v), one), "")


def set_of(items: Column) -> Column:
    """Encoded values, each once, in the order of values."""
    keyed = F.transform(F.array_distinct(items), lambda x: F.struct(sort_key(x).alias("key"), x.alias("value")))
    return F.transform(F.array_sort(keyed), lambda x: x["value"])


def debug(value: str | Column) -> Column:
    """How an encoded value reads in a pretty print: strings quoted."""
    return read(F.col(value) if isinstance(value, str) else value, True)


def _parts(kind: str) -> tuple[str, str] | None:
    for outer in ("array", "list", "set"):
        if kind.startswith(f"{outer}<"):
            return outer, kind[len(outer) + 1 : -1]
    return None


def display(x: Column, kind: str, quote: bool = False) -> Column:
    """How a native column reads in `format`, `join` and prints: strings raw (or quoted), lists `[a, b]`, sets `{a, b}`, however deep; null as #null.

    `kind`: its type, `array<...>` or `list<...>` for lists, `set<...>` for sets, `value` for an encoded value.
    """
    if nested := _parts(kind):
        outer, inner = nested
        first, last = "{}" if outer == "set" else "[]"
        text = F.concat(F.lit(first), F.array_join(F.transform(x, lambda e: display(e, inner, quote)), ", "), F.lit(last))
    elif kind == "value":
        text = read(x, quote)
    elif kind == "boolean":
        text = F.concat(F.lit("#"), x.cast("string"))
    elif kind == "string" and quote:
        text = F.when(x.isNotNull(), quoted(x))
    else:
        text = x.cast("string")
    return F.coalesce(text, F.lit("#null"))


def is_null(v: Column) -> Column:
    """Whether an encoded value is null."""
    return v == TAGS["null"]


def _as(v: Column, name: str, kind: str, field: str, type_: str) -> Column:
    wrong = F.raise_error(F.concat(F.lit(f"Expected{name}: got "), F.coalesce(read(v, False), F.lit("nothing")))).cast(type_)
    return let(decoded(v), lambda d: F.when(d["type"] == kind, d[field]).otherwise(wrong))


def as_boolean(v: Column) -> Column:
    """The boolean of an encoded value; a value of another type fails the job, as in all that follow."""
    return _as(v, "Boolean", "bool", "bool", "boolean")


def as_integer(v: Column) -> Column:
    return _as(v, "Integer", "int", "int", "long")


def as_string(v: Column) -> Column:
    return _as(v, "String", "string", "string", "string")


def as_list(v: Column) -> Column:
    """The encoded elements."""
    return _as(v, "List", "list", "values", "array<string>")


def as_set(v: Column) -> Column:
    return _as(v, "Set", "set", "values", "array<string>")


def as_graph_node(v: Column) -> Column:
    return _as(v, "GraphNode", "graphNode", "id", "long")


def as_syntax_node(v: Column) -> Column:
    return _as(v, "SyntaxNode", "syntaxNode", "id", "long")
