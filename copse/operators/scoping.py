"""Values attached to syntax nodes: bindings written by one pattern and read by another, or inherited from an ancestor."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copse.functions import values
from copse.operators import spread
from copse.operators.patterns import prefixes
from copse.sources.scratch import forget, written


class Globals:
    """Names with encoded values that the caller gives to all documents; an inner environment sees the outer one's names."""

    def __init__(self, outer: Globals | None = None):
        self.own: dict[str, Column] = {}
        self.seen = ChainMap(self.own, *(outer.seen.maps if outer else []))

    def add(self, name: str, value: Column) -> None:
        if name in self.own:
            raise ValueError(f"VariableAlreadyDefined: {name}")
        self.own[name] = value

    def get(self, name: str) -> Column | None:
        return self.seen.get(name)

    def remove(self, name: str) -> None:
        self.own.pop(name, None)

    def clear(self) -> None:
        self.own.clear()

    def is_empty(self) -> bool:
        return not self.own

    def __iter__(self) -> Iterator[tuple[str, Column]]:
        return iter(self.own.items())


@dataclass(frozen=True)
class Declared:
    """A global that a program asks for: `many` (declared with `*` or `+`) wants a list; without `default` (a string) it must be given."""

    name: str
    many: bool = False
    default: str | None = None


def with_globals(matches: DataFrame, declared: list[Declared], common: Globals | None = None, own: DataFrame | None = None) -> DataFrame:
    """`matches` with a column of encoded values for each declared global.

    `own`(doc_id, name, value): what is given for single documents; it comes before what `common` gives to all, then the default. The job
    fails where a global is given twice for a document, is missing, or is no list though it must be; defaults are not checked.
    """
    out = matches
    if own is not None:
        names = [d.name for d in declared]
        twice = F.raise_error(F.lit("VariableAlreadyDefined")).cast("string")
        picked = {n: F.when(F.col("name") == n, F.col("value")) for n in names}
        found = own.where(F.col("name").isin(names)).groupBy(F.col("doc_id").alias("_doc")).agg(*(F.when(F.count(x) > 1, twice).otherwise(F.max(x)).alias(f"_own_{n}") for n, x in picked.items()))
        out = out.join(found, F.col("doc_id") == F.col("_doc"), "left").drop("_doc")
    for d in declared:
        given = common.get(d.name) if common else None
        ways = ([F.col(f"_own_{d.name}")] if own is not None else []) + ([given] if given is not None else [])
        value = F.coalesce(*ways) if ways else F.lit(None).cast("string")
        if d.many:
            no_list = F.raise_error(F.lit(f"ExpectedList: {d.name}")).cast("string")
            value = F.when(value.isNotNull() & (F.get_json_object(value, "$.type") != "list"), no_list).otherwise(value)
        rest = values.string(F.lit(d.default)) if d.default is not None else F.raise_error(F.lit(f"MissingGlobalVariable: {d.name}")).cast("string")
        out = out.withColumn(d.name, F.coalesce(value, rest))
    return out.drop(*(f"_own_{d.name}" for d in declared)) if own is not None else out


def bind(matches: DataFrame, scope: str, value: Column, site: Column | None = None) -> DataFrame:
    """(doc_id, scope, path, value[, site]): one binding of a name to capture `scope` a row; `site`: the stanza, match and statement that made it, in an order."""
    more = [] if site is None else [site.alias("site")]
    return matches.select("doc_id", F.col(f"{scope}.node_id").alias("scope"), F.col(f"{scope}.path").alias("path"), value.alias("value"), *more)


def duplicated(bindings: DataFrame) -> DataFrame:
    """Scopes bound more than once, which a program must not do: how often, and the first and last site, if bindings say theirs."""
    sites = [F.min("site").alias("first_site"), F.max("site").alias("last_site")] if "site" in bindings.columns else []
    return bindings.groupBy("doc_id", "scope").agg(F.count("*").alias("n"), *sites).where("n > 1")


def read(matches: DataFrame, bindings: DataFrame, scope: Column, name: str, needed: bool = True) -> DataFrame:
    """`matches` with the bound value as column `name`; with `needed`, a missing binding fails the job, else it is null."""
    right = bindings.select(F.col("doc_id").alias("_doc"), F.col("scope").alias("_scope"), F.struct("value").alias("_got"))
    out = matches.withColumn("_at", scope.cast("long"))
    out = out.join(right, (F.col("doc_id") == F.col("_doc")) & (F.col("_at") == F.col("_scope")), "left")
    got = F.col("_got.value")
    if needed:
        got = F.when(F.col("_got").isNull(), F.raise_error(F.lit("UndefinedScopedVariable")).cast(bindings.schema["value"].dataType)).otherwise(got)
    return out.withColumn(name, got).drop("_at", "_doc", "_scope", "_got")


def last_written(writes: DataFrame, *order: str) -> DataFrame:
    """Of repeated writes to a scope, the last by `order`: what a mutable scoped variable holds at the end."""
    return writes.groupBy("doc_id", "scope").agg(F.max_by("value", F.struct(*order)).alias("value"))


def inherited(matches: DataFrame, bindings: DataFrame, scope: str, name: str) -> DataFrame:
    """The value bound to capture `scope` itself or else to its nearest ancestor that has a binding, be that value null; null if none has.

    No binding lies deeper on a reader's path than the deepest depth that any binding has and the path reaches, so readers that agree to there share what they find: each such
    stretch of a path is looked up once, and meets the bindings of its prefixes, of those lengths alone that bindings have, in one equi-join; the longest prefix wins.
    """
    depths = F.broadcast(bindings.agg(F.collect_set(F.size("path")).alias("_depths")))  # one row, of as many as the longest path has places, at most
    reached = lambda path: F.filter("_depths", lambda d: d <= F.size(path))
    path = F.col(f"{scope}.path")
    stretched = matches.crossJoin(depths).withColumn("_reader", F.slice(path, F.lit(1), F.array_max(reached(path)))).drop("_depths")
    readers = stretched.select("doc_id", "_reader").distinct()
    up = readers.crossJoin(depths).select("doc_id", "_reader", F.explode(F.transform(reached("_reader"), lambda d: F.slice("_reader", F.lit(1), d))).alias("path"))
    found = up.join(bindings.select("doc_id", "path", F.struct("value").alias("got")), ["doc_id", "path"])
    best = found.groupBy("doc_id", "_reader").agg(F.max_by("got", F.size("path")).alias("_got"))
    return stretched.join(best, ["doc_id", "_reader"], "left").withColumn(name, F.col("_got.value")).drop("_reader", "_got")


def along_path(matches: DataFrame, forest: DataFrame, scope: str, name: str, value: Column, start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """A value that each node makes of its parent's (`v` of a child from `v` of the parent), as a fold from the root down to capture `scope`.

    `value` is what each node on the way brings, an expression over the forest; `step(carried, value)` goes on from there.
    """
    readers = matches.select("doc_id", F.col(f"{scope}.path").alias("_reader")).distinct()
    up = readers.select("doc_id", "_reader", F.explode(prefixes(F.col("_reader"))).alias("path"))
    steps = up.join(forest.select("doc_id", "path", value.alias("brought")), ["doc_id", "path"])
    held = steps.groupBy("doc_id", "_reader").agg(F.array_sort(F.collect_list(F.struct(F.size("path").alias("depth"), "brought"))).alias("way"))
    made = held.select("doc_id", "_reader", F.aggregate("way", start, lambda a, x: step(a, x["brought"])).alias(name))
    return matches.withColumn("_reader", F.col(f"{scope}.path")).join(made, ["doc_id", "_reader"], "left").drop("_reader")


def as_of(reads: DataFrame, writes: DataFrame, scope: Column, order: list[str], name: str, needed: bool = True, wide: bool = False) -> DataFrame:
    """`reads` with `name`: what the last write to the scope before each read left, in the order of the columns `order` (stanza, match, statement), which both have.

    `writes`: (doc_id, scope, value, order...). A read of the same place as a write comes first, as in a statement that sets a variable to what is made of it.
    Reads and writes of a scope are laid in one order and the last value is carried along; `wide`: for scopes that no task can hold. A read without a
    write before fails the job if it is `needed`, else it gives null.
    """
    held = reads.select(F.struct(*reads.columns).alias("_row"), "doc_id", scope.alias("_scope"), *order, F.lit(0).alias("_write"))
    wrote = writes.select("doc_id", F.col("scope").alias("_scope"), *order, F.lit(1).alias("_write"), F.struct("value").alias("_got"))
    both = held.unionByName(wrote, allowMissingColumns=True)
    keys, by = ["doc_id", "_scope"], [*order, "_write"]
    if wide:
        both = spread.carried(both, keys, by, "_got", "_last")
    else:
        both = both.withColumn("_last", F.last("_got", True).over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)))
    got = F.col("_last.value")
    if needed:
        got = F.when(F.col("_last").isNull(), F.raise_error(F.lit("UndefinedScopedVariable")).cast(writes.schema["value"].dataType)).otherwise(got)
    return both.where("_write = 0").select("_row.*", got.alias(name))


def closure(bindings: DataFrame, name: str = "end") -> DataFrame:
    """(doc_id, scope, `name`, steps): where a variable that holds a node leads when it is read of what it holds, again and again, until a node has no such variable.

    Cycles have no end: `name` and steps are null. `bindings`: (doc_id, scope, value), the value a node id, one row a scope.
    """
    found = spread.ends(bindings.select("doc_id", F.col("scope").alias("id"), F.col("value").cast("long").alias("to")))
    return found.select("doc_id", F.col("id").alias("scope"), F.col("end").alias(name), "steps")


def inherited_between(matches: DataFrame, bindings: DataFrame, scope: str, name: str) -> DataFrame:
    """`inherited` by places instead of paths (`forests.from_parents`): the value bound to capture `scope` or to its nearest ancestor that has one, however deep the trees.

    `bindings`: (doc_id, enter, exit, value). Their places are nested intervals. The last place before a reader's tells its binding: if one begins there, that one; if one ends there, what
    that one lies in, which is found for all bindings together by pointer doubling. So both places of a binding get the value that holds from there on, and readers, laid in one order
    with them, are carried the last. Matches go through that order whole: they should have no more columns than are needed.
    """
    def mark(at: str, ends: int) -> Column:
        return F.struct(F.col(at).alias("at"), F.lit(1).alias("turn"), F.struct(F.col("enter").alias("of"), F.lit(ends).alias("ends")).alias("mark"))

    asked = F.struct(F.col("enter").alias("at"), F.lit(0).alias("turn"), F.lit(None).cast("struct<of:long,ends:int>").alias("mark"))
    held = written(bindings.select("doc_id", F.col("enter").cast("long").alias("enter"), F.col("exit").cast("long").alias("exit"), "value"), "bindings")
    events = held.select("doc_id", F.explode(F.array(asked, mark("enter", 0), mark("exit", 1))).alias("e"))  # what is before a binding, it, and its end
    told = spread.carried(events.select("doc_id", "e.*"), ["doc_id"], ["at", "turn"], "mark", "last")
    seen = written(told.where("turn = 0").select("doc_id", F.col("at").alias("id"), "last.of", "last.ends"), "told")
    forget(told)
    after = spread.ends(seen.select("doc_id", "id", F.when(F.col("ends") == 1, F.col("of")).alias("to")))  # what one lies in is what its elder lies in
    eldest = seen.join(after.select("doc_id", "id", "end"), ["doc_id", "id"], "left").select("doc_id", "id", F.coalesce("end", "id").alias("eldest"))
    inside = seen.where("ends = 0").select("doc_id", F.col("id").alias("eldest"), F.col("of").alias("outer"))
    outer = eldest.join(inside, ["doc_id", "eldest"]).select("doc_id", F.col("id").alias("enter"), "outer")
    around = held.select("doc_id", F.col("enter").alias("outer"), F.col("value").alias("_outside"))
    ended = held.select("doc_id", "enter", "exit").join(outer, ["doc_id", "enter"], "left").join(around, ["doc_id", "outer"], "left")
    got = lambda at, value: F.struct("doc_id", F.col(at).alias("_at"), F.struct(F.col(value).alias("value")).alias("_got"))
    marks = held.select(got("enter", "value").alias("m")).unionByName(ended.select(got("exit", "_outside").alias("m"))).select("m.*", F.lit(0).alias("_turn"))
    readers = matches.select(F.struct(*matches.columns).alias("_row"), "doc_id", F.col(f"{scope}.enter").cast("long").alias("_at"), F.lit(1).alias("_turn"))
    both = spread.carried(readers.unionByName(marks, allowMissingColumns=True), ["doc_id"], ["_at", "_turn"], "_got", "_last")
    return both.where("_turn = 1").select("_row.*", F.when(F.col("_at").isNotNull(), F.col("_last.value")).alias(name))
