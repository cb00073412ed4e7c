"""Tree patterns as joins. A match is a row with doc_id and one column a capture.

A single capture is a struct (node_id, kind, path, key, num, text, and the node's places and positions where the forest has them), null for an optional part that is absent; a repeated one is an array of
such structs in document order. Parents and children meet in an equi-join on (doc_id, parent_id): Catalyst picks its strategy, and a
filter on kind reaches the scan. Repeated parts are collected before they are joined, so a match stays one row and no product of siblings
arises.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copse.functions.values import let
from copse.operators import spread
from copse.sources.forests import PLACES

FIELDS = ["node_id", "kind", "path", "key", "num", "text"]
POSITION = ["child_index", "named_child_index", "named_child_count", "href", "enter", "exit"]


def capture(forest: DataFrame) -> Column:
    return F.struct(*FIELDS, *(c for c in [*PLACES, *POSITION] if c in forest.columns))


def picked(forest: DataFrame, kind: str | list[str] | None = None, named: bool | None = True, where: Column | None = None) -> DataFrame:
    """Nodes of a kind (or any), named, anonymous (False) or both (None), that satisfy a predicate on `text`, `field`, `error`, ..."""
    if kind is not None:
        forest = forest.where(F.col("kind").isin([kind] if isinstance(kind, str) else kind))
    if named is not None:
        forest = forest.where(F.col("named") == named)
    return forest if where is None else forest.where(where)


def match(forest: DataFrame, name: str, kind: str | list[str] | None = None, named: bool | None = True, where: Column | None = None) -> DataFrame:
    """One match for each such node."""
    return picked(forest, kind, named, where).select("doc_id", capture(forest).alias(name))


def child(matches: DataFrame, forest: DataFrame, of: str, name: str, kind: str | list[str] | None = None, field: str | None = None, named: bool | None = True, where: Column | None = None, optional: bool = False) -> DataFrame:
    """One match for each child of capture `of`; with `optional`, a match without such a child stays, its capture null."""
    nodes = picked(forest, kind, named, where)
    nodes = nodes if field is None else nodes.where(F.col("field") == field)
    right = nodes.select(F.col("doc_id").alias("_doc"), F.col("parent_id").alias("_parent"), capture(nodes).alias(name))
    on = (F.col("doc_id") == F.col("_doc")) & (F.col(f"{of}.node_id") == F.col("_parent"))
    return matches.join(right, on, "left" if optional else "inner").drop("_doc", "_parent")


def repeated(matches: DataFrame, forest: DataFrame, of: str, name: str, kind: str | list[str] | None = None, field: str | None = None, where: Column | None = None, least: int = 0) -> DataFrame:
    """All such children of capture `of` as one array in document order: `*` with least=0, `+` with least=1."""
    nodes = picked(forest, kind, True, where)
    nodes = nodes if field is None else nodes.where(F.col("field") == field)
    held = nodes.groupBy(F.col("doc_id").alias("_doc"), F.col("parent_id").alias("_parent")).agg(in_order(F.collect_list(F.struct("path", capture(nodes).alias("node")))).alias(name))
    on = (F.col("doc_id") == F.col("_doc")) & (F.col(f"{of}.node_id") == F.col("_parent"))
    out = matches.join(held, on, "inner" if least else "left").drop("_doc", "_parent")
    return out if least else out.withColumn(name, F.coalesce(name, F.array().cast(held.schema[name].dataType)))


def in_order(found: Column) -> Column:
    return F.transform(F.array_sort(found), lambda x: x["node"])


def of_supertype(forest: DataFrame, kinds: DataFrame, name: str, subtype: str | None = None) -> DataFrame:
    """Nodes whose kind `kinds`(supertype, kind) lists under a supertype (and is `subtype`, if given). Supertypes may be nested by listing them closed."""
    listed = kinds.where(F.col("supertype") == name)
    listed = listed if subtype is None else listed.where(F.col("kind") == subtype)
    return forest.join(listed.select("kind").distinct(), "kind", "left_semi").select(*forest.columns)


def closed(direct: DataFrame, most: int = 100_000) -> DataFrame:
    """(supertype, kind) of a hierarchy given by direct steps (supertype, kind), however deep; a supertype of itself is an error.

    A grammar's hierarchy is small: its steps come to the driver if there are no more than `most`, else it is an error.
    """
    steps = direct.select("supertype", "kind").distinct().limit(most + 1).collect()
    if len(steps) > most:
        raise ValueError(f"a hierarchy of kinds has at most {most} steps")
    below: dict[str, set[str]] = {}
    for name, kind in steps:
        below.setdefault(name, set()).add(kind)
    out = []
    for name in below:
        seen, ahead = set(), [name]
        while ahead:
            new = below.get(ahead.pop(), set()) - seen
            seen |= new
            ahead += new
        if name in seen:
            raise ValueError(f"supertype of itself: {name}")
        out += [(name, kind) for kind in sorted(seen)]
    return direct.sparkSession.createDataFrame(out, "supertype string, kind string")


def without(matches: DataFrame, forest: DataFrame, of: str, kind: str | list[str] | None = None, field: str | None = None, where: Column | None = None) -> DataFrame:
    """Matches whose capture `of` has no such child (a negated field)."""
    nodes = picked(forest, kind, None, where)
    nodes = nodes if field is None else nodes.where(F.col("field") == field)
    right = nodes.select(F.col("doc_id").alias("_doc"), F.col("parent_id").alias("_parent"))
    return matches.join(right, (F.col("doc_id") == F.col("_doc")) & (F.col(f"{of}.node_id") == F.col("_parent")), "left_anti")


def having(matches: DataFrame, forest: DataFrame, of: str, kind: str | list[str] | None = None, field: str | None = None, where: Column | None = None) -> DataFrame:
    """Matches whose capture `of` has such a child, itself not captured."""
    nodes = picked(forest, kind, None, where)
    nodes = nodes if field is None else nodes.where(F.col("field") == field)
    right = nodes.select(F.col("doc_id").alias("_doc"), F.col("parent_id").alias("_parent"))
    return matches.join(right, (F.col("doc_id") == F.col("_doc")) & (F.col(f"{of}.node_id") == F.col("_parent")), "left_semi")


def either(*branches: DataFrame) -> DataFrame:
    """An alternation: captures that a branch lacks are null in its matches."""
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def before(a: str, b: str) -> Column:
    """Sibling order: capture a stands before capture b."""
    return F.col(f"{a}.path") < F.col(f"{b}.path")


def positioned(forest: DataFrame, wide: bool = False) -> DataFrame:
    """The forest with child_index, named_child_index (null for anonymous nodes and roots) and named_child_count; `wide`: for parents with more children than a task can hold."""
    placed = F.col("parent_id").isNotNull()
    counts = forest.where("named and parent_id is not null").groupBy(F.col("doc_id").alias("_doc"), F.col("parent_id").alias("_parent")).agg(F.count("*").alias("named_child_count"))
    if wide:
        below = spread.numbered(forest.where(placed), ["doc_id", "parent_id"], ["path"], "child_index")
        below = spread.summed(below, ["doc_id", "parent_id"], ["path"], F.col("named").cast("int"), "named_child_index")
        below = below.withColumn("child_index", F.col("child_index").cast("int")).withColumn("named_child_index", F.when(F.col("named"), F.col("named_child_index")))
        out = forest.where(~placed).unionByName(below, allowMissingColumns=True)
    else:
        siblings = Window.partitionBy("doc_id", "parent_id").orderBy("path")
        running = F.sum(F.col("named").cast("int")).over(siblings.rowsBetween(Window.unboundedPreceding, 0))
        out = forest.withColumn("child_index", F.when(placed, F.row_number().over(siblings) - 1)).withColumn("named_child_index", F.when(placed & F.col("named"), running - 1))
    out = out.join(counts, (out.doc_id == counts._doc) & (out.node_id == counts._parent), "left").drop("_doc", "_parent")
    return out.withColumn("named_child_count", F.coalesce("named_child_count", F.lit(0)))


def ends(forest: DataFrame, wide: bool = False) -> DataFrame:
    """The forest with `is_first`, `is_last` (anchors at either end) and `previous`, the node_id just before, among named siblings; `wide`: for parents with more children than a task can hold."""
    nodes = forest.where("named")
    if wide:
        nodes = spread.numbered(nodes, ["doc_id", "parent_id"], ["path"], "_nth")
        near = nodes.select(F.col("doc_id").alias("_doc"), F.col("parent_id").alias("_parent"), F.col("_nth").alias("_at"), F.col("node_id").alias("_node"))
        same = (F.col("doc_id") == F.col("_doc")) & F.col("parent_id").eqNullSafe(F.col("_parent"))
        for name, step in (("previous", 1), ("_next", -1)):
            nodes = nodes.join(near.withColumn("_at", F.col("_at") + step), same & (F.col("_nth") == F.col("_at")), "left").withColumn(name, F.col("_node")).drop("_doc", "_parent", "_at", "_node")
        return nodes.withColumn("is_last", F.col("_next").isNull()).withColumn("is_first", F.col("previous").isNull()).drop("_nth", "_next")
    siblings = Window.partitionBy("doc_id", "parent_id").orderBy("path")
    return nodes.withColumn("previous", F.lag("node_id").over(siblings)).withColumn("is_last", F.lead("node_id").over(siblings).isNull()).withColumn("is_first", F.col("previous").isNull())


def runs(forest: DataFrame, kind: str) -> DataFrame:
    """Maximal runs of adjacent named siblings of a kind: (doc_id, parent_id, first path, nodes in order)."""
    siblings = Window.partitionBy("doc_id", "parent_id").orderBy("path")
    same = Window.partitionBy("doc_id", "parent_id", "kind").orderBy("path")
    island = F.row_number().over(siblings) - F.row_number().over(same)
    nodes = forest.where("named and parent_id is not null").withColumn("island", island).where(F.col("kind") == kind)
    return nodes.groupBy("doc_id", "parent_id", "island").agg(F.min("path").alias("first"), in_order(F.collect_list(F.struct("path", capture(nodes).alias("node")))).alias("nodes")).drop("island")


@dataclass(frozen=True)
class Item:
    """One sibling of a group: its name, kind, and how often it stands there: `1`, `?`, `*` or `+`."""

    name: str
    kind: str
    times: str = "1"


def sequences(forest: DataFrame, items: list[Item], times: str = "+", among: Column | None = None) -> DataFrame:
    """Groups of adjacent named siblings, in order and repeated as often as they stand in a row: (doc_id, parent_id, first path, units).

    A sibling is a letter and the group a regular expression over the letters, so a run begins as far left and goes on as long as it can (`times`: `1` or `+`), and runs do not overlap.
    `units` has a struct for each repetition, with one field an item: a node, a node or null (`?`), or a list (`*`, `+`). `among`: the siblings that count at all.
    Only parents that have a sibling of such a kind are gathered, one row each.
    """
    if not items or any(i.times not in ("1", "?", "*", "+") for i in items) or all(i.times in ("?", "*") for i in items):
        raise ValueError("a group needs an item that must stand there")
    kinds = list(dict.fromkeys(i.kind for i in items))
    letters = {k: chr(0x4E00 + n) for n, k in enumerate(kinds)}
    letter = reduce(lambda out, k: out.when(F.col("kind") == k, F.lit(letters[k])), kinds, F.when(F.lit(False), "")).otherwise("-")
    nodes = picked(forest, where=among).where("parent_id is not null")
    held = nodes.groupBy("doc_id", "parent_id").agg(F.array_sort(F.collect_list(F.struct("path", letter.alias("letter"), capture(nodes).alias("node")))).alias("all"))
    held = held.withColumn("text", F.array_join(F.transform("all", lambda x: x["letter"]), ""))
    unit = "".join(letters[i.kind] + i.times.removeprefix("1") for i in items)
    whole = f"(?:{unit}){times.removeprefix('1')}"
    held = held.where(F.regexp_like("text", F.lit(whole)))
    parts = "".join(f"({letters[i.kind]}{i.times.removeprefix('1')})" for i in items)

    def placed(pieces: Column) -> Column:
        """Each piece with the number of letters before it."""
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,at:int>>").alias("out"))
        add = lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), F.array_append(a["out"], F.struct(x.alias("text"), a["at"].alias("at"))).alias("out"))
        return F.aggregate(pieces, start, add)["out"]

    runs_ = F.filter(placed(F.regexp_extract_all("text", F.lit(f"({whole}|.)"), F.lit(1))), lambda x: F.regexp_like(x["text"], F.lit(f"^{whole}$")))
    run = held.select("doc_id", "parent_id", "all", F.explode(runs_).alias("run"))
    units = placed(F.regexp_extract_all("run.text", F.lit(f"({unit})"), F.lit(1)))

    def one(u: Column) -> Column:
        fields, at = [], F.col("run.at") + u["at"]
        for n, item in enumerate(items):
            size = F.length(F.regexp_extract(u["text"], f"^{parts}$", n + 1))
            own = F.transform(F.slice("all", at + 1, size), lambda x: x["node"])
            fields.append((own if item.times in "*+" else F.get(own, F.lit(0))).alias(item.name))
            at = at + size
        return F.struct(*fields)

    return run.select("doc_id", "parent_id", F.element_at("all", F.col("run.at") + 1)["path"].alias("first"), F.transform(units, one).alias("units"))


@dataclass(frozen=True)
class Pattern:
    """A node of a kind (or any) that satisfies a predicate, with children that it must have, each a pattern under a name."""

    kind: str | None = None
    where: Column | None = None
    named: bool | None = True
    under: str | None = None
    children: dict[str, Pattern] = field(default_factory=dict)

    def holds(self) -> Column:
        """Whether a node of the forest is such a node, its children apart."""
        asked = [F.col("kind") == self.kind if self.kind else None, self.where, F.col("named") == self.named if self.named is not None else None, F.col("field") == self.under if self.under else None]
        return reduce(lambda a, b: a & b, (F.coalesce(x, F.lit(False)) for x in asked if x is not None), F.lit(True))


def merged(forest: DataFrame, patterns: dict[int, Pattern]) -> DataFrame:
    """The matches of several patterns at once: (doc_id, stanza, full, one column a child's name).

    The forest is read once. Each node is tagged with the patterns that it can start and the children that it can be, and sent to its own place and to its
    parent's, once each; there every match is a start and a choice of one child for each name. A child may not ask for children of its own. Children that patterns share are
    tagged once.
    """
    if any(c.children for x in patterns.values() for c in x.children.values()):
        raise ValueError("a child has no children of its own here")
    asked = {(id(c), n): c for x in patterns.values() for n, c in x.children.items()}
    shared: list[Pattern] = []
    number: dict[int, int] = {}
    for c in asked.values():
        like = next((i for i, s in enumerate(shared) if s is c), None)
        number[id(c)] = len(shared) if like is None else like
        shared += [c] if like is None else []
    tags = lambda found: F.array_compact(F.array(*(F.when(x.holds(), F.lit(k)) for k, x in found))) if found else F.array().cast("array<int>")
    rows = forest.select("doc_id", "node_id", "parent_id", "path", capture(forest).alias("node"), tags(list(patterns.items())).alias("starts"), tags(list(enumerate(shared))).alias("fits"))
    rows = rows.where((F.size("starts") > 0) | (F.size("fits") > 0))
    own = F.struct(F.col("node_id").alias("place"), F.col("node").alias("full"), "starts", F.lit(None).cast(rows.schema["node"].dataType).alias("child"), F.array().cast("array<int>").alias("fits"))
    up = F.struct(F.col("parent_id").alias("place"), F.lit(None).cast(rows.schema["node"].dataType).alias("full"), F.array().cast("array<int>").alias("starts"), F.col("node").alias("child"), "fits")
    sent = rows.select("doc_id", F.explode(F.array_compact(F.array(F.when(F.size("starts") > 0, own), F.when((F.size("fits") > 0) & F.col("parent_id").isNotNull(), up)))).alias("s")).select("doc_id", "s.*")
    met = sent.groupBy("doc_id", "place").agg(F.first("full", True).alias("full"), F.first(F.when(F.size("starts") > 0, F.col("starts")), True).alias("starts"), F.array_sort(F.collect_list(F.when(F.size("fits") > 0, F.struct(F.col("child.path").alias("path"), "child", "fits")))).alias("kids"))
    found = met.where("full is not null").select("doc_id", "full", "kids", F.explode("starts").alias("stanza"))
    for name in dict.fromkeys(n for x in patterns.values() for n in x.children):
        wants = {k: number[id(x.children[name])] for k, x in patterns.items() if name in x.children}
        want = reduce(lambda out, k: out.when(F.col("stanza") == k, F.lit(wants[k])), wants, F.when(F.lit(False), F.lit(None).cast("int")))
        fit = let(want, lambda w: F.transform(F.filter("kids", lambda x: F.array_contains(x["fits"], w)), lambda x: x["child"]))
        none = F.array(F.lit(None).cast(rows.schema["node"].dataType))
        found = found.withColumn(name, F.explode(F.when(want.isNull(), none).otherwise(fit)))
    return found.drop("kids")


def prefixes(path: Column, itself: bool = True) -> Column:
    """A path and the paths of all its ancestors, longest first."""
    top = F.size(path) if itself else F.size(path) - 1
    return F.when(top >= 0, F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda n: F.slice(path, F.lit(1), n)))


def parse_errors(forest: DataFrame) -> DataFrame:
    """Error and missing nodes that no other such node contains: those none of whose ancestors is one.

    Each such node is filed under the paths of its ancestors and under its own, and meets the bad nodes of these paths alone.
    """
    bad = forest.where("error or missing").select("doc_id", F.struct("node_id", "kind", "path", "error", "missing").alias("node"))
    filed = bad.select("doc_id", "node", F.explode(prefixes(F.col("node.path"))).alias("above"))
    own = F.size("above") == F.size("node.path")
    marked = filed.join(bad.select("doc_id", F.col("node.path").alias("above"), F.lit(True).alias("bad")), ["doc_id", "above"]).withColumn("inner", ~own)
    return marked.groupBy("doc_id", "node").agg(F.max("inner").alias("inner")).where("not inner").select("doc_id", "node.*")


def first_error(errors: DataFrame) -> DataFrame:
    return errors.groupBy("doc_id").agg(F.min_by(F.struct("node_id", "kind", "error", "missing"), "path").alias("e")).select("doc_id", "e.*")


def stanzas(matches: dict[int, DataFrame]) -> DataFrame:
    """Matches of several patterns, each row tagged with its pattern's number."""
    return either(*(m.withColumn("stanza", F.lit(k)) for k, m in matches.items()))


def ordered(matches: DataFrame, *captures: str, wide: bool = False) -> DataFrame:
    """match_ord, from 1 within a document and stanza, by the captures' places; `wide`: for documents that no task can hold."""
    if wide:
        held = matches.withColumns({f"_{c}": F.col(f"{c}.path") for c in captures})
        out = spread.numbered(held, ["doc_id", "stanza"], [f"_{c}" for c in captures], "match_ord")
        return out.withColumn("match_ord", F.col("match_ord") + 1).drop(*(f"_{c}" for c in captures))
    by = Window.partitionBy("doc_id", "stanza").orderBy(*(F.col(f"{c}.path") for c in captures))
    return matches.withColumn("match_ord", F.row_number().over(by))
