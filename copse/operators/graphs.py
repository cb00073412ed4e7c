"""Attributed graphs as three tables, and what is checked and rendered of them.

nodes(doc_id, node), edges(doc_id, source, sink), attrs(doc_id, owner, source, sink, name, value): owner is `node` (sink null) or `edge`;
values are tagged JSON texts (`copse.functions.values`), so equal values are equal texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copse.functions import values
from copse.operators import spread


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    attrs: DataFrame


def numbered(created: DataFrame, *order: str | Column, seed: DataFrame | None = None, wide: bool = False) -> DataFrame:
    """`created` with `node`: ids from 0 in order of creation within a document, after the ids that `seed`(doc_id, node) has already.

    `wide`: for documents that no task can hold (`order` then names columns): ranges of a document are counted, and each range goes on from the sum of those before.
    """
    if wide:
        ids = spread.numbered(created, ["doc_id"], list(order), "node")
    else:
        ids = created.withColumn("node", (F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1).cast("long"))
    if seed is None:
        return ids
    last = seed.groupBy(F.col("doc_id").alias("_doc")).agg((F.max("node") + 1).alias("_next"))
    return ids.join(last, ids.doc_id == last._doc, "left").withColumn("node", F.col("node") + F.coalesce("_next", F.lit(0))).drop("_doc", "_next")


def creations(*statements: tuple[DataFrame, int, str, list[int | str]]) -> DataFrame:
    """The nodes that statements create, with `made`, their order of creation: (doc_id, variable, full, made).

    A statement: its matches (with capture `full`), its stanza, the variable that holds the node, and its place in the block: the number of the statement, then, inside
    a loop, the column with the place of the element, the number of the statement in the loop's body, and so on.
    """
    def one(matches: DataFrame, stanza: int, variable: str, place: list[int | str]) -> DataFrame:
        at = F.array(*((F.lit(x) if isinstance(x, int) else F.col(x)).cast("long") for x in place))
        return matches.select("doc_id", F.lit(variable).alias("variable"), "full", F.struct(F.lit(stanza).alias("stanza"), F.col("full.path").alias("match"), at.alias("place")).alias("made"))

    return reduce(DataFrame.unionByName, (one(*s) for s in statements))


def edges(pairs: DataFrame) -> DataFrame:
    """Edges of (doc_id, source, sink) pairs; an edge created again is the same edge."""
    return pairs.select("doc_id", "source", "sink").distinct()


def attributes(rows: DataFrame, given: dict[str, Column], source: str, sink: str | None = None, site: Column | None = None) -> DataFrame:
    """Attribute rows of nodes (`source`) or edges; `given`: name -> encoded value. One pass, whatever the number of attributes.

    `site`: the stanza, match and statement that gave them, in an order, for `conflicts` to name; without it the rows have none.
    """
    pairs = F.array(*(F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in given.items()))
    more = [] if site is None else [site.alias("site")]
    rows = rows.select("doc_id", F.lit("node" if sink is None else "edge").alias("owner"), F.col(source).cast("long").alias("source"), (F.lit(None) if sink is None else F.col(sink)).cast("long").alias("sink"), F.explode(pairs).alias("a"), *more)
    return rows.select("doc_id", "owner", "source", "sink", "a.name", "a.value", *(["site"] if more else []))


def conflicts(attrs: DataFrame) -> DataFrame:
    """Attributes given different values; the same value again is no conflict. With sites: the first that gave a value, and the last that gave another one first."""
    key = ["doc_id", "owner", "source", "sink", "name"]
    if "site" not in attrs.columns:
        return attrs.groupBy(*key).agg(F.count_distinct(F.coalesce("value", values.null())).alias("n")).where("n > 1")
    told = attrs.groupBy(*key, F.coalesce("value", values.null()).alias("value")).agg(F.min("site").alias("site"))
    return told.groupBy(*key).agg(F.count("*").alias("n"), F.min("site").alias("first_site"), F.max("site").alias("last_site")).where("n > 1")


def dangling(attrs: DataFrame, of: DataFrame) -> DataFrame:
    """Attributes of edges that were never created."""
    return attrs.where("owner = 'edge'").join(of, ["doc_id", "source", "sink"], "left_anti")


def validated(graph: Graph) -> Graph:
    """Fails with the smallest offender if an attribute is in conflict or an edge is missing; else gives the graph back."""
    for what, found in (("DuplicateAttribute", conflicts(graph.attrs)), ("UndefinedEdge", dangling(graph.attrs, graph.edges))):
        worst = found.orderBy("doc_id", "owner", "source", "sink", "name").limit(1).collect()  # with both sites, where attributes say theirs
        if worst:
            raise ValueError(f"{what}: {worst[0].asDict()}")
    return graph


def extended(graph: Graph, seed: Graph) -> Graph:
    """A graph added to one that was there before (its ids numbered after the seed's)."""
    return Graph(seed.nodes.unionByName(graph.nodes), edges(seed.edges.unionByName(graph.edges)), seed.attrs.unionByName(graph.attrs, allowMissingColumns=True).distinct())


def debug(line: Column, column: Column) -> Column:
    """A place in a program, counted from 1."""
    return F.concat(F.lit("line "), (line + 1).cast("string"), F.lit(" column "), (column + 1).cast("string"))


def debugged(created: DataFrame, line: str, column: str, variable: str, source: str = "node", sink: str | None = None, full: str | None = None, names: tuple[str, str, str] = ("location", "variable", "match")) -> DataFrame:
    """Attribute rows that say which statement made each node or edge: its place (columns `line`, `column`, from 0), a node's variable, and the node that its match is about.

    `names`: the attributes' names. Edges have the place alone. `full`: the capture of the whole match, if that is to be said.
    """
    given = {names[0]: values.string(debug(F.col(line), F.col(column)))}
    if sink is None:
        given[names[1]] = values.string(F.col(variable))
        if full:
            given[names[2]] = values.syntax_node(F.col(full)["node_id"])
    return attributes(created, given, source, sink)


def printed(rows: DataFrame, order: list[str], *parts: str | Column | tuple[Column, str], wide: bool = False) -> DataFrame:
    """(doc_id, ord, line): what a print statement says for each match, in order within a document, from 0.

    Strings are said as they are, native columns by their type (column, type) as in `values.display`, encoded values as they read. `wide`: for documents that no task can hold.
    """
    said = lambda x: F.lit(x) if isinstance(x, str) else values.display(*x, quote=True) if isinstance(x, tuple) else values.debug(x)
    rows = rows.select("doc_id", *order, F.concat(*map(said, parts)).alias("line"))
    return numbered(rows, *order, wide=wide).select("doc_id", F.col("node").alias("ord"), "line")


def excerpt(line: Column, row: Column, column: Column, length: Column) -> Column:
    """A line of source, numbered from 1, with carets under the place meant (columns in characters, from 0)."""
    head = F.concat((row + 1).cast("string"), F.lit(" | "))
    return F.concat(head, line, F.lit("\n"), F.repeat(F.lit(" "), F.length(head) + column.cast("int")), F.repeat(F.lit("^"), F.greatest(length, F.lit(1)).cast("int")))


def degrees(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", F.col("source").alias("node")).agg(F.count("*").alias("out_edges"))


def named_nodes(attrs: DataFrame, forest: DataFrame) -> DataFrame:
    """`attrs` with `reads`: how a value that is a syntax node reads by its kind and place (counted from 1), null for other values."""
    places = forest.select("doc_id", F.col("node_id").alias("_id"), F.concat(F.lit("[syntax node "), "kind", F.lit(" ("), F.col("start_row") + 1, F.lit(", "), F.col("start_column") + 1, F.lit(")]")).alias("reads"))
    asked = F.when(F.get_json_object("value", "$.type") == "syntaxNode", F.get_json_object("value", "$.id").cast("long"))
    found = attrs.withColumn("_id", asked)
    nodes = found.where("_id is not null").join(places, ["doc_id", "_id"], "left")
    return nodes.drop("_id").unionByName(found.where("_id is null").drop("_id").withColumn("reads", F.lit(None).cast("string")))


def pretty(graph: Graph, forest: DataFrame | None = None) -> DataFrame:
    """(doc_id, text): nodes by id, their attributes by name, their edges by sink, each edge's attributes by name.

    With the `forest` (with places), attributes that are syntax nodes read by kind and place, else by id.
    """
    order = F.struct(F.col("node").alias("n"), F.coalesce("sink", F.lit(-1)).alias("s"), F.coalesce("name", F.lit("")).alias("a"), "line")
    heads = graph.nodes.select("doc_id", "node", F.lit(None).cast("long").alias("sink"), F.lit(None).cast("string").alias("name"), F.concat(F.lit("node "), "node").alias("line"))
    arrows = graph.edges.select("doc_id", F.col("source").alias("node"), "sink", F.lit(None).cast("string").alias("name"), F.concat(F.lit("edge "), "source", F.lit(" -> "), "sink").alias("line"))
    attrs = graph.attrs.drop("site").distinct()
    attrs = attrs.withColumn("reads", F.lit(None).cast("string")) if forest is None else named_nodes(attrs, forest)
    said = attrs.select("doc_id", F.col("source").alias("node"), "sink", "name", F.concat(F.lit("  "), "name", F.lit(": "), F.coalesce("reads", values.debug("value"))).alias("line"))
    rows = heads.unionByName(arrows).unionByName(said).select("doc_id", order.alias("x"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))


def json_nodes(graph: Graph) -> DataFrame:
    """(doc_id, node, json): one object {"id", "edges": [{"sink", "attrs"}], "attrs"} a node; names in order."""
    def objects(keys: list[str], attrs: DataFrame) -> DataFrame:
        item = F.concat(F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2), F.lit(":"), "value")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", item.alias("item")))), lambda x: x["item"]), ",")
        return attrs.groupBy(*keys).agg(F.concat(F.lit("{"), joined, F.lit("}")).alias("attrs"))

    attrs = graph.attrs.drop("site").distinct()
    of_nodes = objects(["doc_id", "node"], attrs.where("owner = 'node'").withColumnRenamed("source", "node"))
    of_edges = objects(["doc_id", "source", "sink"], attrs.where("owner = 'edge'"))
    lines = graph.edges.join(of_edges, ["doc_id", "source", "sink"], "left")
    text = F.concat(F.lit('{"sink":'), "sink", F.lit(',"attrs":'), F.coalesce("attrs", F.lit("{}")), F.lit("}"))
    out = lines.groupBy("doc_id", F.col("source").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sink", text.alias("t")))), lambda x: x["t"]), ",").alias("edges"))
    rows = graph.nodes.join(of_nodes, ["doc_id", "node"], "left").join(out, ["doc_id", "node"], "left")
    return rows.select("doc_id", "node", F.concat(F.lit('{"id":'), "node", F.lit(',"edges":['), F.coalesce("edges", F.lit("")), F.lit('],"attrs":'), F.coalesce("attrs", F.lit("{}")), F.lit("}")).alias("json"))


def write_json(graph: Graph, path: str) -> None:
    """One JSON line a node, sorted within a file."""
    json_nodes(graph).sortWithinPartitions("doc_id", "node").select("json").write.text(path)
