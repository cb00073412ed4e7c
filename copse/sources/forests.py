"""Forests: trees of many documents as one row a node.

Columns: doc_id, node_id (unique within its doc), parent_id (null for roots), kind, field (the role under the parent, or null), named, error,
missing, path (array<long>: the parent's path and one place more, so it
compares in document order, and its prefixes are the ancestors), key, num, text. Nothing here is collected or windowed: ids
and paths come from the rows' own keys, so a forest costs a scan (and, for orders, the join that gives lines their customer).
Forests of texts have the nodes' places as well (`PLACES`: rows and columns, and bytes from the text's start; from 0, columns in bytes, the end after the last byte), where
they are asked for. Trees that come with parent pointers alone get their order by `from_parents`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copse.functions.values import let
from copse.operators import spread
from copse.sources.scratch import forget, written

PLACES = ["start_row", "start_column", "end_row", "end_column", "start_byte", "end_byte"]
COLUMNS = ["doc_id", "node_id", "parent_id", "kind", "field", "named", "error", "missing", "path", "key", "num", "text"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, text): each file of a folder whole; doc_id is a hash of its path."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def write_text_files(texts: DataFrame, path: str) -> None:
    """`texts`(key, line): one folder `key=...` of UTF-8 text for each key, its lines in order."""
    texts.select("key", "line").repartition("key").sortWithinPartitions("key", "line").write.partitionBy("key").text(path)


def node(df: DataFrame, doc: Column, kind: Column | str, path: list[Column], node_id: Column, parent: Column | None = None, field: str | None = None, named: bool = True, key: Column | None = None, num: Column | None = None, text: Column | None = None, places: list[Column] | None = None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        doc.cast("long").alias("doc_id"),
        node_id.cast("long").alias("node_id"),
        (none if parent is None else parent).cast("long").alias("parent_id"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        F.lit(field).cast("string").alias("field"),
        F.lit(named).alias("named"),
        F.lit(False).alias("error"),
        F.lit(False).alias("missing"),
        F.array(*(p.cast("long") for p in path)).cast("array<long>").alias("path"),
        (none if key is None else key).cast("long").alias("key"),
        (none if num is None else num).cast("long").alias("num"),
        (none if text is None else text).cast("string").alias("text"),
        *(x.cast("long").alias(p) for p, x in zip(PLACES, places or [], strict=False)),
    )


def order_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> order* -> lineitem*; doc_id is the customer. text: market segment, priority, return flag; num: quantity."""
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    col = F.col
    line = [col("o_orderkey"), col("l_linenumber"), col("l_partkey"), col("l_suppkey"), col("l_quantity"), F.round(col("l_extendedprice") * 100), F.unix_date(col("l_shipdate").cast("date"))]
    root = node(c, col("c_custkey"), "customer", [], F.lit(0), key=col("c_custkey"), text=col("c_mktsegment"))
    orders = node(o, col("o_custkey"), "order", [col("o_orderkey")], F.xxhash64(F.lit("order"), "o_orderkey"), F.lit(0), "orders", key=col("o_orderkey"), text=col("o_orderpriority"))
    owned = li.join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == o.o_orderkey)
    lines = node(owned, col("o_custkey"), "lineitem", line, F.xxhash64(F.lit("lineitem"), *(x.cast("long") for x in line)), F.xxhash64(F.lit("order"), "o_orderkey"), "items", key=col("l_partkey"), num=col("l_quantity"), text=col("l_returnflag"))
    return root.unionByName(orders).unionByName(lines)


def geo_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> nation* -> customer*, supplier*; doc_id is the region. text: names."""
    r, n, c, s = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier"))
    col = F.col
    ids = {k: (lambda x, k=k: F.xxhash64(F.lit(k), x.cast("long"))) for k in ("nation", "customer", "supplier")}
    root = node(r, col("r_regionkey"), "region", [], F.lit(0), key=col("r_regionkey"), text=col("r_name"))
    nations = node(n, col("n_regionkey"), "nation", [col("n_nationkey")], ids["nation"](col("n_nationkey")), F.lit(0), "nations", key=col("n_nationkey"), text=col("n_name"))
    small = n.select("n_nationkey", "n_regionkey")
    buyers = c.join(small, c.c_nationkey == small.n_nationkey)
    sellers = s.join(small, s.s_nationkey == small.n_nationkey)
    buyers = node(buyers, col("n_regionkey"), "customer", [col("n_nationkey"), F.lit(0), col("c_custkey")], ids["customer"](col("c_custkey")), ids["nation"](col("n_nationkey")), "buyers", key=col("c_custkey"), text=col("c_name"))
    sellers = node(sellers, col("n_regionkey"), "supplier", [col("n_nationkey"), F.lit(1), col("s_suppkey")], ids["supplier"](col("s_suppkey")), ids["nation"](col("n_nationkey")), "sellers", key=col("s_suppkey"), text=col("s_name"))
    return root.unionByName(nations).unionByName(buyers).unionByName(sellers)


def running(sizes: Column, stretch: int = 32) -> Column:
    """The sum of all elements before each one, made of sums over stretches, so that a long list does not take its length squared."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def over(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(stretch)), lambda lo: total(F.slice(xs, lo + 1, F.lit(stretch))))
        starts = let(parts, lambda ps: F.transform(ps, lambda _, i: total(F.slice(ps, F.lit(1), i))))
        return let(starts, lambda at: F.transform(xs, lambda _, i: F.get(at, (i / stretch).cast("int")) + total(F.slice(xs, i - i % stretch + 1, i % stretch))))

    return let(sizes, over)


def located(pieces: Column, separator: str, stretch: int = 32) -> Column:
    """(text, column) of each piece of a text cut at `separator`: the byte where it begins, by the lengths of stretches and of what comes before it in its own."""
    width = lambda ps, lo, n: F.octet_length(F.array_join(F.slice(ps, lo + 1, n), separator)).cast("long") + len(separator)

    def over(ps: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(ps) - 1, F.lit(0)), F.lit(stretch)), lambda lo: width(ps, lo, F.lit(stretch)))
        before = lambda at, i: F.get(at, (i / stretch).cast("int")) + F.when(i % stretch == 0, 0).otherwise(width(ps, i - i % stretch, i % stretch))
        return let(running(parts), lambda at: F.transform(ps, lambda w, i: F.struct(w.alias("text"), before(at, i).alias("column"))))

    return let(pieces, over)


def text_forest(spark: SparkSession, sf_dir: str, places: bool = False) -> DataFrame:
    """document -> line* -> word*, cut at newlines and single spaces; num: position under the parent. An empty piece is a node with empty text."""
    col = F.col
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = F.split("text", "\n", -1)
    rows = located(rows, "\n") if places else F.transform(rows, lambda x: F.struct(x.alias("text"), F.lit(None).cast("long").alias("column")))
    lines = d.select("doc_id", F.posexplode(rows).alias("row", "found")).select("doc_id", "row", col("found.text").alias("line"), col("found.column").alias("byte"))
    line_id = (col("row").cast("long") + 1) * (1 << 32)
    pieces = F.split("line", " ", -1)
    if places:
        pieces = located(pieces, " ")
    words = lines.select("doc_id", "row", "byte", F.posexplode(pieces).alias("at", "word"))
    word, start = (col("word.text"), col("word.column")) if places else (col("word"), F.lit(None))
    bytes_ = lambda x: F.octet_length(x).cast("long")
    height = F.length("text") - F.length(F.replace(col("text"), F.lit("\n"), F.lit("")))
    none = F.lit(0)
    whole = [none, none, height, bytes_(F.substring_index("text", "\n", -1)), none, bytes_("text")] if places else None
    across = [col("row"), none, col("row"), bytes_("line"), col("byte"), col("byte") + bytes_("line")] if places else None
    within = [col("row"), start, col("row"), start + bytes_(word), col("byte") + start, col("byte") + start + bytes_(word)] if places else None
    root = node(d, col("doc_id"), "document", [], F.lit(0), key=col("doc_id"), text=col("text"), places=whole)
    line = node(lines, col("doc_id"), "line", [col("row")], line_id, F.lit(0), "lines", key=col("row"), num=col("row"), text=col("line"), places=across)
    words = node(words, col("doc_id"), "word", [col("row"), col("at")], line_id + col("at") + 1, line_id, "words", key=col("at"), num=col("at"), text=word, places=within)
    return root.unionByName(line).unionByName(words)


def chat_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversation -> one node a turn, of its role's kind; num: turn."""
    return turns_forest(table(spark, sf_dir, "conversations"))


def turns_forest(c: DataFrame) -> DataFrame:
    """The same of `c`(conv_id, turn, role, text)."""
    root = node(c.select("conv_id").distinct(), F.col("conv_id"), "conversation", [], F.lit(-1), key=F.col("conv_id"))
    return root.unionByName(node(c, F.col("conv_id"), F.col("role"), [F.col("turn")], F.col("turn"), F.lit(-1), "turns", key=F.col("turn"), num=F.col("turn"), text=F.col("text")))


def json_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object -> pair* -> key, value of each event's flat `props`; the key is an anonymous node, the value a named one. The table is read once."""
    e = table(spark, sf_dir, "events").select("event_id", F.array_sort(F.map_entries(F.from_json("props", "map<string,string>"))).alias("pairs"))

    def made(kind: str, field: str | None, node_id: Column, parent: Column | None, path: list[Column], named: bool = True, num: Column | None = None, text: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(
            node_id.cast("long").alias("node_id"),
            (none if parent is None else parent).cast("long").alias("parent_id"),
            F.lit(kind).alias("kind"),
            F.lit(field).cast("string").alias("field"),
            F.lit(named).alias("named"),
            F.array(*(x.cast("long") for x in path)).cast("array<long>").alias("path"),
            (none if num is None else num).cast("long").alias("num"),
            (none if text is None else text).cast("string").alias("text"),
        )

    def pair(p: Column, at: Column) -> Column:
        own = (at.cast("long") + 1) * 4
        return F.array(made("pair", "pairs", own, F.lit(0), [at], num=at), made("key", "key", own + 1, own, [at, F.lit(0)], False, text=p["key"]), made("value", "value", own + 2, own, [at, F.lit(1)], text=p["value"]))

    nodes = F.concat(F.array(made("object", None, F.lit(0), None, [])), F.coalesce(F.flatten(F.transform("pairs", pair)), F.array()))
    rows = e.select(F.col("event_id").cast("long").alias("doc_id"), F.explode(nodes).alias("n")).select("doc_id", "n.*")
    key = F.when(F.col("kind") == "object", F.col("doc_id"))
    return rows.withColumns({"error": F.lit(False), "missing": F.lit(False), "key": key}).select(*COLUMNS)


_VOID = {"area", "base", "br", "col", "hr", "img", "input", "link", "meta", "source", "wbr"}


class _Tags(HTMLParser):
    """Rows (node, parent, kind, attribute href, error, missing, text, path, start row, column, end row, column) of one page.

    Node numbers are in document order. A node whose end tag is missing ends where the tag that closes it begins. Text between two
    tags or comments is one node, whatever the pieces that the parser gives it in; blank text is none.
    """

    def __init__(self, html: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.lines = html.split("\n")
        end = (len(self.lines) - 1, len(self.lines[-1].encode(errors="replace")))
        self.rows: list[list] = [[0, None, "page", None, False, False, None, [], 0, 0, *end]]
        self.open, self.ending, self.last, self.saying = [0], [], end, False

    def at(self) -> tuple[int, int]:
        """Where the piece that is read now begins; what the piece before closed ends here."""
        row, column = self.getpos()
        place = (row - 1, len(self.lines[row - 1][:column].encode(errors="replace"))) if row <= len(self.lines) else self.last
        for i in self.ending:
            self.rows[i][10:] = place
        self.ending, self.saying = [], False
        return place

    def _add(self, kind: str, href: str | None = None, error: bool = False, text: str | None = None) -> None:
        self.rows.append([len(self.rows), self.open[-1], kind, href, error, False, text, [*self.rows[self.open[-1]][7], len(self.rows)], *self.at(), *self.last])
        self.ending.append(len(self.rows) - 1)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, dict(attrs).get("href"))

    def handle_starttag(self, tag, attrs):
        self.handle_startendtag(tag, attrs)
        if tag not in _VOID:
            self.open.append(self.ending.pop())

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.rows[self.open[i]][2] == tag), 0)
        if not at:
            self._add(tag, error=True)
            return
        place = self.at()
        for i in self.open[at + 1 :]:
            self.rows[i][5] = True  # its end is missing
            self.rows[i][10:] = place
        self.ending.append(self.open[at])
        del self.open[at:]

    def handle_data(self, data):
        if self.saying:  # more of the same text
            self.rows[-1][6] += data
        elif data.strip():
            self._add("text", text=data)
            self.saying = True
        else:
            self.at()

    def handle_comment(self, data):
        self.at()

    handle_decl = handle_pi = unknown_decl = handle_comment


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "node", "parent", "tag", "href", "error", "missing", "text", "path", *PLACES]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.list_(pa.int64()), *[pa.int64()] * 6]
    for whole in batches:
        for lo in range(0, whole.num_rows, 128):
            batch, cols = whole.slice(lo, 128), [[] for _ in names]
            for page, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                parser = _Tags(html or "")
                parser.feed(html or "")
                parser.close()
                for i in parser.open[1:]:
                    parser.rows[i][5] = True
                starts = [0, *accumulate(len(x.encode(errors="replace")) + 1 for x in parser.lines)]
                for row in parser.rows:
                    for c, v in zip(cols, [page, *row, starts[row[8]] + row[9], starts[row[10]] + row[11]], strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=names)


def html_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page -> elements and text, with their places; elements never closed are `missing`, stray end tags `error`; `href`: that attribute of an element."""
    return pages_forest(table(spark, sf_dir, "pages"))


def pages_forest(pages: DataFrame) -> DataFrame:
    """The same of `pages`(page_id, html)."""
    rows = pages.select("page_id", "html").mapInArrow(_pages, "page_id long, node long, parent long, tag string, href string, error boolean, missing boolean, text string, path array<long>, " + ", ".join(f"{p} long" for p in PLACES))
    return rows.select(F.col("page_id").alias("doc_id"), F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), F.col("tag").alias("kind"), F.lit(None).cast("string").alias("field"), F.lit(True).alias("named"), "error", "missing", "path", F.col("node").alias("key"), F.lit(None).cast("long").alias("num"), "text", *PLACES, "href")


def with_source(matches: DataFrame, documents: DataFrame, capture: str, name: str) -> DataFrame:
    """`matches` with column `name`: the bytes that capture `capture` covers in its document's text, of `documents`(doc_id, text), whatever its kind."""
    texts = documents.select(F.col("doc_id").alias("_doc"), F.encode("text", "UTF-8").alias("_bytes"))
    node = F.col(capture)
    cut = F.substring("_bytes", (node["start_byte"] + 1).cast("int"), (node["end_byte"] - node["start_byte"]).cast("int"))
    return matches.join(texts, F.col("doc_id") == F.col("_doc"), "left").withColumn(name, F.decode(cut, "UTF-8")).drop("_doc", "_bytes")


def _raked(inner: DataFrame) -> tuple[list[DataFrame], DataFrame | None, list[DataFrame]]:
    """Tiers of `inner`(doc_id, node_id, parent_id, nth, n), nodes with n children, from below; what is left, if any; and the tables written. All with `size`, the nodes of the whole subtree.

    A tier is the nodes that have no inner children but those of the tiers before it. Tiers are taken off while each holds half of the nodes or more; the size of what is left counts
    a node and what was taken off below it.
    """
    below = inner.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("_below"))
    waits = F.coalesce("_below", F.lit(0))
    rest = inner.join(below, ["doc_id", "node_id"], "left").select("doc_id", "node_id", "parent_id", "nth", waits.alias("waits"), (1 + F.col("n") - waits).alias("size"))
    tiers, tables = [], []
    while True:
        rest = written(rest, "tier")
        tables.append(rest)
        ready, waiting = rest.agg(F.count_if(F.col("waits") == 0), F.count_if(F.col("waits") > 0)).first()
        if ready < waiting:
            return tiers, rest, tables
        tiers.append(rest.where("waits = 0").drop("waits"))
        if not waiting:
            return tiers, None, tables
        done = tiers[-1].groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("_n"), F.sum("size").alias("_size"))
        less = lambda x: F.coalesce(x, F.lit(0))
        rest = rest.where("waits > 0").join(done, ["doc_id", "node_id"], "left").select("doc_id", "node_id", "parent_id", "nth", (F.col("waits") - less("_n")).alias("waits"), (F.col("size") + less("_size")).alias("size"))


def _walked(walk: DataFrame, wide: bool) -> DataFrame:
    """(doc_id, node_id, parent_id, nth, enter, exit, depth) of the nodes of `walk`(doc_id, node_id, parent_id, nth, size, leaves), which no tier holds: one list a document, ranked by pointer doubling.

    `leaves`: the nodes in subtrees of tiers and leaves among the elder siblings. They are not in the list: its steps count them.
    """
    one = F.struct("node_id", "leaves")
    places = walk
    first = walk.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.min_by(one, F.col("nth")).alias("first"))
    if wide:
        numbers = spread.numbered(walk, ["doc_id", "parent_id"], ["nth"], "_at")
        later = numbers.select(F.col("doc_id").alias("_doc"), F.col("parent_id").alias("_parent"), (F.col("_at") - 1).alias("_before"), one.alias("next"))
        walk = numbers.join(later, (F.col("doc_id") == F.col("_doc")) & F.col("parent_id").eqNullSafe(F.col("_parent")) & (F.col("_at") == F.col("_before")), "left")
    else:
        walk = walk.withColumn("next", F.lead(one).over(Window.partitionBy("doc_id", "parent_id").orderBy("nth")))
    walk = walk.select("doc_id", "node_id", "parent_id", "leaves", (F.col("size") - 1).alias("own"), "next").join(first, ["doc_id", "node_id"], "left")
    walk = walk.join(places.select("doc_id", F.col("node_id").alias("parent_id"), (F.col("size") - 1).alias("all")), ["doc_id", "parent_id"], "left")

    def event(node: Column, side: int) -> Column:
        return F.struct(node.alias("node"), F.lit(side).alias("side"))

    enter = F.struct(event(F.col("node_id"), 0).alias("id"), F.when(F.col("first").isNotNull(), event(F.col("first.node_id"), 0)).otherwise(event(F.col("node_id"), 1)).alias("to"), F.coalesce("first.leaves", "own").alias("gap"))
    to = F.when(F.col("next").isNotNull(), event(F.col("next.node_id"), 0)).when(F.col("parent_id").isNotNull(), event(F.col("parent_id"), 1))
    leave = F.struct(event(F.col("node_id"), 1).alias("id"), to.alias("to"), (F.coalesce("next.leaves", "all", F.lit(0)) - F.col("leaves")).alias("gap"))
    links = written(walk.select("doc_id", F.explode(F.array(enter, leave)).alias("e")).select("doc_id", "e.*"), "walk")
    ranked = spread.ends(links, way=1 + 2 * F.col("gap"), entered=F.when(F.col("id.side") == 0, 1).otherwise(0) + F.col("gap"))
    final = links.where("to is null").select("doc_id", F.col("id").alias("end"))
    found = ranked.where("end is not null").join(final, ["doc_id", "end"], "left_semi")  # a chain that ends elsewhere hangs on a missing parent
    lead = places.where("parent_id is null").groupBy("doc_id").agg(F.min("leaves").alias("lead"))  # what comes before the first root of the list
    total = found.groupBy("doc_id").agg(F.max("way").alias("most"), F.max("entered").alias("nodes")).join(lead, "doc_id")
    total = total.select("doc_id", (F.col("most") + 2 * F.col("lead")).alias("most"), (F.col("nodes") + F.col("lead")).alias("nodes"))
    at = found.join(total, "doc_id").select("doc_id", "id", (F.col("most") - F.col("way")).alias("at"), (F.col("nodes") - F.col("entered")).alias("pre"))
    at = at.unionByName(final.join(total, "doc_id").select("doc_id", F.col("end").alias("id"), F.col("most").alias("at"), F.col("nodes").alias("pre")))
    side = lambda s, x: F.max(F.when(F.col("id.side") == s, x))
    own = at.groupBy("doc_id", F.col("id.node").alias("node_id")).agg(side(0, F.col("at")).alias("enter"), side(1, F.col("at")).alias("exit"), side(0, 2 * F.col("pre") - F.col("at")).alias("depth"))
    out = written(places.select("doc_id", "node_id", "parent_id", "nth").join(own, ["doc_id", "node_id"]), "placed")
    forget(links)
    return out


def from_parents(nodes: DataFrame, *order: str, wide: bool = False) -> DataFrame:
    """`nodes`(doc_id, node_id, parent_id, ...) with `enter` and `exit`, places in a walk around each document's trees, and `depth`; siblings in the order of the columns `order`, ties by node_id.

    A node lies below another where its places lie between the other's. Each node is entered, its children are walked in turn, and it is left. Only ids and numbers among siblings go through
    the rounds, and nodes without children are in none: they take their places from what is before them, their parent's or an elder sibling's. The others are taken off from below, tier by tier,
    with the size of their subtrees, as long as a tier holds half of what is left, so all tiers cost little more than the first; they are placed from above. What is left then (deep trees) is one
    list a document, ranked by pointer doubling, so the rounds grow with the logarithm of a document's nodes, however deep its trees, and no path is made. Nodes whose parent is not there,
    or that hang on themselves, have no places. `wide`: for parents with more children than a task can hold, whose order is then cut into ranges.
    """
    keys, by = ["doc_id", "parent_id"], [*order, "node_id"]
    rows = nodes.select("doc_id", "node_id", "parent_id", *order)
    rows = spread.numbered(rows, keys, by, "nth") if wide else rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) - 1)
    born = written(rows.select("doc_id", "node_id", "parent_id", F.col("nth").cast("long").alias("nth")), "born")
    ranges = [rows] if wide else []  # tables that are read until the next one is written
    has = born.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg((F.max("nth") + 1).alias("n"))
    inner = written(born.join(has, ["doc_id", "node_id"]), "inner")
    tiers, left, tables = _raked(inner)
    rows = reduce(DataFrame.unionByName, [t.drop("waits").withColumn("tier", F.lit(i)) for i, t in enumerate([*tiers, *([left] if left else [])])])
    in_list = F.col("tier") == len(tiers)
    more = F.when(in_list, -1).otherwise(F.col("size") - 1)  # than the one that `nth` counts
    listed = F.when(in_list, F.struct("node_id", "leaves"))
    if wide:
        ranges.append(sums := spread.summed(rows, keys, ["nth"], more, "more"))
        ranges.append(rows := spread.carried(sums.withColumn("leaves", F.col("nth") + F.col("more")).withColumn("listed", listed), keys, ["nth"], "listed", "elder"))  # a node of a tier has none of its own, so what is carried to it is from before
    else:
        before = Window.partitionBy(*keys).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("leaves", F.col("nth") + F.coalesce(F.sum(more).over(before), F.lit(0))).withColumn("elder", F.last(listed, True).over(before))
    rows = written(rows.select("doc_id", "node_id", "parent_id", "nth", "size", "tier", "leaves", "elder"), "siblings")
    for table in (inner, *tables, *ranges):
        forget(table)
    placed = [_walked(rows.where(in_list), wide)] if left else []
    root, elder = F.col("parent_id").isNull(), F.col("elder").isNotNull()
    for i in reversed(range(len(tiers))):
        known = reduce(DataFrame.unionByName, placed) if placed else rows.where("false").select("doc_id", "node_id", *(F.lit(None).cast("long").alias(x) for x in ("enter", "exit", "depth")))
        known = known.select("doc_id", F.col("node_id").alias("base"), F.struct("enter", "exit", "depth").alias("at"))
        own = rows.where(F.col("tier") == i).withColumn("base", F.coalesce("elder.node_id", "parent_id")).join(known, ["doc_id", "base"], "left")
        start = F.when(elder, F.col("at.exit")).when(root, -1).otherwise(F.col("at.enter")) + 1 + 2 * (F.col("leaves") - F.coalesce("elder.leaves", F.lit(0)))
        depth = F.when(elder, F.col("at.depth")).when(root, 0).otherwise(F.col("at.depth") + 1)
        own = own.select("doc_id", "node_id", "parent_id", "nth", start.alias("enter"), (start + 2 * F.col("size") - 1).alias("exit"), depth.cast("long").alias("depth"))
        placed.append(written(own.where("enter is not null"), "placed"))

    def mark(parent: str, nth: Column, last: str, depth: Column) -> Column:
        return F.struct(F.col(parent).alias("parent_id"), nth.cast("long").alias("nth"), F.struct(nth.cast("long").alias("nth"), "enter", F.col(last).alias("exit"), depth.alias("depth")).alias("mark"))

    marks = [t.select("doc_id", F.explode(F.array(mark("parent_id", F.col("nth"), "exit", F.col("depth")), mark("node_id", F.lit(-1), "enter", F.col("depth") + 1))).alias("m")).select("doc_id", "m.*", F.lit(0).alias("turn")) for t in placed]
    both = reduce(DataFrame.unionByName, marks).unionByName(born.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    if wide:
        both = told = spread.carried(both, keys, ["nth", "turn"], "mark", "last")
    else:
        both = both.withColumn("last", F.last("mark", True).over(Window.partitionBy(*keys).orderBy("nth", "turn").rowsBetween(Window.unboundedPreceding, 0)))
    top = F.when(root, F.struct(*(F.lit(x).cast("long").alias(n) for n, x in {"nth": -1, "enter": None, "exit": -1, "depth": 0}.items())))
    both = both.where("turn = 1").select("doc_id", "node_id", "nth", F.coalesce("last", top).alias("last"))
    itself = F.col("last.nth") == F.col("nth")
    start = F.when(itself, F.col("last.enter")).otherwise(F.col("last.exit") + 1 + 2 * (F.col("nth") - F.col("last.nth") - 1))
    found = both.where("last is not null").select("doc_id", "node_id", start.alias("enter"), F.when(itself, F.col("last.exit")).otherwise(start + 1).alias("exit"), F.col("last.depth").alias("depth"))
    found = written(found, "places")
    for table in (born, rows, *placed, *([told] if wide else [])):
        forget(table)
    return nodes.join(found, ["doc_id", "node_id"], "left")
