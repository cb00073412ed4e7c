"""Queries over the forests, one for each operator, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.functions import standard, values
from copse.operators import graphs, loops, scoping
from copse.operators import patterns as p
from copse.sources import forests, scratch
from copse.streaming import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f"q_{f.__name__}"] = f
        if sql:
            ORACLES[f"q_{f.__name__}"] = sql
        return f

    return add


def orders(spark: SparkSession, sf_dir: str, items: str | None = None, least: int = 0) -> DataFrame:
    """Orders as capture `o`, and their lines as a list if named."""
    forest = forests.order_forest(spark, sf_dir)
    m = p.match(forest, "o", "order")
    return p.repeated(m, forest, "o", items, "lineitem", least=least) if items else m


def lists(x: str | Column, field: str) -> Column:
    return F.transform(x, lambda e: e[field])


LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"

# --- patterns -------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS k, o_orderpriority AS priority FROM orders")
def match_kind(spark, sf_dir):
    return p.match(forests.order_forest(spark, sf_dir), "o", "order").select(c("o.key").alias("k"), c("o.text").alias("priority"))


@query("SELECT 'pair' AS kind, count(*) AS n FROM events UNION ALL SELECT 'value', count(*) FROM events UNION ALL SELECT 'object', count(*) FROM events")
def match_wildcard(spark, sf_dir):
    return p.match(forests.json_forest(spark, sf_dir), "x").groupBy(c("x.kind").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT event_id AS doc_id, 'k' AS token FROM events")
def match_anonymous(spark, sf_dir):
    return p.match(forests.json_forest(spark, sf_dir), "x", named=False).select("doc_id", c("x.text").alias("token"))


@query("SELECT o_orderkey AS k, l_partkey AS part, CAST(l_quantity AS BIGINT) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def child_join(spark, sf_dir):
    forest = forests.order_forest(spark, sf_dir)
    m = p.child(p.match(forest, "o", "order"), forest, "o", "l", "lineitem")
    return m.select(c("o.key").alias("k"), c("l.key").alias("part"), c("l.num").alias("quantity"))


@query("SELECT o_custkey AS cust, o_orderkey AS k, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2")
def grandchild_join(spark, sf_dir):
    forest = forests.order_forest(spark, sf_dir)
    m = p.child(p.child(p.match(forest, "c", "customer"), forest, "c", "o", "order"), forest, "o", "l", "lineitem")
    return m.groupBy(c("c.key").alias("cust"), c("o.key").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT n_name AS nation, s_name AS seller FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def field(spark, sf_dir):
    forest = forests.geo_forest(spark, sf_dir)
    m = p.child(p.match(forest, "n", "nation"), forest, "n", "x", field="sellers")
    return m.select(c("n.text").alias("nation"), c("x.text").alias("seller"))


@query("SELECT o_orderkey AS k, l_partkey AS part, l_partkey IS NOT NULL AS has_some, l_partkey IS NULL AS has_none FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey")
def optional(spark, sf_dir):
    forest = forests.order_forest(spark, sf_dir)
    m = p.child(p.match(forest, "o", "order"), forest, "o", "l", "lineitem", where=c("text") == "R", optional=True)
    return m.select(c("o.key").alias("k"), c("l.key").alias("part"), c("l").isNotNull().alias("has_some"), c("l").isNull().alias("has_none"))


@query(f"SELECT o_orderkey AS k, coalesce(list(l_partkey ORDER BY {LINE_ORDER}) FILTER (l_partkey IS NOT NULL), []) AS parts, count(l_partkey) AS n, count(l_partkey) = 0 AS none FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def star(spark, sf_dir):
    items = c("items")
    return orders(spark, sf_dir, "items").select(c("o.key").alias("k"), lists(items, "key").alias("parts"), standard.length(items).alias("n"), standard.is_empty(items).alias("none"))


@query(f"SELECT o_orderkey AS k, list(l_partkey ORDER BY {LINE_ORDER}) AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def plus(spark, sf_dir):
    return orders(spark, sf_dir, "items", least=1).select(c("o.key").alias("k"), lists("items", "key").alias("parts"))


@query("SELECT n_name AS nation, c_name AS buyer, NULL::VARCHAR AS seller FROM nation JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT n_name, NULL, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def alternation(spark, sf_dir):
    forest = forests.geo_forest(spark, sf_dir)
    n = p.match(forest, "n", "nation")
    m = p.either(p.child(n, forest, "n", "b", "customer"), p.child(n, forest, "n", "s", "supplier"))
    return m.select(c("n.text").alias("nation"), c("b.text").alias("buyer"), c("s.text").alias("seller"))


@query("SELECT conv_id AS doc_id, u.turn AS first, a.turn AS later FROM conversations u JOIN conversations a USING (conv_id) WHERE u.role = 'user' AND a.role = 'assistant' AND u.turn < a.turn")
def sibling_order(spark, sf_dir):
    forest = forests.chat_forest(spark, sf_dir)
    m = p.child(p.child(p.match(forest, "v", "conversation"), forest, "v", "u", "user"), forest, "v", "a", "assistant")
    return m.where(p.before("u", "a")).select("doc_id", c("u.num").alias("first"), c("a.num").alias("later"))


@query("SELECT conv_id AS doc_id, role AS kind, turn, turn = min(turn) OVER w AS is_first, turn = max(turn) OVER w AS is_last FROM conversations WINDOW w AS (PARTITION BY conv_id)")
def anchor_first_last(spark, sf_dir):
    nodes = p.ends(forests.chat_forest(spark, sf_dir)).where("parent_id is not null")
    return nodes.select("doc_id", "kind", c("num").alias("turn"), "is_first", "is_last")


@query("WITH t AS (SELECT *, lead(role) OVER w AS next_role, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id AS doc_id, turn AS asked, next_turn AS answered FROM t WHERE role = 'user' AND next_role = 'assistant'")
def adjacent(spark, sf_dir):
    nodes = p.ends(forests.chat_forest(spark, sf_dir))
    asked = p.match(nodes, "u", "user")
    answers = nodes.where("kind = 'assistant'").select(c("doc_id").alias("d"), c("previous"), c("num").alias("answered"))
    m = asked.join(answers, (c("doc_id") == c("d")) & (c("u.node_id") == c("previous")))
    return m.select("doc_id", c("u.num").alias("asked"), "answered")


@query("SELECT o_orderkey AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def negated(spark, sf_dir):
    forest = forests.order_forest(spark, sf_dir)
    return p.without(p.match(forest, "o", "order"), forest, "o", field="items").select(c("o.key").alias("k"))


@query("SELECT o_orderkey AS k FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def uncaptured_child(spark, sf_dir):
    forest = forests.order_forest(spark, sf_dir)
    return p.having(p.match(forest, "o", "order"), forest, "o", "lineitem", where=c("text") == "R").select(c("o.key").alias("k"))


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'")
def pred_eq(spark, sf_dir):
    return p.match(forests.order_forest(spark, sf_dir), "o", "order", where=c("text") == "1-URGENT").select(c("o.key").alias("k"))


@query("SELECT o_orderkey AS k FROM orders WHERE regexp_matches(o_orderpriority, '^[2-4]-[A-Z]+')")
def pred_match(spark, sf_dir):
    return p.match(forests.order_forest(spark, sf_dir), "o", "order", where=standard.matches(c("text"), "^[2-4]-[A-Z]+")).select(c("o.key").alias("k"))


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderpriority <> '1-URGENT' AND NOT regexp_matches(o_orderpriority, '^[0-9]-[A-L]+')")
def pred_not(spark, sf_dir):
    where = (c("text") != "1-URGENT") & ~standard.matches(c("text"), "^[0-9]-[A-L]+")
    return p.match(forests.order_forest(spark, sf_dir), "o", "order", where=where).select(c("o.key").alias("k"))


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def pred_anyof(spark, sf_dir):
    return p.match(forests.order_forest(spark, sf_dir), "o", "order", where=c("text").isin("1-URGENT", "5-LOW")).select(c("o.key").alias("k"))


@query("WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS g FROM conversations) SELECT conv_id AS doc_id, min(turn) AS first, count(*) AS n FROM t WHERE role = 'user' GROUP BY conv_id, g")
def runs(spark, sf_dir):
    r = p.runs(forests.chat_forest(spark, sf_dir), "user")
    return r.select("doc_id", F.element_at("nodes", 1)["num"].alias("first"), F.size("nodes").cast("long").alias("n"))


@query("SELECT n_nationkey AS k, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS members FROM nation")
def supertypes(spark, sf_dir):
    forest = forests.geo_forest(spark, sf_dir)
    steps = spark.createDataFrame([("place", "region"), ("place", "nation"), ("party", "customer"), ("party", "supplier"), ("any", "place"), ("any", "party")], "supertype string, kind string")
    kinds = p.closed(steps)
    m = p.child(p.match(p.of_supertype(forest, kinds, "place", "nation"), "n"), p.of_supertype(forest, kinds, "party"), "n", "x")
    return m.groupBy(c("n.key").alias("k")).agg(F.count("*").alias("members"))


@query("SELECT 0 AS stanza, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS match_ord FROM orders UNION ALL SELECT 1, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) FROM orders WHERE o_orderpriority = '5-LOW'")
def visit_matches(spark, sf_dir):
    forest = forests.order_forest(spark, sf_dir)
    m = p.stanzas({0: p.match(forest, "full", "order"), 1: p.match(forest, "full", "order", where=c("text") == "5-LOW")})
    return p.ordered(m, "full").select("stanza", c("full.key").alias("k"), c("match_ord").cast("long").alias("match_ord"))


@query("SELECT o_custkey AS doc_id, o_orderkey AS full_key, l_partkey AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'A'")
def full_capture(spark, sf_dir):
    forest = forests.order_forest(spark, sf_dir)
    m = p.child(p.match(forest, "full", "order"), forest, "full", "x", "lineitem", where=c("text") == "A")
    return m.select("doc_id", c("full.key").alias("full_key"), c("x.key").alias("part"))


def _marked(spark, sf_dir) -> DataFrame:
    """Orders with marks: some customers and orders are errors, some lines missing."""
    error = ((c("kind") == "customer") & (c("text") == "BUILDING")) | ((c("kind") == "order") & (c("text") == "5-LOW"))
    forest = forests.order_forest(spark, sf_dir).withColumn("error", error)
    return forest.withColumn("missing", (c("kind") == "lineitem") & (c("text") == "A"))


_MARKED = """
  SELECT c_custkey AS doc_id, 'customer' AS kind, NULL::BIGINT AS k, NULL::BIGINT AS line, true AS error, false AS missing FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT o_custkey, 'order', o_orderkey, NULL, true, false FROM orders LEFT JOIN customer ON c_custkey = o_custkey
    WHERE o_orderpriority = '5-LOW' AND c_mktsegment IS DISTINCT FROM 'BUILDING'
  UNION ALL SELECT o_custkey, 'lineitem', o_orderkey, l_linenumber, false, true FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey
    WHERE l_returnflag = 'A' AND o_orderpriority <> '5-LOW' AND c_mktsegment IS DISTINCT FROM 'BUILDING'
"""


@query(_MARKED)
def parse_errors(spark, sf_dir):
    found = p.parse_errors(_marked(spark, sf_dir))
    return found.select("doc_id", "kind", F.get("path", F.lit(0)).alias("k"), F.get("path", F.lit(1)).alias("line"), "error", "missing")


@query(f"SELECT doc_id, kind, error, missing FROM ({_MARKED}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(k, -1), coalesce(line, -1)) = 1")
def first_parse_error(spark, sf_dir):
    return p.first_error(p.parse_errors(_marked(spark, sf_dir))).drop("node_id")


#: The same errors by another way: tags and texts cut by patterns, and a stack walked over them a step at a time.
_HTML_ERRORS = r"""
WITH RECURSIVE plain AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '<!>', 'gs'), '<(script|style)([^>]*)></(script|style)>', '<\1\2></\3 >', 'g'),
    '<(script|style)([^>]*)>.*?</(script|style)>', '<\1\2>x</\3>', 'gs') AS html FROM pages
), pieces AS (SELECT page_id, regexp_extract_all(html, '<[a-zA-Z/!][^>]*>|[^<]+|<') AS found FROM plain),
pieced AS (SELECT page_id, unnest(found) AS piece, generate_subscripts(found, 1) AS i FROM pieces),
kinds AS (SELECT *, CASE WHEN piece LIKE '</%' THEN 'end' WHEN piece LIKE '<!%' THEN 'skip' WHEN regexp_matches(piece, '^<[a-zA-Z]') THEN 'start' ELSE 'text' END AS what FROM pieced),
stretches AS (SELECT *, sum((what <> 'text')::INT) OVER (PARTITION BY page_id ORDER BY i) AS stretch FROM kinds),
whole AS (SELECT page_id, i, what, piece FROM stretches WHERE what IN ('start', 'end')
  UNION ALL SELECT page_id, min(i), 'text', string_agg(piece, '' ORDER BY i) FROM stretches WHERE what = 'text' GROUP BY page_id, stretch HAVING regexp_matches(string_agg(piece, ''), '\S')),
steps AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS i, what, lower(regexp_extract(piece, '^</?([a-zA-Z][^\s/>]*)', 1)) AS tag,
    piece LIKE '%/>' OR lower(regexp_extract(piece, '^<([a-zA-Z][^\s/>]*)', 1)) IN ('area', 'base', 'br', 'col', 'hr', 'img', 'input', 'link', 'meta', 'source', 'wbr') AS single FROM whole),
walk AS (
  SELECT page_id, 0::BIGINT AS i, 0::BIGINT AS n, [{'node': 0::BIGINT, 'tag': ''}] AS stack, ''::VARCHAR AS what, NULL::BIGINT AS made, ''::VARCHAR AS tag, [0::BIGINT] AS above, []::BIGINT[] AS missing FROM pages
  UNION ALL
  SELECT w.page_id, s.i, w.n + grows, CASE WHEN s.what = 'start' AND NOT s.single THEN list_append(stack, {'node': w.n + 1, 'tag': s.tag}) WHEN s.what = 'end' AND pos > 0 THEN stack[:pos - 1] ELSE stack END,
    s.what, CASE WHEN grows = 1 THEN w.n + 1 END, s.tag, list_transform(stack, lambda x: x.node), CASE WHEN s.what = 'end' AND pos > 0 THEN list_transform(stack[pos + 1:], lambda x: x.node) ELSE [] END
  FROM walk w JOIN steps s ON s.page_id = w.page_id AND s.i = w.i + 1,
    LATERAL (SELECT CASE WHEN s.what = 'end' AND list_contains(list_transform(stack[2:], lambda x: x.tag), s.tag) THEN len(stack) + 1 - list_position(list_reverse(list_transform(stack, lambda x: x.tag)), s.tag) ELSE 0 END AS pos) p,
    LATERAL (SELECT CASE WHEN s.what = 'end' AND pos > 0 THEN 0 ELSE 1 END AS grows) g
), unclosed AS (SELECT page_id, unnest(missing) AS node FROM walk UNION ALL SELECT page_id, unnest(list_transform(stack[2:], lambda x: x.node)) FROM walk QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i DESC) = 1),
marked AS (SELECT page_id, list(node) AS nodes FROM unclosed GROUP BY 1),
bad AS (SELECT w.page_id, made, tag, what, above, coalesce(nodes, []) AS nodes FROM walk w LEFT JOIN marked m USING (page_id) WHERE what = 'end' AND made IS NOT NULL OR list_contains(nodes, made))
SELECT page_id AS doc_id, made AS node_id, tag AS kind, what = 'end' AS error, what = 'start' AS missing FROM bad WHERE NOT list_has_any(above, nodes)
"""


@query(_HTML_ERRORS)
def html_errors(spark, sf_dir):
    return p.parse_errors(forests.html_forest(spark, sf_dir)).select("doc_id", "node_id", "kind", "error", "missing")


@query(f"SELECT * FROM ({_HTML_ERRORS}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY node_id) = 1")
def html_first_error(spark, sf_dir):
    return p.first_error(p.parse_errors(forests.html_forest(spark, sf_dir)))


@query("SELECT r_regionkey AS k, string_agg(n_name || chr(10), '' ORDER BY n_name) AS text FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def source_files(spark, sf_dir):
    """Nations written as a text file a region, and read back whole."""
    nations = forests.table(spark, sf_dir, "nation").select(c("n_regionkey").alias("key"), c("n_name").alias("line"))
    forests.write_text_files(nations, folder := scratch.folder(spark, "sources"))
    files = forests.text_files(spark, folder)
    return files.select(F.regexp_extract("path", "key=([0-9]+)", 1).cast("long").alias("k"), "text")


@query("SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark, sf_dir):
    return p.match(forests.html_forest(spark, sf_dir), "a", "a").where("a.href is not null").select("doc_id", c("a.href").alias("href"))


# --- statements -----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS k, CASE WHEN n = 0 THEN 'none' WHEN n = 1 AND o_orderpriority = '1-URGENT' THEN 'urgent' WHEN n <= 3 THEN 'small' ELSE 'large' END AS size FROM (SELECT o_orderkey, any_value(o_orderpriority) AS o_orderpriority, count(l_partkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)")
def if_elif_else(spark, sf_dir):
    n = F.size("items")
    arm = F.when(n == 0, "none").when((n == 1) & (c("o.text") == "1-URGENT"), "urgent").when(n <= 3, "small").otherwise("large")
    return orders(spark, sf_dir, "items").select(c("o.key").alias("k"), arm.alias("size"))


@query("SELECT o_orderkey AS k, length(o_orderpriority) AS n, CASE WHEN o_orderpriority LIKE '1%' THEN length(o_orderpriority) + 100 ELSE length(o_orderpriority) END AS v FROM orders")
def let_var_set(spark, sf_dir):
    m = orders(spark, sf_dir).withColumn("n", F.length("o.text").cast("long")).withColumn("v0", c("n"))
    m = m.withColumn("v", F.when(c("o.text").startswith("1"), c("v0") + 100).otherwise(c("v0")))
    return m.select(c("o.key").alias("k"), "n", "v")


@query("SELECT DISTINCT n_nationkey AS source, c_mktsegment AS sink FROM nation JOIN customer ON c_nationkey = n_nationkey")
def edges_dedup(spark, sf_dir):
    pairs = forests.table(spark, sf_dir, "customer").select(F.lit(0).alias("doc_id"), c("c_nationkey").alias("source"), c("c_mktsegment").alias("sink"))
    return graphs.edges(pairs).select("source", "sink")


def _order_graph(spark, sf_dir) -> graphs.Graph:
    """A node for each customer and order with attributes, an edge from each customer to its orders."""
    forest = forests.order_forest(spark, sf_dir)
    nodes = graphs.numbered(p.picked(forest, ["customer", "order"]), "path")
    own = nodes.select("doc_id", "node_id", "node", "parent_id", "kind", "key", "text")
    pairs = own.where("kind = 'order'").select("doc_id", F.lit(0).cast("long").alias("source"), c("node").alias("sink"), "text")
    given = graphs.attributes(own, {"kind": values.string(c("kind")), "key": values.integer(c("key"))}, "node")
    rush = graphs.attributes(pairs.where("text = '1-URGENT'"), {"rush": values.boolean(F.lit(True))}, "source", "sink")
    return graphs.Graph(own.select("doc_id", "node"), graphs.edges(pairs), given.unionByName(rush))


@query("SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sink, 'rush' AS name, '{\"type\":\"bool\",\"bool\":true}' AS value FROM orders QUALIFY o_orderpriority = '1-URGENT'")
def edge_attr(spark, sf_dir):
    return _order_graph(spark, sf_dir).attrs.where("owner = 'edge'").select("doc_id", "sink", "name", "value")


@query("SELECT c_custkey AS doc_id, 0::BIGINT AS node, u.name, u.value FROM customer, LATERAL (SELECT 'kind' AS name, '{\"type\":\"string\",\"string\":\"customer\"}' AS value UNION ALL SELECT 'key', '{\"type\":\"int\",\"int\":' || c_custkey || '}') u UNION ALL SELECT o.doc_id, o.node, u.name, u.value FROM (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS node FROM orders) o, LATERAL (SELECT 'kind' AS name, '{\"type\":\"string\",\"string\":\"order\"}' AS value UNION ALL SELECT 'key', '{\"type\":\"int\",\"int\":' || o_orderkey || '}') u")
def node_attr(spark, sf_dir):
    return _order_graph(spark, sf_dir).attrs.where("owner = 'node'").select("doc_id", c("source").alias("node"), "name", "value")


@query("SELECT o_custkey AS doc_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS node FROM orders UNION ALL SELECT c_custkey, c_custkey, 0 FROM customer")
def node_ids(spark, sf_dir):
    forest = forests.order_forest(spark, sf_dir)
    return graphs.numbered(p.picked(forest, ["customer", "order"]), "path").select("doc_id", c("key").alias("k"), "node")


@query("SELECT c_custkey AS doc_id, 0::BIGINT AS node, count(*) AS out_edges FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def edge_count(spark, sf_dir):
    return graphs.degrees(_order_graph(spark, sf_dir).edges)


def label(x: Column) -> dict[str, Column]:
    """A shorthand: one argument, several attributes."""
    return {"label": values.string(x), "length": values.integer(F.length(x)), "labelled": values.boolean(F.lit(True))}


@query("SELECT n_nationkey AS node, u.name, u.value FROM nation, LATERAL (SELECT 'label' AS name, '{\"type\":\"string\",\"string\":\"' || n_name || '\"}' AS value UNION ALL SELECT 'length', '{\"type\":\"int\",\"int\":' || length(n_name) || '}' UNION ALL SELECT 'labelled', '{\"type\":\"bool\",\"bool\":true}') u")
def attr_shorthand(spark, sf_dir):
    nodes = p.picked(forests.geo_forest(spark, sf_dir), "nation").select("doc_id", c("key").alias("node"), "text")
    return graphs.attributes(nodes, label(c("text")), "node").select(c("source").alias("node"), "name", "value")


@query("SELECT l_orderkey AS source, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def attr_conflicts(spark, sf_dir):
    lines = forests.table(spark, sf_dir, "lineitem").select(F.lit(0).alias("doc_id"), c("l_orderkey").alias("node"), "l_returnflag")
    return graphs.conflicts(graphs.attributes(lines, {"flag": values.string(c("l_returnflag"))}, "node")).select("source", "n")


@query("SELECT l_orderkey AS source, l_suppkey AS sink FROM lineitem WHERE l_quantity >= 49 EXCEPT SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N'")
def edge_attr_missing(spark, sf_dir):
    lines = forests.table(spark, sf_dir, "lineitem").select(F.lit(0).alias("doc_id"), c("l_orderkey").alias("source"), c("l_suppkey").alias("sink"), "l_quantity", "l_returnflag")
    attrs = graphs.attributes(lines.where("l_quantity >= 49"), {"bulk": values.boolean(F.lit(True))}, "source", "sink")
    return graphs.dangling(attrs, graphs.edges(lines.where("l_returnflag = 'N'"))).select("source", "sink").distinct()


@query("SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, 'turn ' || turn || ' by \"' || role || '\", ' || CASE role WHEN 'user' THEN '#true' ELSE '#false' END AS line FROM conversations")
def prints(spark, sf_dir):
    m = p.picked(forests.chat_forest(spark, sf_dir), ["user", "assistant", "system"])
    return graphs.printed(m, ["path"], "turn ", (c("num"), "long"), " by ", (c("kind"), "string"), ", ", (c("kind") == "user", "boolean"))


@query(f"SELECT o_orderkey AS k, row_number() OVER (PARTITION BY o_orderkey ORDER BY {LINE_ORDER}) - 1 AS at, l_partkey AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def for_explode(spark, sf_dir):
    m = loops.for_each(orders(spark, sf_dir, "items"), "items", "x")
    return m.select(c("o.key").alias("k"), c("at").cast("long").alias("at"), c("x.key").alias("part"))


@query(f"WITH t AS (SELECT o_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY {LINE_ORDER}) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT o_orderkey AS k, coalesce(list_reduce(list_prepend(0::BIGINT, q), lambda a, x: CASE WHEN x > 25 THEN a + x ELSE (a * 3) % 1000 END), 0) AS v FROM orders LEFT JOIN t USING (o_orderkey)")
def for_fold(spark, sf_dir):
    v = loops.fold("items", F.lit(0).cast("long"), lambda a, x: F.when(x["num"] > 25, a + x["num"]).otherwise((a * 3) % 1000))
    return orders(spark, sf_dir, "items").select(c("o.key").alias("k"), v.alias("v"))


@query(f"SELECT o_orderkey AS k, row_number() OVER w - 1 AS at, coalesce(lag(l_partkey) OVER w, -1) AS previous FROM orders JOIN lineitem ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY o_orderkey ORDER BY {LINE_ORDER})")
def carried_node(spark, sf_dir):
    m = loops.for_each(orders(spark, sf_dir, "items"), "items", "x").withColumn("k", c("o.key"))
    m = loops.chained(m, ["doc_id", "k"], ["at"], c("x.key"), F.lit(-1).cast("long"), "previous")
    return m.select("k", c("at").cast("long").alias("at"), "previous")


@query(f"SELECT o_orderkey AS k, list(CAST(l_quantity AS BIGINT) * 2 ORDER BY {LINE_ORDER}) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def list_comp(spark, sf_dir):
    return orders(spark, sf_dir, "items", 1).select(c("o.key").alias("k"), F.transform("items", lambda x: x["num"] * 2).alias("v"))


@query("SELECT o_orderkey AS k, list_sort(list_distinct(list(l_returnflag))) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def set_comp(spark, sf_dir):
    return orders(spark, sf_dir, "items", 1).select(c("o.key").alias("k"), standard.to_set(lists("items", "text")).alias("v"))


@query("SELECT o_orderkey AS k, list_sort(list_distinct([o_orderpriority, '5-LOW', o_orderstatus])) AS v, [o_orderstatus, o_orderpriority] AS l FROM orders")
def list_set_literals(spark, sf_dir):
    o = forests.table(spark, sf_dir, "orders")
    return o.select(c("o_orderkey").alias("k"), standard.to_set(F.array("o_orderpriority", F.lit("5-LOW"), "o_orderstatus")).alias("v"), F.array("o_orderstatus", "o_orderpriority").alias("l"))


# --- scans ----------------------------------------------------------------------------------------------------------------

ARMS = ["([a-z]+)://", "([0-9]+)", "[a-z]+"]
_SCAN = "(?:([a-z]+)://)|(?:([0-9]+))|(?:[a-z]+)"


@query(f"WITH t AS (SELECT page_id, unnest(regexp_extract_all(url, '{_SCAN}')) AS token, generate_subscripts(regexp_extract_all(url, '{_SCAN}'), 1) - 1 AS place FROM pages) SELECT page_id AS doc_id, place, token, CASE WHEN token LIKE '%://' THEN 0 WHEN token SIMILAR TO '[0-9]+' THEN 1 ELSE 2 END AS arm FROM t")
def scan_url(spark, sf_dir):
    pages = forests.table(spark, sf_dir, "pages").select(c("page_id").alias("doc_id"), loops.scan(c("url"), ARMS).alias("tokens"))
    return loops.for_each(pages, "tokens", "t").select("doc_id", c("at").cast("long").alias("place"), "t.token", "t.arm")


@query("SELECT page_id AS doc_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, len(regexp_extract_all(url, '[0-9]+')) AS numbers FROM pages")
def scan_groups(spark, sf_dir):
    tokens = loops.scan(c("url"), ARMS)
    first = F.filter(tokens, lambda t: t["arm"] == 0)[0]["groups"][1]
    pages = forests.table(spark, sf_dir, "pages")
    return pages.select(c("page_id").alias("doc_id"), first.alias("scheme"), F.size(F.filter(tokens, lambda t: t["arm"] == 1)).cast("long").alias("numbers"))


@query("SELECT doc_id, count(*) AS n, min(token) AS least, max(token) AS most FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:[0-9]+)|(?:[A-Za-z]+)')) AS token FROM documents) GROUP BY doc_id")
def scan_tokens(spark, sf_dir):
    """The tokens are exploded: each is found once, and counts and bounds are merged within tasks before they are dealt."""
    docs = forests.table(spark, sf_dir, "documents").select("doc_id", F.explode(loops.tokens(c("text"), ["[0-9]+", "[A-Za-z]+"])).alias("token"))
    return docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("token").alias("least"), F.max("token").alias("most"))


@query(f"WITH t AS (SELECT page_id, unnest(regexp_extract_all(url, '{_SCAN}')) AS token, generate_subscripts(regexp_extract_all(url, '{_SCAN}'), 1) - 1 AS place FROM pages) SELECT page_id AS doc_id, place, coalesce(lag(token) OVER (PARTITION BY page_id ORDER BY place), '^') AS source, token AS sink FROM t")
def scan_chain(spark, sf_dir):
    pages = forests.table(spark, sf_dir, "pages").select(c("page_id").alias("doc_id"), loops.scan(c("url"), ARMS).alias("tokens"))
    steps = loops.chained(loops.for_each(pages, "tokens", "t"), ["doc_id"], ["at"], c("t.token"), F.lit("^"), "source")
    return steps.select("doc_id", c("at").cast("long").alias("place"), "source", c("t.token").alias("sink"))


@query("WITH t AS (SELECT page_id, unnest(regexp_extract_all(url, '/[a-z0-9]+')) AS part, generate_subscripts(regexp_extract_all(url, '/[a-z0-9]+'), 1) - 1 AS i FROM pages) SELECT page_id AS doc_id, i, unnest(regexp_extract_all(part, '[a-z]+|[0-9]+')) AS token FROM t")
def scan_nested(spark, sf_dir):
    pages = forests.table(spark, sf_dir, "pages").select(c("page_id").alias("doc_id"), loops.scan(c("url"), ["/[a-z0-9]+"]).alias("parts"))
    outer = loops.for_each(pages, "parts", "part", "i").withColumn("tokens", loops.scan(c("part.token"), ["[a-z]+", "[0-9]+"]))
    return loops.for_each(outer, "tokens", "t").select("doc_id", c("i").cast("long").alias("i"), "t.token")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row FROM documents), h AS (SELECT *, strpos(line, '!!') - 1 AS col, (row + 1) || ' | ' AS head FROM l WHERE strpos(line, '!!') > 0) SELECT doc_id, row, head || line || chr(10) || repeat(' ', length(head) + col) || '^^' AS text FROM h")
def excerpts(spark, sf_dir):
    lines = p.picked(forests.text_forest(spark, sf_dir), "line", where=c("text").contains("!!"))
    at = F.instr("text", "!!") - 1
    return lines.select("doc_id", c("num").alias("row"), graphs.excerpt(c("text"), c("num"), at, F.lit(2)).alias("text"))


# --- scoped variables -----------------------------------------------------------------------------------------------------


@query("SELECT l_partkey AS part, o_orderkey AS owner FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def scoped(spark, sf_dir):
    forest = forests.order_forest(spark, sf_dir)
    o = p.match(forest, "o", "order")
    bindings = scoping.bind(o, "o", c("o.key"))
    lines = p.child(o.select("doc_id", "o"), forest, "o", "l", "lineitem")
    return scoping.read(lines, bindings, c("o.node_id"), "owner").select(c("l.key").alias("part"), "owner")


@query("SELECT l_partkey AS part, c_mktsegment AS segment FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey")
def scoped_chain(spark, sf_dir):
    forest = forests.order_forest(spark, sf_dir)
    owner = scoping.bind(p.child(p.match(forest, "c", "customer"), forest, "c", "o", "order"), "o", c("c.node_id"))
    segment = scoping.bind(p.match(forest, "c", "customer"), "c", c("c.text"))
    lines = p.child(p.match(forest, "o", "order"), forest, "o", "l", "lineitem")
    got = scoping.read(scoping.read(lines, owner, c("o.node_id"), "owner"), segment, c("owner"), "segment")
    return got.select(c("l.key").alias("part"), "segment")


@query("SELECT l_partkey AS part, CASE WHEN o_orderpriority = '1-URGENT' THEN 'order' ELSE c_mktsegment END AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey")
def inherit(spark, sf_dir):
    forest = forests.order_forest(spark, sf_dir)
    bindings = scoping.bind(p.match(forest, "c", "customer"), "c", c("c.text")).unionByName(scoping.bind(p.match(forest, "o", "order", where=c("text") == "1-URGENT"), "o", F.lit("order")))
    lines = p.match(forest, "l", "lineitem")
    return scoping.inherited(lines, bindings, "l", "v").select(c("l.key").alias("part"), "v")


@query("SELECT l_orderkey AS k, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(*) > 1")
def scoped_duplicates(spark, sf_dir):
    forest = forests.order_forest(spark, sf_dir)
    m = p.child(p.match(forest, "o", "order"), forest, "o", "l", "lineitem")
    twice = scoping.duplicated(scoping.bind(m, "o", c("l.key")))
    named = p.match(forest, "o", "order").select("doc_id", c("o.node_id").alias("scope"), c("o.key").alias("k"))
    return twice.join(named, ["doc_id", "scope"]).select("k", "n")


@query(f"SELECT o_orderkey AS k, arg_max(l_partkey, ({LINE_ORDER})) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def scoped_set(spark, sf_dir):
    forest = forests.order_forest(spark, sf_dir)
    m = p.child(p.match(forest, "o", "order"), forest, "o", "l", "lineitem")
    writes = m.select("doc_id", c("o.key").alias("scope"), c("l.key").alias("value"), c("l.path").alias("path"))
    return scoping.last_written(writes, "path").select(c("scope").alias("k"), c("value").alias("v"))


@query("SELECT r_name || '/' || n_name || '/' || s_name AS v, s_suppkey AS k FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def recursive_names(spark, sf_dir):
    forest = forests.geo_forest(spark, sf_dir)
    m = scoping.along_path(p.match(forest, "s", "supplier"), forest, "s", "v", c("text"), F.lit(None).cast("string"), lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, F.lit("/"), x)))
    return m.select("v", c("s.key").alias("k"))


@query(f"SELECT o_orderkey AS k, list(CAST(l_quantity AS BIGINT) * 3 ORDER BY {LINE_ORDER}) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def list_comp_scoped(spark, sf_dir):
    forest = forests.order_forest(spark, sf_dir)
    bindings = scoping.bind(p.match(forest, "l", "lineitem"), "l", c("l.num") * 3)
    rows = loops.for_each(orders(spark, sf_dir, "items", 1), "items", "x")
    rows = scoping.read(rows, bindings, c("x.node_id"), "tripled").withColumn("k", c("o.key"))
    return loops.gathered(rows, ["doc_id", "k"], "at", c("tripled"), "v").select("k", "v")


# --- functions ------------------------------------------------------------------------------------------------------------


@query("SELECT event_id AS k, (NULLIF(event_type, 'view') IS NOT DISTINCT FROM NULLIF(event_type, 'click')) AS a, (event_type IS NOT DISTINCT FROM 'view') AS b FROM events")
def fn_eq(spark, sf_dir):
    e = forests.table(spark, sf_dir, "events")
    t = c("event_type")
    return e.select(c("event_id").alias("k"), standard.eq(F.nullif(t, F.lit("view")), F.nullif(t, F.lit("click"))).alias("a"), standard.eq(t, F.lit("view")).alias("b"))


@query("SELECT event_id AS k, (user_id::INT = event_id) AS a, (user_id IS NULL AND event_type IS NULL) OR coalesce(event_type = 'view', false) AS b, [event_type] = ['view'] AS l, true AS nulls, false AS one_null FROM events")
def fn_eq_types(spark, sf_dir):
    none = F.lit(None).cast("string")
    e = forests.table(spark, sf_dir, "events")
    return e.select(c("event_id").alias("k"), standard.eq(c("user_id").cast("int"), c("event_id")).alias("a"), standard.eq(c("event_type"), F.lit("view")).alias("b"), standard.eq(F.array("event_type"), F.array(F.lit("view"))).alias("l"), standard.eq(none, F.lit(None).cast("long")).alias("nulls"), standard.eq(none, c("event_id")).alias("one_null"))


@query("SELECT event_id AS k, NULLIF(event_type, 'view') IS NULL AS v FROM events")
def fn_is_null(spark, sf_dir):
    return forests.table(spark, sf_dir, "events").select(c("event_id").alias("k"), standard.is_null(F.nullif("event_type", F.lit("view"))).alias("v"))


@query("SELECT event_id AS k, (2 * event_type_length) AS twice, 'view' = event_type AS same FROM (SELECT *, length(event_type) AS event_type_length FROM events)")
def fn_call(spark, sf_dir):
    """Functions called by name, one of them added to the standard ones."""
    functions = standard.standard()
    functions.add("twice", lambda x: x + x)
    e = forests.table(spark, sf_dir, "events")
    return e.select(c("event_id").alias("k"), functions.call("twice", F.length("event_type").cast("long")).alias("twice"), functions.call("eq", F.lit("view"), c("event_type")).alias("same"))


@query("SELECT event_id AS k, least(greatest(event_id, 5), 500) AS a, least(event_id, 4294967295) AS b, event_id + 2 * user_id AS c, 0::BIGINT AS d FROM events")
def fn_parameters(spark, sf_dir):
    """Functions with a parameter that may be left out, and with any number of them; a call that does not fit is refused when the plan is made."""
    functions = standard.standard()
    functions.add("clamp", lambda x, low=0, high=values.TOP: F.greatest(F.lit(low), F.least(F.lit(high), x)))
    for name, args in (("clamp", ()), ("clamp", (F.lit(1), 2, 3, 4)), ("is-null", ()), ("replace", (F.lit("a"), "a"))):
        try:
            functions.call(name, *args)
        except TypeError:
            continue
        raise AssertionError(f"{name} took {len(args)} parameters")
    call, e = functions.call, forests.table(spark, sf_dir, "events")
    k, user = c("event_id"), c("user_id")
    return e.select(k.alias("k"), call("clamp", k, 5, 500).alias("a"), call("clamp", k).alias("b"), call("plus", k, user, user).alias("c"), call("plus").alias("d"))


@query("SELECT event_id AS k, NOT (event_type = 'view') AS n, (event_type = 'view' AND user_id > 100) AS a, (event_type = 'view' OR user_id > 100) AS o, true AS none_and, false AS none_or FROM events")
def fn_boolean(spark, sf_dir):
    view, late = c("event_type") == "view", c("user_id") > 100
    return forests.table(spark, sf_dir, "events").select(c("event_id").alias("k"), standard.not_(view).alias("n"), standard.and_(view, late).alias("a"), standard.or_(view, late).alias("o"), standard.and_().alias("none_and"), standard.or_().alias("none_or"))


@query("SELECT event_id AS k, event_id + user_id + 7 AS v, 0::BIGINT AS z FROM events")
def fn_plus(spark, sf_dir):
    return forests.table(spark, sf_dir, "events").select(c("event_id").alias("k"), standard.plus(c("event_id"), c("user_id"), F.lit(7)).alias("v"), standard.plus().alias("z"))


@query("SELECT event_id AS k, '{' || event_type || '} by ' || user_id || ' is #' || (event_type = 'view') || ', ' || coalesce(NULLIF(event_type, 'view'), '#null') AS v FROM events")
def fn_format(spark, sf_dir):
    view = c("event_type") == "view"
    v = standard.format_("{{{}}} by {} is {}, {}", (c("event_type"), "string"), (c("user_id"), "long"), (view, "boolean"), (F.nullif("event_type", F.lit("view")), "string"))
    return forests.table(spark, sf_dir, "events").select(c("event_id").alias("k"), v.alias("v"))


@query(r"SELECT page_id AS k, regexp_replace(url, '^(https?)://([^/]+)', '\2 over \1 for $5', 'g') AS v, regexp_replace(url, '[0-9]+$', 'N', 'g') AS w, regexp_replace(url, '^(https?)(://)', '<\19\2>', 'g') AS x FROM pages")
def fn_replace(spark, sf_dir):
    pages = forests.table(spark, sf_dir, "pages")
    return pages.select(c("page_id").alias("k"), standard.replace(c("url"), "^(https?)://([^/]+)", "${2} over ${1} for $$5").alias("v"), standard.replace(c("url"), "[0-9]+$", "N").alias("w"), standard.replace(c("url"), "^(?P<how_>https?)(://)", "<${how_}9$2$3$no>").alias("x"))


@query(f"WITH t AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY {LINE_ORDER}) AS parts, list(l_returnflag ORDER BY {LINE_ORDER}) AS flags FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) SELECT k, list_concat(parts, [0::BIGINT], parts) AS twice, array_to_string(list_transform(flags, lambda x: coalesce(NULLIF(x, 'A'), '#null')), '+') AS joined, len(parts) AS n, len(parts) = 0 AS none FROM t")
def fn_lists(spark, sf_dir):
    m = orders(spark, sf_dir, "items", 1)
    parts, flags = lists("items", "key"), F.transform("items", lambda x: F.nullif(x["text"], F.lit("A")))
    return m.select(c("o.key").alias("k"), standard.concat(parts, F.array(F.lit(0).cast("long")), parts).alias("twice"), standard.join(flags, "string", "+").alias("joined"), standard.length(parts).alias("n"), standard.is_empty(parts).alias("none"))


@query(f"WITH l AS (SELECT o_custkey AS doc_id, o_orderkey AS k, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) - 1 AS place FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT doc_id, 'lineitem' AS kind, part AS k, place AS named_child_index, 0::BIGINT AS named_child_count FROM l UNION ALL SELECT o_custkey, 'order', o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) FROM orders UNION ALL SELECT c_custkey, 'customer', c_custkey, NULL, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) FROM customer")
def fn_positions(spark, sf_dir):
    call = standard.standard().call
    m = p.match(p.positioned(forests.order_forest(spark, sf_dir)), "x")
    index = F.when(c("x.kind") != "customer", call("named-child-index", c("x")))
    return m.select("doc_id", call("node-type", c("x")).alias("kind"), c("x.key").alias("k"), index.cast("long").alias("named_child_index"), call("named-child-count", c("x")).alias("named_child_count"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row FROM documents) SELECT doc_id, row AS start_row, 0::BIGINT AS start_column, row AS end_row, strlen(line) AS end_column, line AS source_text, 'line' AS node_type FROM l")
def fn_text_positions(spark, sf_dir):
    return _placed(spark, sf_dir, "line")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row FROM documents), w AS (SELECT doc_id, row, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) - 1 AS place FROM l), s AS (SELECT *, coalesce(sum(strlen(word) + 1) OVER (PARTITION BY doc_id, row ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM w) SELECT doc_id, row AS start_row, pos AS start_column, row AS end_row, pos + strlen(word) AS end_column, word AS source_text, 'word' AS node_type FROM s")
def fn_word_positions(spark, sf_dir):
    return _placed(spark, sf_dir, "word")


def _placed(spark, sf_dir, kind: str) -> DataFrame:
    """Text and place of each such node, all by the functions' names."""
    call = standard.standard().call
    m = p.match(forests.text_forest(spark, sf_dir, places=True), "x", kind)
    return m.select("doc_id", *(call(name, c("x")).alias(name.replace("-", "_")) for name in standard.NODE_FIELDS if name != "named-child-count"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row FROM documents), w AS (SELECT doc_id, row, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) - 1 AS place FROM l) SELECT doc_id, row, count(*) AS words, sum(strlen(word))::BIGINT AS bytes FROM w GROUP BY 1, 2")
def words_of_lines(spark, sf_dir):
    words = p.picked(forests.text_forest(spark, sf_dir), "word")
    return words.groupBy("doc_id", F.get("path", F.lit(0)).alias("row")).agg(F.count("*").alias("words"), F.sum(F.octet_length("text")).alias("bytes"))


# --- graphs as wholes -----------------------------------------------------------------------------------------------------


@query("SELECT r_regionkey AS doc_id, CASE WHEN r_regionkey % 2 = 0 THEN '{\"type\":\"string\",\"string\":\"' || r_name || '.py\"}' ELSE '{\"type\":\"string\",\"string\":\"none\"}' END AS filename, '{\"type\":\"list\",\"values\":[{\"type\":\"int\",\"int\":1},{\"type\":\"null\"}]}' AS tags, '{\"type\":\"string\",\"string\":\"\"}' AS pkgname, r_name || ' in ' || CASE WHEN r_regionkey % 2 = 0 THEN r_name || '.py' ELSE 'none' END || ' [1, #null]' AS v FROM region")
def globals_(spark, sf_dir):
    """A global given for some documents, one given to all in an outer environment, one left to its default."""
    outer = scoping.Globals()
    outer.add("tags", values.sequence(F.array(values.integer(F.lit(1)), values.null())))
    regions = p.match(forests.geo_forest(spark, sf_dir), "r", "region")
    own = regions.where("doc_id % 2 = 0").select("doc_id", F.lit("filename").alias("name"), values.string(F.concat("r.text", F.lit(".py"))).alias("value"))
    declared = [scoping.Declared("filename", default="none"), scoping.Declared("tags", many=True), scoping.Declared("pkgname", default="")]
    m = scoping.with_globals(regions, declared, scoping.Globals(outer), own)
    v = standard.format_("{} in {} {}", (c("r.text"), "string"), (c("filename"), "value"), (c("tags"), "value"))
    return m.select("doc_id", "filename", "tags", "pkgname", v.alias("v"))


def _geo_graph(spark, sf_dir, seed: DataFrame | None = None) -> graphs.Graph:
    """A node for each region and nation, an edge between them, named."""
    forest = p.picked(forests.geo_forest(spark, sf_dir), ["region", "nation"])
    own = graphs.numbered(forest, "path", seed=seed).select("doc_id", "node", "kind", "text")
    roots = own.where("kind = 'region'").select("doc_id", c("node").alias("source"))
    pairs = own.where("kind = 'nation'").select("doc_id", c("node").alias("sink")).join(roots, "doc_id")
    given = graphs.attributes(own, {"name": values.string(c("text")), "top": values.boolean(c("kind") == "region")}, "node")
    to = graphs.attributes(pairs, {"to": values.graph_node(c("sink"))}, "source", "sink")
    return graphs.Graph(own.select("doc_id", "node"), graphs.edges(pairs), given.unionByName(to))


def _seeded(spark, sf_dir) -> graphs.Graph:
    """Two nodes, an edge between them and a name of it were there before: ids go on from there."""
    roots = p.picked(forests.geo_forest(spark, sf_dir), "region")
    old = roots.select("doc_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("node"))
    pairs = roots.select("doc_id", F.lit(0).cast("long").alias("source"), F.lit(1).cast("long").alias("sink"))
    seed = graphs.Graph(old, graphs.edges(pairs), graphs.attributes(pairs, {"old": values.boolean(F.lit(True))}, "source", "sink"))
    return graphs.extended(_geo_graph(spark, sf_dir, old), seed)


@query("SELECT n_regionkey AS doc_id, 2 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS node FROM nation UNION ALL SELECT r_regionkey, unnest([0, 1, 2]) FROM region")
def seed_graph(spark, sf_dir):
    return _seeded(spark, sf_dir).nodes


@query("SELECT n_regionkey AS doc_id, 2::BIGINT AS source, 2 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS sink, 'to' AS name, '{\"type\":\"graphNode\",\"id\":' || 2 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) || '}' AS value FROM nation UNION ALL SELECT r_regionkey, 0, 1, 'old', '{\"type\":\"bool\",\"bool\":true}' FROM region")
def seed_edges(spark, sf_dir):
    g = _seeded(spark, sf_dir)
    return g.edges.join(g.attrs.where("owner = 'edge'"), ["doc_id", "source", "sink"]).select("doc_id", "source", "sink", "name", "value")


_STATEMENTS = [("conversation", 0, 4, "@v.node"), ("user", 3, 4, "@u.node"), ("assistant", 6, 4, "@a.node"), ("system", 9, 8, "@s.node")]
_PLACES_SQL = "(VALUES ('conversation', 1, 5, '@v.node'), ('user', 4, 5, '@u.node'), ('assistant', 7, 5, '@a.node'), ('system', 10, 9, '@s.node')) s(kind, line, col, variable)"


@query(f"""
WITH n AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS node, role AS kind, turn AS id FROM conversations
  UNION ALL SELECT DISTINCT conv_id, 0, 'conversation', -1 FROM conversations), d AS (SELECT * FROM n JOIN {_PLACES_SQL} USING (kind))
SELECT doc_id, 'node' AS owner, node AS source, NULL::BIGINT AS sink, u.name, u.value FROM d, LATERAL (
  SELECT 'location' AS name, '{{"type":"string","string":"line ' || line || ' column ' || col || '"}}' AS value
  UNION ALL SELECT 'variable', '{{"type":"string","string":"' || variable || '"}}' UNION ALL SELECT 'match', '{{"type":"syntaxNode","id":' || id || '}}') u
UNION ALL SELECT doc_id, 'edge', 0, node, 'location', '{{"type":"string","string":"line ' || line + 1 || ' column ' || col || '"}}' FROM d WHERE kind <> 'conversation'
""")
def debug_attrs(spark, sf_dir):
    """Each node says the statement that made it, its variable and its match; each edge says its statement, a line further down."""
    made = graphs.numbered(p.picked(forests.chat_forest(spark, sf_dir)), "path")
    made = made.select("doc_id", "node", "kind", F.struct("node_id").alias("full"))
    made = made.join(spark.createDataFrame(_STATEMENTS, "kind string, line int, column int, variable string"), "kind")
    edges = made.where("kind <> 'conversation'").select("doc_id", F.lit(0).cast("long").alias("source"), c("node").alias("sink"), (c("line") + 1).alias("line"), "column")
    return graphs.debugged(made, "line", "column", "variable", full="full").unionByName(graphs.debugged(edges, "line", "column", "", "source", "sink"))


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) SELECT r_regionkey AS doc_id, 'node 0' || chr(10) || '  name: \"' || r_name || '\"' || chr(10) || '  top: #true' || coalesce((SELECT string_agg(chr(10) || 'edge 0 -> ' || i || chr(10) || '  to: [graph node ' || i || ']', '' ORDER BY i) FROM n WHERE n_regionkey = r_regionkey), '') || coalesce((SELECT string_agg(chr(10) || 'node ' || i || chr(10) || '  name: \"' || n_name || '\"' || chr(10) || '  top: #false', '' ORDER BY i) FROM n WHERE n_regionkey = r_regionkey), '') AS text FROM region")
def pretty_print(spark, sf_dir):
    return graphs.pretty(_geo_graph(spark, sf_dir))


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) SELECT r_regionkey AS doc_id, 0::BIGINT AS node, '{\"id\":0,\"edges\":[' || coalesce((SELECT string_agg('{\"sink\":' || i || ',\"attrs\":{\"to\":{\"type\":\"graphNode\",\"id\":' || i || '}}}', ',' ORDER BY i) FROM n WHERE n_regionkey = r_regionkey), '') || '],\"attrs\":{\"name\":{\"type\":\"string\",\"string\":\"' || r_name || '\"},\"top\":{\"type\":\"bool\",\"bool\":true}}}' AS json FROM region UNION ALL SELECT n_regionkey, i, '{\"id\":' || i || ',\"edges\":[],\"attrs\":{\"name\":{\"type\":\"string\",\"string\":\"' || n_name || '\"},\"top\":{\"type\":\"bool\",\"bool\":false}}}' FROM n")
def json_graph(spark, sf_dir):
    return graphs.json_nodes(_geo_graph(spark, sf_dir))


@query("SELECT o_orderkey AS k, '{\"type\":\"list\",\"values\":[{\"type\":\"string\",\"string\":\"' || o_orderpriority || '\"},{\"type\":\"int\",\"int\":' || o_orderkey || '},{\"type\":\"null\"},{\"type\":\"bool\",\"bool\":' || (o_orderkey % 2 = 0) || '}]}' AS v FROM orders")
def tagged_values(spark, sf_dir):
    o = forests.table(spark, sf_dir, "orders")
    v = values.sequence(F.array(values.string(c("o_orderpriority")), values.integer(c("o_orderkey")), values.null(), values.boolean(c("o_orderkey") % 2 == 0)))
    return o.select(c("o_orderkey").alias("k"), v.alias("v"))


@query("SELECT o_orderkey AS k, o_orderpriority AS s, o_orderkey AS i, true AS no, o_orderkey % 2 = 0 AS b, 4 AS n FROM orders")
def decoded_values(spark, sf_dir):
    o = forests.table(spark, sf_dir, "orders")
    v = values.sequence(F.array(values.string(c("o_orderpriority")), values.integer(c("o_orderkey")), values.null(), values.boolean(c("o_orderkey") % 2 == 0)))
    held = lambda x: F.struct(values.as_string(x[0]).alias("s"), values.as_integer(x[1]).alias("i"), values.is_null(x[2]).alias("no"), values.as_boolean(x[3]).alias("b"), F.size(x).alias("n"))
    return o.select(c("o_orderkey").alias("k"), values.let(values.as_list(v), held).alias("x")).select("k", "x.*")


@query("SELECT n_regionkey AS doc_id, 'node 0' || chr(10) || '  initials: {' || string_agg(DISTINCT '\"' || n_name[1] || '\"', ', ' ORDER BY '\"' || n_name[1] || '\"') || '}' || chr(10) || '  members: [' || string_agg('[\"' || n_name || '\", ' || n_nationkey || ', {}]', ', ' ORDER BY n_nationkey) || ']' AS text FROM nation GROUP BY 1")
def pretty_lists(spark, sf_dir):
    """Lists and sets in lists: a region's nations with their numbers and an empty set each, and their initials as a set."""
    forest = forests.geo_forest(spark, sf_dir)
    m = p.repeated(p.match(forest, "r", "region"), forest, "r", "ns", "nation", least=1).withColumn("node", F.lit(0).cast("long"))
    members = values.sequence(F.transform("ns", lambda n: values.sequence(F.array(values.string(n["text"]), values.integer(n["key"]), values.sequence(F.array().cast("array<string>"), "set")))))
    initials = values.sequence(F.transform("ns", lambda n: values.string(F.left(n["text"], F.lit(1)))), "set")
    attrs = graphs.attributes(m, {"members": members, "initials": initials}, "node")
    nodes = m.select("doc_id", "node")
    return graphs.pretty(graphs.Graph(nodes, nodes.where("false").select("doc_id", c("node").alias("source"), c("node").alias("sink")), attrs))


# --- orders and places of any size -----------------------------------------------------------------------------------------


def _tag(kind: str, value: str) -> str:
    """SQL of an encoded value."""
    return f"""'{{"type":"{kind}","{kind}":' || {value} || '}}'"""


_LIST = """'{"type":"list","values":[' || """


@query(f"""
WITH v AS (SELECT o_orderkey AS k, unnest([
  {{'rank': 0, 'flag': false, 'n': 0, 'm': -1, 't': '', 'v': '{{"type":"null"}}'}}, {{'rank': 1, 'flag': o_orderkey % 2 = 0, 'n': 0, 'm': -1, 't': '', 'v': {_tag("bool", "(o_orderkey % 2 = 0)")}}},
  {{'rank': 2, 'flag': false, 'n': o_orderkey, 'm': -1, 't': '', 'v': {_tag("int", "o_orderkey")}}}, {{'rank': 2, 'flag': false, 'n': o_orderkey % 100, 'm': -1, 't': '', 'v': {_tag("int", "o_orderkey % 100")}}},
  {{'rank': 3, 'flag': false, 'n': 0, 'm': -1, 't': o_orderpriority, 'v': '{{"type":"string","string":"' || o_orderpriority || '"}}'}}, {{'rank': 3, 'flag': false, 'n': 0, 'm': -1, 't': '10', 'v': '{{"type":"string","string":"10"}}'}},
  {{'rank': 4, 'flag': false, 'n': o_orderkey % 20, 'm': o_orderkey % 3, 't': '', 'v': {_LIST}{_tag("int", "o_orderkey % 20")} || ',' || {_tag("int", "o_orderkey % 3")} || ']}}'}},
  {{'rank': 4, 'flag': false, 'n': o_orderkey % 7, 'm': -1, 't': '', 'v': {_LIST}{_tag("int", "o_orderkey % 7")} || ']}}'}}]) AS x FROM orders)
SELECT k, '{{"type":"set","values":[' || string_agg(x.v, ',' ORDER BY x.rank, x.flag, x.n, x.m, x.t) || ']}}' AS v FROM (SELECT DISTINCT * FROM v) GROUP BY k
""")
def set_order(spark, sf_dir):
    """Values of every kind as a set: integers by number, strings behind them, lists by their elements."""
    o = forests.table(spark, sf_dir, "orders")
    k = c("o_orderkey")
    number = lambda n: values.integer(k % n)
    items = [values.sequence(F.array(number(20), number(3))), values.string(F.lit("10")), values.integer(k), values.string(c("o_orderpriority")), values.sequence(F.array(number(7))), number(100), values.boolean(k % 2 == 0), values.null()]
    return o.select(k.alias("k"), values.sequence(F.array(*items), "set").alias("v"))


@query("SELECT page_id AS doc_id, kind, unnest(regexp_extract_all(html, CASE kind WHEN 'a' THEN '<a [^>]*>[^<]*</a>' WHEN 'title' THEN '<title>[^<]*</title>' ELSE '<li><a [^>]*>[^<]*</a></li>' END)) AS source_text FROM pages, (SELECT unnest(['a', 'title', 'li']) AS kind)")
def html_source_text(spark, sf_dir):
    """What elements cover in their page, tags and all."""
    m = p.match(forests.html_forest(spark, sf_dir), "x", ["a", "title", "li"])
    pages = forests.table(spark, sf_dir, "pages").select(c("page_id").alias("doc_id"), c("html").alias("text"))
    return forests.with_source(m, pages, "x", "source_text").select("doc_id", c("x.kind").alias("kind"), "source_text")


@query("""
WITH s AS (SELECT o_custkey AS doc_id, o_orderkey AS k, o_orderpriority AS p FROM orders JOIN customer ON c_custkey = o_custkey), f AS (SELECT doc_id, max(k) FILTER (p = '1-URGENT') AS latest FROM s GROUP BY 1)
SELECT 0 AS stanza, doc_id, k, coalesce(last_value(CASE WHEN p = '1-URGENT' THEN k END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS v FROM s
UNION ALL SELECT 1, doc_id, k, coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY k), latest, -1) FROM s JOIN f USING (doc_id) WHERE p = '5-LOW'
""")
def scoped_asof(spark, sf_dir):
    """Stanza 0 reads a customer's variable at every order, and urgent orders set it then; stanza 1 reads it at every low order, and sets it."""
    forest = forests.order_forest(spark, sf_dir)
    m = p.child(p.match(forest, "c", "customer"), forest, "c", "o", "order").withColumn("match", c("o.path"))
    start = m.groupBy("doc_id", "c").agg(F.min("match").alias("match")).select("doc_id", c("c.node_id").alias("scope"), F.lit(-1).cast("long").alias("value"), F.lit(-1).alias("stanza"), "match", F.lit(0).alias("statement"))
    reads = m.withColumns({"stanza": F.lit(0), "statement": F.lit(0)}).unionByName(m.where("o.text = '5-LOW'").withColumns({"stanza": F.lit(1), "statement": F.lit(0)}))
    sets = reads.where("stanza = 1 or o.text = '1-URGENT'").select("doc_id", c("c.node_id").alias("scope"), c("o.key").alias("value"), "stanza", "match", F.lit(1).alias("statement"))
    got = scoping.as_of(reads, start.unionByName(sets), c("c.node_id"), ["stanza", "match", "statement"], "v", wide=True)
    return got.select("stanza", "doc_id", c("o.key").alias("k"), "v")


@query("WITH t AS (SELECT *, row_number() OVER w AS i, lead(role) OVER w AS next_role, lead(turn) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), u AS (SELECT *, i - 2 * row_number() OVER (PARTITION BY conv_id, i % 2 ORDER BY i) AS g FROM t WHERE role = 'user' AND next_role = 'assistant') SELECT conv_id AS doc_id, min(turn) AS first, list(turn ORDER BY turn) AS asked, list(reply ORDER BY turn) AS answered FROM u GROUP BY conv_id, i % 2, g")
def group_runs(spark, sf_dir):
    """Questions, each with its answer just behind it, in runs."""
    m = p.sequences(forests.chat_forest(spark, sf_dir), [p.Item("u", "user"), p.Item("a", "assistant")])
    return m.select("doc_id", F.element_at("units", 1)["u"]["num"].alias("first"), F.transform("units", lambda x: x["u"]["num"]).alias("asked"), F.transform("units", lambda x: x["a"]["num"]).alias("answered"))


@query("""
WITH e AS (SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS v FROM events) SELECT 0 AS stanza, event_id AS doc_id, 'object' AS kind, NULL::VARCHAR AS key, NULL::VARCHAR AS value FROM e UNION ALL SELECT 1, event_id, 'pair', 'k', v::VARCHAR FROM e
UNION ALL SELECT 2, event_id, 'value', NULL, NULL FROM e WHERE v >= 50 UNION ALL SELECT 3, event_id, 'pair', NULL, v::VARCHAR FROM e WHERE v >= 50
""")
def merged_matches(spark, sf_dir):
    """Four patterns in one reading: objects, pairs with key and value, large values, and pairs with a large value."""
    large = c("text").cast("long") >= 50
    key, value = p.Pattern("key", named=False, under="key"), p.Pattern("value", under="value")
    found = p.merged(forests.json_forest(spark, sf_dir), {0: p.Pattern("object"), 1: p.Pattern("pair", children={"key": key, "value": value}), 2: p.Pattern("value", large), 3: p.Pattern("pair", children={"value": p.Pattern("value", large)})})
    return found.select("stanza", "doc_id", c("full.kind").alias("kind"), c("key.text").alias("key"), c("value.text").alias("value"))


@query(f"""
WITH n AS (SELECT c_custkey AS doc_id, 'customer' AS kind, c_custkey AS k, -1::BIGINT AS o, 0::BIGINT AS place, 0 AS depth FROM customer UNION ALL SELECT o_custkey, 'order', o_orderkey, o_orderkey, 0, 1 FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT o_custkey, 'lineitem', l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}), 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o, place) - 1 AS pre, CASE kind WHEN 'lineitem' THEN 1 WHEN 'order' THEN count(*) OVER (PARTITION BY doc_id, o) ELSE count(*) OVER (PARTITION BY doc_id) END AS size FROM n)
SELECT doc_id, kind, k, depth, 2 * pre - depth AS enter, 2 * pre - depth + 2 * size - 1 AS exit FROM w
""")
def parent_forest(spark, sf_dir):
    """Order and depth of the order forest from parent pointers, without its paths."""
    forest = forests.order_forest(spark, sf_dir)
    last = F.get("path", F.size("path") - 1)
    flat = forest.select("doc_id", "node_id", "parent_id", "kind", "key", F.when(c("kind") == "lineitem", F.slice("path", 2, 6)).otherwise(F.array(last)).alias("place"))
    placed = forests.from_parents(flat, "place").where("enter is not null")  # orders whose customer is not there have no places
    return placed.select("doc_id", "kind", c("key").alias("k"), c("depth").cast("int").alias("depth"), "enter", "exit")


@query("""
WITH c AS (SELECT n_regionkey AS r, n_nationkey AS a, c_custkey AS b FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey), n AS (
  SELECT r_regionkey AS doc_id, 'region' AS kind, r_regionkey AS k, -1 AS a, -1 AS b, -1 AS o, 0 AS depth FROM region UNION ALL SELECT n_regionkey, 'nation', n_nationkey, n_nationkey, -1, -1, 1 FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT r, 'customer', b, a, b, -1, 2 FROM c UNION ALL SELECT r, 'order', o_orderkey, a, b, o_orderkey, 3 FROM orders JOIN c ON b = o_custkey),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, b, o) - 1 AS pre, CASE kind WHEN 'region' THEN count(*) OVER (PARTITION BY doc_id) WHEN 'nation' THEN count(*) OVER (PARTITION BY doc_id, a) WHEN 'customer' THEN count(*) OVER (PARTITION BY doc_id, a, b) ELSE 1 END AS size FROM n)
SELECT doc_id, kind, CAST(k AS BIGINT) AS k, depth, 2 * pre - depth AS enter, 2 * pre - depth + 2 * size - 1 AS exit FROM w
""")
def wide_forest(spark, sf_dir):
    """Regions as documents, their nations, customers and orders as nodes: a nation's customers grow with the data, so siblings are put in order by ranges."""
    named = lambda name, *columns: forests.table(spark, sf_dir, name).select(*(c(x).cast("long").alias(y) for x, y in columns))
    region, nation = named("region", ("r_regionkey", "region")), named("nation", ("n_nationkey", "nation"), ("n_regionkey", "region"))
    nation = nation.join(region, "region")
    customer = named("customer", ("c_custkey", "customer"), ("c_nationkey", "nation")).join(nation, "nation")
    order = named("orders", ("o_orderkey", "order"), ("o_custkey", "customer")).join(customer, "customer")
    levels = {"region": region, "nation": nation, "customer": customer, "order": order}
    names = list(levels)

    def node(at: int) -> Column:  # ids of all levels in one document
        return c(names[at]) * len(names) + at

    rows = [levels[kind].select(c("region").alias("doc_id"), node(i).alias("node_id"), (node(i - 1) if i else F.lit(None).cast("long")).alias("parent_id"), F.lit(kind).alias("kind"), c(kind).alias("k")) for i, kind in enumerate(names)]
    placed = forests.from_parents(reduce(DataFrame.unionByName, rows), "k", wide=True)
    return placed.select("doc_id", "kind", "k", c("depth").cast("int").alias("depth"), "enter", "exit")


@query(f"""
WITH l AS (SELECT o_custkey AS doc_id, o_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) - 1 AS i FROM orders JOIN lineitem ON l_orderkey = o_orderkey), n AS (
  SELECT o_custkey AS doc_id, 'order' AS variable, o_orderkey AS k, 0 AS stanza, [0] AS place FROM orders UNION ALL SELECT doc_id, 'line', k, 0, [1, i, 0] FROM l
  UNION ALL SELECT doc_id, 'half', k, 0, [1, i, 1, j, 0] FROM l, unnest([0, 1]) t(j) UNION ALL SELECT o_custkey, 'rush', o_orderkey, 1, [0] FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT doc_id, variable, k, row_number() OVER (PARTITION BY doc_id ORDER BY stanza, k, place) - 1 AS node FROM n
""")
def numbered_nested(spark, sf_dir):
    """A node for each order, for each of its lines, and two for each of these, in nested loops; then, in another stanza, one for each urgent order."""
    m = orders(spark, sf_dir, "items").withColumnRenamed("o", "full")
    lines = loops.for_each(m, "items", "x", "i")
    halves = loops.for_each(lines, F.array(F.lit("first"), F.lit("second")), "h", "j")
    made = graphs.creations((m, 0, "order", [0]), (lines, 0, "line", [1, "i", 0]), (halves, 0, "half", [1, "i", 1, "j", 0]), (m.where("full.text = '1-URGENT'"), 1, "rush", [0]))
    return graphs.numbered(made, "made", wide=True).select("doc_id", "variable", c("full.key").alias("k"), "node")


@query("""
WITH t AS (SELECT page_id, split_part(url, '://', 1) AS scheme, length(split_part(url, '://', 1)) AS n, regexp_extract(url, '([a-z]+|[0-9]+)$', 1) AS last FROM pages)
SELECT page_id AS doc_id, 0::BIGINT AS place, 0 AS arm, scheme AS token FROM t UNION ALL SELECT page_id, 1, 2, last FROM t WHERE regexp_matches(last, '^[a-z]') UNION ALL SELECT page_id, 1, 1, last FROM t WHERE regexp_matches(last, '^[0-9]')
""")
def scan_anchored(spark, sf_dir):
    """The scheme at the start alone, and a number or a word at the very end."""
    pages = forests.table(spark, sf_dir, "pages").select(c("page_id").alias("doc_id"), loops.scan(c("url"), ["^[a-z]+", "[0-9]+$", "[a-z]+$"]).alias("tokens"))
    return loops.for_each(pages, "tokens", "t").select("doc_id", c("at").cast("long").alias("place"), "t.arm", "t.token")


@query("WITH t AS (SELECT *, coalesce(lag(role) OVER w = role, true) AS fresh FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t), e AS (SELECT *, max(turn) OVER (PARTITION BY conv_id, run) AS last FROM g) SELECT conv_id AS doc_id, turn, last AS v, count(*) OVER (PARTITION BY conv_id, run ORDER BY turn DESC) AS steps FROM e WHERE turn < last")
def scope_closure(spark, sf_dir):
    """A turn's variable `next` holds the turn behind it, if another role speaks there; where does `next.next...` lead?"""
    nodes = p.ends(forests.chat_forest(spark, sf_dir)).where("parent_id is not null")
    before = nodes.select("doc_id", c("node_id").alias("scope"), c("kind").alias("spoke"))
    link = nodes.select("doc_id", c("previous").alias("scope"), c("node_id").alias("value"), "kind").join(before, ["doc_id", "scope"]).where("kind <> spoke")
    return scoping.closure(link, "v").select("doc_id", c("scope").alias("turn"), "v", "steps")


@query(f"WITH l AS (SELECT l_orderkey AS k, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) - 1 AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey), f AS (SELECT k, flag, min(i) AS i FROM l GROUP BY 1, 2) SELECT 'scope' AS of, k, count(*) AS n, min(i) AS first, max(i) AS last FROM l GROUP BY k HAVING count(*) > 1 UNION ALL SELECT 'attribute', k, count(*), min(i), max(i) FROM f GROUP BY k HAVING count(*) > 1")
def duplicate_sites(spark, sf_dir):
    """Every line sets a variable of its order once more, and gives the order's node its flag: the sites that collide."""
    lines = loops.for_each(orders(spark, sf_dir, "items"), "items", "x").withColumn("node", c("o.key"))
    site = F.struct(F.lit(0).alias("stanza"), c("o.path").alias("match"), F.array(F.lit(1), "at").alias("place"))
    at = lambda x: F.element_at(c(x)["place"], 2).cast("long")
    twice = scoping.duplicated(scoping.bind(lines, "o", c("x.key"), site))
    named = p.match(forests.order_forest(spark, sf_dir), "o", "order").select("doc_id", c("o.node_id").alias("scope"), c("o.key").alias("k"))
    scopes = twice.join(named, ["doc_id", "scope"]).select(F.lit("scope").alias("of"), "k", "n", at("first_site").alias("first"), at("last_site").alias("last"))
    attrs = graphs.conflicts(graphs.attributes(lines, {"flag": values.string(c("x.text"))}, "node", site=site))
    return scopes.unionByName(attrs.select(F.lit("attribute").alias("of"), c("source").alias("k"), "n", at("first_site").alias("first"), at("last_site").alias("last")))


@query("SELECT l_partkey AS part, CASE WHEN o_orderpriority = '1-URGENT' THEN 'order' ELSE c_mktsegment END AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey")
def inherit_between(spark, sf_dir):
    """The nearest binding above, by places in a walk and not by paths."""
    forest = forests.order_forest(spark, sf_dir)
    placed = forests.from_parents(forest, "path").where("enter is not null").select("doc_id", "kind", "key", "text", "enter", "exit")
    placed = scratch.written(placed, "placed")
    bound = placed.where("kind = 'customer' or kind = 'order' and text = '1-URGENT'").select("doc_id", "enter", "exit", F.when(c("kind") == "customer", c("text")).otherwise("order").alias("value"))
    lines = placed.where("kind = 'lineitem'").select("doc_id", F.struct("key", "enter").alias("l"))
    return scoping.inherited_between(lines, bound, "l", "v").select(c("l.key").alias("part"), "v")


# --- streams ---------------------------------------------------------------------------------------------------------------


def _talk(turns: DataFrame) -> graphs.Graph:
    """A node for each turn and its conversation, an edge from each turn to the next, which says who speaks then."""
    forest = forests.turns_forest(turns)
    made = graphs.numbered(p.picked(forest), "path").select("doc_id", "node", "kind", "parent_id")
    later = made.where("parent_id is not null").select("doc_id", (c("node") - 1).alias("source"), c("node").alias("sink"), "kind")
    named = graphs.attributes(made, {"kind": values.string(c("kind"))}, "node").unionByName(graphs.attributes(later, {"then": values.string(c("kind"))}, "source", "sink"))
    return graphs.Graph(made.select("doc_id", "node"), graphs.edges(later), named)


@query("WITH n AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS node, role FROM conversations) SELECT doc_id, node - 1 AS source, node AS sink, '{\"type\":\"string\",\"string\":\"' || role || '\"}' AS value FROM n")
def stream_graph(spark, sf_dir):
    """Conversations that arrive in eight files, two a batch, and are made a graph batch by batch."""
    turns = forests.table(spark, sf_dir, "conversations")
    turns.repartition(8, "conv_id").write.parquet(arrived := scratch.folder(spark, "arrived"))
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 2).parquet(arrived)
    kept = store.GraphStore(spark, scratch.folder(spark, "graphs"))
    store.filled(stream, _talk, kept, scratch.folder(spark, "stream"))
    g = kept.graph()
    return g.edges.join(g.attrs.where("owner = 'edge'"), ["doc_id", "source", "sink"]).select("doc_id", "source", "sink", "value")


ORACLES["q_globals"] = ORACLES.pop("q_globals_")
QUERIES["q_globals"] = QUERIES.pop("q_globals_")
