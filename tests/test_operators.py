"""Operators on small hand-made trees."""

import json
import random

import pytest
from pyspark.sql import functions as F

from copse.functions import standard, values
from copse.operators import graphs, loops, scoping
from copse.operators import patterns as p
from copse.sources.forests import COLUMNS, _Tags, pages_forest, running, text_files, text_forest

SCHEMA = "doc_id long, node_id long, parent_id long, kind string, field string, named boolean, error boolean, missing boolean, path array<long>, key long, num long, text string"


def tree(spark, rows):
    """Rows (node_id, parent_id, kind, path, text[, flags]); flags: a anonymous, e error, m missing."""
    full = [(1, r[0], r[1], r[2], None, "a" not in (r[5:] or [""])[0], "e" in (r[5:] or [""])[0], "m" in (r[5:] or [""])[0], r[3], r[0], None, r[4]) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def forest(spark):
    return tree(
        spark,
        [
            (0, None, "module", [], None),
            (1, 0, "call", [0], "f(x)"),
            (2, 1, "name", [0, 0], "f"),
            (3, 1, "(", [0, 1], "(", "a"),
            (4, 1, "arg", [0, 2], "x"),
            (5, 1, ")", [0, 3], ")", "am"),
            (6, 0, "call", [1], "g"),
            (7, 6, "name", [1, 0], "g", "e"),
            (8, 7, "junk", [1, 0, 0], "!", "e"),
            (9, 0, "pass", [2], "pass"),
        ],
    )


def test_columns(forest):
    assert forest.columns == COLUMNS


def test_optional_and_repeated(forest):
    calls = p.match(forest, "c", "call")
    got = {r.c.node_id: (r.a.node_id if r.a else None) for r in p.child(calls, forest, "c", "a", "arg", optional=True).collect()}
    assert got == {1: 4, 6: None}
    many = {r.c.node_id: [x.kind for x in r.xs] for r in p.repeated(calls, forest, "c", "xs").collect()}
    assert many == {1: ["name", "arg"], 6: ["name"]}
    assert [r.c.node_id for r in p.repeated(calls, forest, "c", "xs", "arg", least=1).collect()] == [1]
    assert [r.c.node_id for r in p.without(calls, forest, "c", "arg").collect()] == [6]


def test_positions(forest):
    got = {r.node_id: (r.child_index, r.named_child_index, r.named_child_count) for r in p.positioned(forest).collect()}
    assert got[0] == (None, None, 3) and got[4] == (2, 1, 0) and got[5] == (3, None, 0) and got[1] == (0, 0, 2)


def test_parse_errors_do_not_descend(forest):
    assert sorted(r.node_id for r in p.parse_errors(forest).collect()) == [5, 7]
    assert p.first_error(p.parse_errors(forest)).first().node_id == 5


def test_root_error_hides_all(spark):
    f = tree(spark, [(0, None, "module", [], None, "e"), (1, 0, "x", [0], None, "e")])
    assert [r.node_id for r in p.parse_errors(f).collect()] == [0]


def test_runs_and_adjacency(spark):
    f = tree(spark, [(0, None, "m", [], None)] + [(i + 1, 0, k, [i], None) for i, k in enumerate("aabaaab")])
    got = sorted((r.first, len(r.nodes)) for r in p.runs(f, "a").collect())
    assert got == [([0], 2), ([3], 3)]
    e = {r.node_id: (r.is_first, r.is_last, r.previous) for r in p.ends(f).where("parent_id = 0").collect()}
    assert e[1] == (True, False, None) and e[7] == (False, True, 6)


def test_scopes(forest):
    m = p.match(forest, "x", "module")
    b = scoping.bind(m, "x", F.lit("top")).unionByName(scoping.bind(p.match(forest, "x", "call", where=F.col("text") == "g"), "x", F.lit(None).cast("string")))
    got = {r.n.node_id: r.v for r in scoping.inherited(p.match(forest, "n", named=None), b, "n", "v").collect()}
    assert got == {0: "top", 1: "top", 2: "top", 3: "top", 4: "top", 5: "top", 6: None, 7: None, 8: None, 9: "top"}
    calls = p.match(forest, "c", "call")
    read = scoping.read(calls, b.where("scope = 6"), F.col("c.node_id"), "v", needed=False)
    assert read.count() == 2
    with pytest.raises(Exception, match="UndefinedScopedVariable"):
        scoping.read(calls, b.where("scope = 6"), F.col("c.node_id"), "v").collect()
    assert scoping.duplicated(b.unionByName(b)).count() == 2


def test_graph_checks(spark):
    nodes = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, node long")
    pairs = spark.createDataFrame([(1, 0, 1), (1, 0, 1)], "doc_id long, source long, sink long")
    attrs = graphs.attributes(nodes, {"n": values.integer(F.col("node"))}, "node").unionByName(graphs.attributes(pairs, {"e": values.string(F.lit('say "hi"\n'))}, "source", "sink"))
    g = graphs.validated(graphs.Graph(nodes, graphs.edges(pairs), attrs))
    assert g.edges.count() == 1
    assert graphs.pretty(g).first().text == 'node 0\n  n: 0\nedge 0 -> 1\n  e: "say \\"hi\\"\\n"\nnode 1\n  n: 1'
    with pytest.raises(ValueError, match="DuplicateAttribute"):
        graphs.validated(graphs.Graph(nodes, g.edges, attrs.unionByName(graphs.attributes(nodes, {"n": values.null()}, "node"))))
    with pytest.raises(ValueError, match="UndefinedEdge"):
        graphs.validated(graphs.Graph(nodes, g.edges.where("false"), attrs))


def test_scan_arms(spark):
    df = spark.createDataFrame([("ab12 cd",), ("",), (None,)], "t string").select("t", loops.scan(F.col("t"), ["([a-z])b", "([0-9])([0-9])?", "[a-z]"]).alias("x"))
    got = {r.t: r.x and [(x.arm, x.token, x.groups) for x in r.x] for r in df.collect()}
    assert got["ab12 cd"] == [(0, "ab", ["ab", "a"]), (1, "12", ["12", "1", "2"]), (2, "c", ["c"]), (2, "d", ["d"])]
    assert got[""] == [] and got[None] is None


def test_scan_of_empty_matches_and_anchors(spark):
    one = lambda text, arms: [(x.arm, x.token) for x in spark.range(1).select(loops.scan(F.lit(text), arms).alias("v")).first().v]
    assert one("ab", ["[a-z]*"]) == [(0, "ab")] and one("", ["[a-z]*"]) == []
    assert one("ab12", ["[a-z0-9]*", "[0-9]"]) == [(0, "ab12")]
    for text, arms in (("a1", ["[a-z]*"]), ("1", ["[a-z]*", "[0-9]"]), ("é", ["(|é)"])):
        with pytest.raises(Exception, match="EmptyRegexCapture"):
            one(text, arms)
    assert one("aab a", ["^aa", "^[a-z]"]) == [(0, "aa"), (1, "b")]
    for bad in (["(?=a)"], ["(?m)a$"], [r"(a)\1"]):
        with pytest.raises(ValueError):
            loops.scan(F.lit("a"), bad)


def test_functions(spark):
    one = spark.range(1)
    get = lambda x: one.select(x.alias("v")).first().v
    assert get(standard.format_("{{{}}}-{}", (F.lit(True), "boolean"), (F.lit(None).cast("string"), "string"))) == "{#true}-#null"
    for bad in ("{", "}", "{}"):
        with pytest.raises(ValueError):
            standard.format_(bad)
    with pytest.raises(ValueError):
        standard.format_("x", (F.lit(1), "int"))
    assert get(standard.replace(F.lit("a1b22"), "([0-9])+", "<$1>")) == "a<1>b<2>"
    assert get(standard.replace(F.lit("é_x a\n"), r"\w+$", "Z")) == "é_x a\n"
    with pytest.raises(ValueError):
        standard.java_pattern("(?=x)")
    assert get(standard.plus()) == 0 and get(standard.and_()) is True and get(standard.or_()) is False
    with pytest.raises(Exception, match="out of range"):
        get(standard.plus(F.lit(2**32 - 1), F.lit(1)))
    assert get(standard.eq(F.lit(None).cast("int"), F.lit(None).cast("int"))) is True
    registry = standard.standard()
    assert get(registry.call("join", F.array(F.lit("a"), F.lit(None)), "string", ",")) == "a,#null"
    registry.add("twice", lambda x: x + x)
    assert get(registry.call("twice", F.lit(4))) == 8
    with pytest.raises(KeyError):
        registry.call("nope")
    for bad in ((), (F.lit(1), F.lit(2))):
        with pytest.raises(TypeError, match="InvalidParameters"):
            registry.call("is-null", *bad)


def test_equality_is_strict(spark):
    get = lambda x: spark.range(1).select(x.alias("v")).first().v
    lit = F.lit
    assert get(standard.eq(lit(1), lit(1).cast("long"))) is True and get(standard.eq(lit("a"), lit(None).cast("long"))) is False
    assert get(standard.eq(F.array(lit(1)), F.array(lit(1).cast("long")))) is True
    for a, b in ((lit("1"), lit(1)), (lit("x"), lit(1)), (lit(True), lit("true")), (lit(1), F.array(lit(1)))):
        with pytest.raises(Exception, match="different types|DATATYPE_MISMATCH"):
            get(standard.eq(a, b))


def test_values_read_and_decode(spark):
    get = lambda x: spark.range(1).select(x.alias("v")).first().v
    text = values.string(F.lit('a,]}{"type":"null"} "q"'))
    inner = values.sequence(F.array(values.integer(F.lit(7)), values.null()), "set")
    v = values.sequence(F.array(text, inner, values.sequence(F.array().cast("array<string>")), values.boolean(F.lit(False)), values.graph_node(F.lit(3)), values.syntax_node(F.lit(4))))
    assert get(values.read(v, False)) == '[a,]}{"type":"null"} "q", {#null, 7}, [], #false, [graph node 3], [syntax node 4]]'
    assert get(values.debug(v)).startswith('["a,]}{\\"type\\":\\"null\\"} \\"q\\"", {#null')
    assert get(F.size(values.as_list(v))) == 6 and get(values.as_string(values.as_list(v)[0])) == 'a,]}{"type":"null"} "q"'
    assert get(values.as_integer(values.as_set(inner)[1])) == 7 and get(values.is_null(values.as_set(inner)[0])) is True
    assert get(values.as_graph_node(values.as_list(v)[4])) == 3 and get(values.as_syntax_node(values.as_list(v)[5])) == 4
    for bad, name in ((values.as_string(inner), "ExpectedString: got {#null, 7}"), (values.as_list(inner), "ExpectedList"), (values.as_boolean(text), "ExpectedBoolean"), (values.as_integer(values.null()), "ExpectedInteger: got #null")):
        with pytest.raises(Exception, match=name):
            get(bad)
    nested = F.array(F.array(F.lit("a"), F.lit(None)), F.array().cast("array<string>"))
    assert get(standard.format_("{} {}", (nested, "array<set<string>>"), (v, "value"))).startswith("[{a, #null}, {}] [a,")
    assert get(standard.join(nested, "list<string>", "+")) == "[a, #null]+[]"


def test_globals(spark, forest):
    outer, m = scoping.Globals(), p.match(forest, "x", "module")
    outer.add("a", values.string(F.lit("out")))
    inner = scoping.Globals(outer)
    inner.add("b", values.integer(F.lit(1)))
    with pytest.raises(ValueError, match="VariableAlreadyDefined"):
        inner.add("b", values.null())
    assert inner.get("a") is not None and [n for n, _ in inner] == ["b"] and not inner.is_empty()
    inner.add("a", values.string(F.lit("in")))
    ask = lambda declared, **given: scoping.with_globals(m, declared, **given).first()
    assert ask([scoping.Declared("a")], common=inner).a == '{"type":"string","string":"in"}'
    inner.remove("a")
    assert ask([scoping.Declared("a")], common=inner).a == '{"type":"string","string":"out"}'
    inner.clear()
    assert inner.is_empty() and inner.get("b") is None
    with pytest.raises(Exception, match="MissingGlobalVariable: q"):
        ask([scoping.Declared("q")], common=outer)
    with pytest.raises(Exception, match="ExpectedList: a"):
        ask([scoping.Declared("a", many=True)], common=outer)
    assert ask([scoping.Declared("q", many=True, default="")]).q == '{"type":"string","string":""}'
    own = spark.createDataFrame([(1, "a", '{"type":"int","int":5}'), (1, "z", "1"), (1, "z", "2")], "doc_id long, name string, value string")
    assert ask([scoping.Declared("a")], common=outer, own=own).a == '{"type":"int","int":5}'
    with pytest.raises(Exception, match="VariableAlreadyDefined"):
        ask([scoping.Declared("z")], own=own)


def test_syntax_nodes_read_by_kind_and_place(spark):
    forest = pages_forest(spark.createDataFrame([(1, "<p>\n <b>x</b></p>")], "page_id long, html string"))
    nodes = spark.createDataFrame([(1, 0)], "doc_id long, node long")
    attrs = graphs.attributes(nodes, {"of": values.syntax_node(F.lit(3)), "n": values.null()}, "node")
    edges = spark.createDataFrame([], "doc_id long, source long, sink long")
    got = graphs.pretty(graphs.Graph(nodes, edges, attrs), forest).first().text
    assert got in ("node 0\n  n: #null\n  of: [syntax node text (2, 5)]", "node 0\n  n: #null\n  of: [syntax node b (2, 2)]")


def test_places_of_words_in_long_lines(spark, tmp_path):
    line = " ".join(["é", "", "abc"] * 400)
    spark.createDataFrame([(1, f"{line}\nx y"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = text_forest(spark, str(tmp_path), places=True).where("kind = 'word'").collect()
    for r in rows:
        whole = (line if r.path[0] == 0 else "x y").encode() if r.doc_id == 1 else b""
        assert whole[r.start_column : r.end_column].decode() == r.text and r.start_row == r.end_row == r.path[0]
    assert len(rows) == 1200 + 2 + 1
    assert spark.range(1).select(running(F.array().cast("array<long>")).alias("v")).first().v == []


def test_hierarchy_of_kinds(spark, forest):
    steps = spark.createDataFrame([("expr", "call"), ("expr", "atom"), ("atom", "name"), ("atom", "arg")], "supertype string, kind string")
    kinds = p.closed(steps)
    assert sorted(r.node_id for r in p.of_supertype(forest, kinds, "expr").collect()) == [1, 2, 4, 6, 7]
    assert [r.node_id for r in p.of_supertype(forest, kinds, "atom", "arg").collect()] == [4]


def test_html_marks_broken_tags():
    t = _Tags("<div><p>a<b>c</div></i>")
    t.feed("<div><p>a<b>c</div></i>")
    t.close()
    kinds = [(r[2], r[4], r[5]) for r in t.rows]
    assert kinds == [("page", False, False), ("div", False, False), ("p", False, True), ("text", False, False), ("b", False, True), ("text", False, False), ("i", True, False)]
    assert t.rows[5][7] == [1, 2, 4, 5]
    assert [tuple(r[8:]) for r in t.rows] == [(0, 0, 0, 23), (0, 0, 0, 19), (0, 5, 0, 13), (0, 8, 0, 9), (0, 9, 0, 13), (0, 12, 0, 13), (0, 19, 0, 23)]


def test_html_places_are_bytes(spark):
    html = "<a href='x'>é</a>\n<!-- c --><p>ü b</p>\n<br>"
    rows = pages_forest(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string"))
    assert {r.doc_id for r in rows.where("kind = 'page'").collect()} == {1, 2, 3}
    got = {(r.kind, r.text): (r.start_row, r.start_column, r.end_row, r.end_column) for r in rows.where("doc_id = 1").collect()}
    assert got["page", None] == (0, 0, 2, 4) and got["a", None] == (0, 0, 0, 18) and got["text", "é"] == (0, 12, 0, 14)
    assert got["p", None] == (1, 10, 1, 21) and got["text", "ü b"] == (1, 13, 1, 17) and got["br", None] == (2, 0, 2, 4)


def test_html_errors_against_a_plain_walk(spark):
    rng = random.Random(5)
    pages = [(i, "".join(rng.choice(["<b>", "</b>", "<i>", "</i>", "<p>", "</p>", "t", "<br>"]) for _ in range(rng.randrange(40)))) for i in range(60)]
    forest = pages_forest(spark.createDataFrame(pages, "page_id long, html string"))
    rows = {(r.doc_id, r.node_id): r for r in forest.collect()}
    bad = {k for k, r in rows.items() if r.error or r.missing}

    def above(k):
        while rows[k].parent_id is not None:
            k = (k[0], rows[k].parent_id)
            yield k

    want = sorted(k for k in bad if not any(a in bad for a in above(k)))
    assert want and sorted((r.doc_id, r.node_id) for r in p.parse_errors(forest).collect()) == want


def test_row_order_and_partitions_do_not_matter(spark, forest):
    a = graphs.numbered(p.picked(forest), "path").select("node_id", "node")
    b = graphs.numbered(p.picked(forest.repartition(3).orderBy(F.rand(1))), "path").select("node_id", "node")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "in" / "b.txt").write_text("")
    got = text_files(spark, str(tmp_path / "in")).collect()
    assert [r.text for r in got if r.path.endswith("a.txt")] == ["one\ntwo\n"]
    nodes = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, node long")
    edges = spark.createDataFrame([(1, 0, 1)], "doc_id long, source long, sink long")
    attrs = graphs.attributes(nodes, {'q"': values.boolean(F.lit(True))}, "node")
    graphs.write_json(graphs.Graph(nodes, edges, attrs), str(tmp_path / "out"))
    lines = sorted(json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == [0, 1]
