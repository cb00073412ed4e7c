"""Orders, links and scans against plain Python."""

import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from copse.functions import values
from copse.operators import graphs, loops, scoping, spread
from copse.operators import patterns as p
from copse.sources import scratch
from copse.sources.forests import from_parents, pages_forest, text_forest, with_source
from tests.test_operators import tree

INT = "doc_id long, k long, v long"


@pytest.mark.parametrize("hot", [0, 3000])
def test_numbers_and_last_values_of_keys_that_no_task_holds(spark, hot):
    rng = random.Random(hot)
    rows = [(rng.randrange(40), i, rng.choice([None, i])) for i in range(900)] + [(77, 10_000 + i, i if i % 7 == 0 else None) for i in range(hot)] + [(None, 1, 5), (None, 2, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, INT).repartition(5)
    want, last = {}, {}
    for doc, k, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        own = want.setdefault(doc, [])
        last[doc] = v if v is not None else last.get(doc)
        own.append((k, len(own), last[doc]))
    flat = sorted((repr((d, *x)) for d, xs in want.items() for x in xs))
    ranged = spread.ranged(df, ["doc_id"], ["k"])
    assert not hot or ranged.where("doc_id = 77").select("_range").distinct().count() > 2
    got = spread.carried(spread.numbered(df, ["doc_id"], ["k"], "n"), ["doc_id"], ["k"], "v", "last")
    assert sorted(repr((r.doc_id, r.k, r.n, r.last)) for r in got.collect()) == flat
    made = graphs.numbered(df.where("doc_id is not null"), "k", wide=True)
    assert made.select("doc_id", "k", "node").exceptAll(graphs.numbered(df.where("doc_id is not null"), "k").select("doc_id", "k", "node")).isEmpty()


def test_ends_of_chains_and_cycles(spark):
    rng = random.Random(4)
    rows = [(1, i, i + 1) for i in range(300)] + [(2, 0, 1), (2, 1, 2), (2, 2, 0), (2, 9, 1), (2, 5, 6), (3, 7, None), (4, 0, 0)]
    rows += [(5, i, rng.randrange(i)) for i in range(1, 200)]
    up = {(d, i): t for d, i, t in rows if t is not None}

    def walk(d, i):
        steps, seen = 0, set()
        while (d, i) in up:
            if i in seen:
                return None, None
            seen.add(i)
            i, steps = up[d, i], steps + 1
        return i, steps

    got = {(r.doc_id, r.id): (r.end, r.steps, r.weight) for r in spread.ends(spark.createDataFrame(rows, "doc_id long, id long, to long"), weight=F.lit(2)).collect()}
    assert got == {k: (*walk(*k), walk(*k)[1] and 2 * walk(*k)[1]) for k in up}
    assert spread.ends(spark.createDataFrame([], "doc_id long, id long, to long")).collect() == []
    found = {(r.doc_id, r.scope): r.end for r in scoping.closure(spark.createDataFrame([(1, 3, 4), (1, 4, 9), (1, 5, 5)], "doc_id long, scope long, value long")).collect()}
    assert found == {(1, 3): 9, (1, 4): 9, (1, 5): None}


def walked(nodes):
    """(enter, exit, depth) by recursion turned into a stack."""
    below = {}
    for n, up, at in nodes:
        below.setdefault(up, []).append((at, n))
    out, time, stack = {}, 0, [(n, 0, False) for _, n in sorted(below.get(None, []), reverse=True)]
    while stack:
        n, depth, left = stack.pop()
        if left:
            out[n] = (out[n][0], time, depth)
        else:
            out[n] = (time, None, depth)
            stack.append((n, depth, True))
            stack += [(m, depth + 1, False) for _, m in sorted(below.get(n, []), reverse=True)]
        time += 1
    return out


@pytest.mark.parametrize("wide", [False, True])
def test_order_from_parent_pointers(spark, wide):
    rng = random.Random(6)
    docs = {1: [(100 + i, None if i == 0 else 100 + rng.randrange(i), rng.random()) for i in range(120)], 2: [(5, None, 0.0)], 3: [(1, None, 0.5), (2, None, 0.1), (3, 2, 0.0), (4, 2, -1.0)], 4: [(i, i - 1 if i else None, 0.0) for i in range(2000)]}
    rows = [(d, *r) for d, rs in docs.items() for r in rs] + [(3, 50, 49, 0.0), (3, 51, 50, 0.0), (3, 60, 61, 0.0), (3, 61, 60, 0.0)]
    got = {(r.doc_id, r.node_id): (r.enter, r["exit"], r.depth) for r in from_parents(spark.createDataFrame(rows, "doc_id long, node_id long, parent_id long, at double"), "at", wide=wide).collect()}
    want = {(d, n): x for d, rs in docs.items() for n, x in walked(rs).items()}
    assert {k: v for k, v in got.items() if k[1] not in (50, 51, 60, 61) or k[0] != 3} == want
    assert {got[3, n] for n in (50, 51, 60, 61)} == {(None, None, None)}


def test_siblings_of_a_parent_that_no_task_holds(spark):
    rng = random.Random(8)
    rows = [(0, None, 0)] + [(i, 0, rng.randrange(300)) for i in range(1, 700)]  # many ties
    rows += [(1000 + i, rng.randrange(1, 700), rng.randrange(3)) for i in range(500)]
    nodes = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, node_id long, parent_id long, at int").repartition(5)
    got = {r.node_id: (r.enter, r["exit"], r.depth) for r in from_parents(nodes, "at", wide=True).collect()}
    assert got == walked(rows)


def test_places_among_siblings_by_ranges(spark):
    rng = random.Random(7)
    rows = [(0, None, "m", [], None)] + [(i, 0, rng.choice("abc"), [i], None) for i in range(1, 400)] + [(1000 + i, 1 + i % 9, "d", [1 + i % 9, i], None) for i in range(60)]
    forest = tree(spark, rows).withColumn("named", F.col("node_id") % 4 != 1).repartition(4)
    for find in (p.positioned, p.ends):
        narrow, wide = (find(forest, wide=x) for x in (False, True))
        assert dict(narrow.dtypes) == dict(wide.dtypes)
        order = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
        assert order(narrow) == order(wide)


def test_inheritance_by_places_and_by_paths(spark):
    rng = random.Random(9)
    rows, paths = [], {0: []}
    for i in range(1, 150):
        up = rng.randrange(i)
        paths[i] = [*paths[up], i]
        rows.append((i, up, rng.choice("abc"), paths[i], None))
    forest = from_parents(tree(spark, [(0, None, "a", [], None), *rows]), "path")
    m = p.match(forest, "x")
    bound = m.where("x.kind = 'b'").select("doc_id", "x.enter", "x.exit", F.when(F.col("x.node_id") % 5 > 0, F.col("x.node_id")).alias("value"))
    by_path = scoping.inherited(m, scoping.bind(m.where("x.kind = 'b'"), "x", F.when(F.col("x.node_id") % 5 > 0, F.col("x.node_id"))), "x", "v")
    got = {r.x.node_id: r.v for r in scoping.inherited_between(m, bound, "x", "v").collect()}
    assert got == {r.x.node_id: r.v for r in by_path.collect()} and len(set(got.values())) > 5


@pytest.mark.parametrize("wide", [False, True])
def test_reads_between_writes(spark, wide):
    rng = random.Random(2)
    log = [(rng.randrange(3), rng.randrange(5), rng.randrange(2), rng.randrange(40), n, rng.random() < 0.5) for n in range(400)]
    frame = lambda want: spark.createDataFrame([(1, s, z, m, t, n) for z, t, s, m, n, w in log if w == want], "doc_id long, s long, stanza int, match long, statement int, n long")
    writes = frame(True).dropDuplicates(["s", "stanza", "match", "statement"])
    kept = [tuple(r)[1:] for r in writes.collect()]
    value = F.when(F.col("n") % 4 > 0, F.col("n"))
    got = scoping.as_of(frame(False), writes.select("doc_id", F.col("s").alias("scope"), value.alias("value"), "stanza", "match", "statement"), F.col("s"), ["stanza", "match", "statement"], "v", needed=False, wide=wide).collect()
    for r in got:
        before = [(w[1:4], w[4]) for w in kept if w[0] == r.s and w[1:4] < (r.stanza, r.match, r.statement)]
        want = max(before)[1] if before else None
        assert r.v == (want if want is None or want % 4 else None)
    assert len(got) == sum(not x[5] for x in log)
    with pytest.raises(Exception, match="UndefinedScopedVariable"):
        scoping.as_of(frame(False), writes.where("false").select("doc_id", F.col("s").alias("scope"), F.col("n").alias("value"), "stanza", "match", "statement"), F.col("s"), ["stanza", "match", "statement"], "v", wide=wide).collect()


@pytest.mark.parametrize("items", [[("u", "a", "1"), ("v", "b", "1")], [("u", "a", "1"), ("v", "b", "*")], [("u", "a", "?"), ("v", "b", "+")], [("u", "a", "1"), ("v", "a", "1")], [("u", "a", "+"), ("v", "c", "?"), ("w", "b", "1")]])
@pytest.mark.parametrize("times", ["1", "+"])
def test_groups_of_siblings(spark, items, times):
    rng = random.Random(len(items))
    texts = ["".join(rng.choice("aabbbcd") for _ in range(rng.randrange(25))) for _ in range(30)]
    rows, want = [(0, None, "m", [], None)], []
    unit = "".join(k + t.removeprefix("1") for _, k, t in items)
    parts = "".join(f"({k}{t.removeprefix('1')})" for _, k, t in items)
    for n, text in enumerate(texts):
        rows.append((1 + n, 0, "m", [n], None))
        rows += [(1000 * (n + 1) + i, 1 + n, k, [n, i], None) for i, k in enumerate(text)]
        for run in re.finditer(f"(?:{unit}){times.removeprefix('1')}", text):
            units = []
            for m in re.finditer(unit, run[0]):
                at, made = run.start() + m.start(), []
                for g, (_, _, t) in enumerate(items):
                    size = len(re.fullmatch(parts, m[0])[g + 1])
                    own = [1000 * (n + 1) + i for i in range(at, at + size)]
                    made.append(own if t in "*+" else own[0] if own else None)
                    at += size
                units.append(tuple(made))
            want.append((1 + n, [n, run.start()], units))
    got = []
    for r in p.sequences(tree(spark, rows), [p.Item(*i) for i in items], times).collect():
        ids = lambda x: [y.node_id for y in x] if isinstance(x, list) and not hasattr(x, "node_id") else x and x.node_id
        got.append((r.parent_id, r["first"], [tuple(ids(u[n]) for n, _, _ in items) for u in r.units]))
    assert sorted(got) == sorted(want)


def test_groups_must_hold_something(spark):
    for bad in ([], [p.Item("u", "a", "*")], [p.Item("u", "a", "2")]):
        with pytest.raises(ValueError):
            p.sequences(None, bad)


def test_merged_patterns_are_the_single_ones(spark):
    rng = random.Random(3)
    rows = [(0, None, "m", [], "0")] + [(1 + i, 0, "n", [i], str(i % 4)) for i in range(20)] + [(100 + 10 * i + j, 1 + i, rng.choice("xyz"), [i, j], str(rng.randrange(3)), rng.choice(["", "a"])) for i in range(20) for j in range(5)]
    forest = tree(spark, rows)
    x, one = p.Pattern("x"), p.Pattern(named=None, where=F.col("text") == "1")
    found = p.merged(forest, {7: p.Pattern("n"), 8: p.Pattern("n", F.col("text") == "2", children={"a": x, "b": one}), 9: p.Pattern("n", children={"b": one}), 10: p.Pattern("x", F.col("text") == "1")})
    got = sorted((r.stanza, r.full.node_id, r.a and r.a.node_id, r.b and r.b.node_id) for r in found.collect())
    full = p.match(forest, "full", "n")
    want = [(7, r.full.node_id, None, None) for r in full.collect()]
    want += [(8, r.full.node_id, r.a.node_id, r.b.node_id) for r in p.child(p.child(p.match(forest, "full", "n", where=F.col("text") == "2"), forest, "full", "a", "x"), forest, "full", "b", named=None, where=F.col("text") == "1").collect()]
    want += [(9, r.full.node_id, None, r.b.node_id) for r in p.child(full, forest, "full", "b", named=None, where=F.col("text") == "1").collect()]
    want += [(10, r.full.node_id, None, None) for r in p.match(forest, "full", "x", where=F.col("text") == "1").collect()]
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2] or 0, r[3] or 0)) or sorted(map(repr, got)) == sorted(map(repr, want))
    with pytest.raises(ValueError):
        p.merged(forest, {0: p.Pattern("m", children={"c": p.Pattern("n", children={"d": x})})})


def test_one_reading_for_merged_patterns(spark):
    from copse.catalogue import QUERIES

    plan = QUERIES["q_merged_matches"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def scanned(text, arms):
    """What a scan means: all arms are tried on what is left of the text; None if one of them is found first where it is empty."""
    out, i = [], 0
    while i < len(text):
        found = [(m.start(), n, m) for n, a in enumerate(arms) if (m := re.search(re.sub(r"\$$", r"\\Z", a), text[i:]))]
        if any(m.end() == m.start() for _, _, m in found):
            return None
        if not found:
            return out
        _, n, m = min(found, key=lambda x: x[:2])
        out.append((n, m[0], [m[0], *(g or "" for g in m.groups())]))
        i += m.end()
    return out


@pytest.mark.parametrize("arms", [["([a-c])b", "(?P<n_1>a)|(c)"], ["^a", "b"], ["^ab", "^[a-c]"], ["a*"], ["a*b?", "c"], ["c$", "a"], [r"\bb", "a+"], [r"a\b", " "], [r"\Bb", "a"], ["b|$", "a"], ["(a|^b)c", "c"], [r"\b", "a"], ["x?$", "[abc ]"], ["(?i)B", " +"], [r"[\^$b]", "^"]])
def test_scans_against_their_meaning(spark, arms):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aabbc ") for _ in range(rng.randrange(9))) for _ in range(60)] + ["", "b", "ab", "é b", "a\nb"]
    want = {t: scanned(t, arms) for t in texts}
    good = spark.createDataFrame([(t,) for t, x in want.items() if x is not None], "t string").select("t", loops.scan(F.col("t"), arms).alias("x"), loops.tokens(F.col("t"), arms).alias("y"))
    for r in good.collect():
        assert [(x.arm, x.token, x.groups) for x in r.x] == want[r.t] and r.y == [x[1] for x in want[r.t]], r.t
    for t in [t for t, x in want.items() if x is None][:3]:
        with pytest.raises(Exception, match="EmptyRegexCapture"):
            spark.createDataFrame([(t,)], "t string").select(loops.scan(F.col("t"), arms)).collect()


def rank(v):
    """A value's place: kinds in order, integers by number, lists by their elements."""
    kind = 0 if v is None else 1 if isinstance(v, bool) else 2 if isinstance(v, int) else 3 if isinstance(v, str) else 5 if isinstance(v, frozenset) else 4
    return (kind, sorted(map(rank, v)) if kind == 5 else [rank(x) for x in v] if kind == 4 else v.encode() if kind == 3 else v or 0)


def test_values_in_order(spark):
    rng = random.Random(5)

    def some(depth):
        kind = rng.randrange(6 if depth else 4)
        return [None, rng.random() < 0.5, rng.choice([0, 9, 10, 100, 2**32 - 1]), rng.choice(["", "a", "a\0", "a\0b", "ab", "é", '"}', "10", "9"])][kind] if kind < 4 else (frozenset if kind == 5 else tuple)(some(depth - 1) for _ in range(rng.randrange(4)))

    def encoded(v):
        one = {0: lambda: values.null(), 1: lambda: values.boolean(F.lit(v)), 2: lambda: values.integer(F.lit(v)), 3: lambda: values.string(F.lit(v))}.get(rank(v)[0])
        return one() if one else values.sequence(F.array(*map(encoded, v)).cast("array<string>"), "set" if isinstance(v, frozenset) else "list")

    items = [some(2) for _ in range(40)]
    row = spark.range(1).select(*(encoded(v).alias(f"v{i}") for i, v in enumerate(items))).first()
    keyed = spark.createDataFrame([(i, x) for i, x in enumerate(row)], "i int, v string").withColumn("k", values.sort_key(F.col("v")))
    got = [rank(items[r.i]) for r in keyed.orderBy("k").collect()]
    assert got == sorted(map(rank, items))
    nodes = [values.graph_node(F.lit(3)), values.syntax_node(F.lit(5)), values.syntax_node(F.lit(-7)), values.sequence(F.array(values.null())), values.integer(F.lit(1)), values.integer(F.lit(1))]
    assert spark.range(1).select(values.read(values.sequence(F.array(*nodes), "set"), True).alias("v")).first().v == "{1, [#null], [syntax node -7], [syntax node 5], [graph node 3]}"


def test_long_strings_in_lists(spark):
    v = values.sequence(F.array(values.string(F.repeat(F.lit('a"'), 500_000)), values.integer(F.lit(1))))
    got = spark.range(1).select(F.length(values.read(v, False)).alias("n"), F.length(graphs.values.debug(v)).alias("d")).first()
    assert (got.n, got.d) == (1_000_005, 1_500_007)


def test_source_of_elements_and_words(spark, tmp_path):
    html = "<ul>\n<li>é <b>x</li>\n<br></ul>tail"
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    m = with_source(p.match(pages_forest(pages), "x"), pages.withColumnsRenamed({"page_id": "doc_id", "html": "text"}), "x", "s")
    got = {(r.doc_id, r.x.kind): r.s for r in m.collect()}
    assert got[1, "li"] == "<li>é <b>x</li>" and got[1, "b"] == "<b>x" and got[1, "ul"] == html[:-4] and got[1, "br"] == "<br>" and got[1, "page"] == html
    spark.createDataFrame([(1, "é a\n\nb é  c")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    forest = text_forest(spark, str(tmp_path), places=True)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert all(r.s == r.x.text for r in with_source(p.match(forest, "x"), docs, "x", "s").collect())


def test_hierarchy_of_any_depth(spark):
    steps = spark.createDataFrame([(f"k{i}", f"k{i + 1}") for i in range(60)] + [("k3", "z")], "supertype string, kind string")
    kinds = {tuple(r) for r in p.closed(steps).collect()}
    assert len(kinds) == 60 * 61 // 2 + 4 and ("k0", "z") in kinds
    with pytest.raises(ValueError, match="supertype of itself"):
        p.closed(spark.createDataFrame([("a", "b"), ("b", "a")], "supertype string, kind string"))
    with pytest.raises(ValueError, match="at most"):
        p.closed(steps, most=10)


def test_sites_of_what_collides(spark):
    rows = spark.createDataFrame([(1, 0, 3, "a"), (1, 0, 1, "b"), (1, 0, 2, "b"), (1, 1, 5, "c"), (1, 1, 6, "c")], "doc_id long, node long, line int, v string")
    found = graphs.conflicts(graphs.attributes(rows, {"x": values.string(F.col("v"))}, "node", site=F.struct("line"))).collect()
    assert [(r.source, r.n, r.first_site.line, r.last_site.line) for r in found] == [(0, 2, 1, 3)]
    bound = rows.select("doc_id", F.col("node").alias("scope"), F.col("v").alias("value"), F.struct("line").alias("site"))
    assert sorted((r.scope, r.n, r.first_site.line, r.last_site.line) for r in scoping.duplicated(bound).collect()) == [(0, 3, 1, 3), (1, 2, 5, 6)]
    nodes = spark.createDataFrame([(1, 0)], "doc_id long, node long")
    with pytest.raises(ValueError, match="first_site.*last_site"):
        graphs.validated(graphs.Graph(nodes, nodes.where("false").selectExpr("doc_id", "node AS source", "node AS sink"), graphs.attributes(rows, {"x": values.string(F.col("v"))}, "node", site=F.struct("line"))))


def test_scratch_folders(spark):
    kept = scratch.written(spark.range(3), "kept")
    assert kept.count() == 3
    scratch.forget(kept)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist|not found"):
        spark.read.parquet(kept.written_at).count()


def rows_out(plan, name):
    """How many rows the operators of a name gave in a plan that has run."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return rows_out(plan.executedPlan(), name)
    if plan.nodeName().endswith("QueryStage"):
        return rows_out(plan.plan(), name)
    below = plan.children()
    return sum(rows_out(below.apply(i), name) for i in range(below.size())) + (plan.metrics().apply("numOutputRows").value() if plan.nodeName() == name else 0)


def test_readers_share_what_they_inherit(spark):
    paths = {0: []} | {i: [i] for i in range(1, 6)} | {10: [1, 10], 11: [1, 10, 11], 12: [7]} | {100 + i: [1 + i % 5, i, 1, 2, 3, 4, 5] for i in range(300)} | {500: [1, 10, 11, 12, 13]}
    forest = tree(spark, [(n, None if n == 0 else 0, "m", path, None) for n, path in paths.items()])
    m = p.match(forest, "x")

    def got(bound):
        bindings = scoping.bind(m.where(F.col("x.node_id").isin(list(bound))), "x", F.when(F.col("x.node_id") % 2 == 0, F.col("x.node_id")))
        found = scoping.inherited(m, bindings, "x", "v")
        at = {tuple(paths[n]): n for n in bound}
        near = {n: next((at[tuple(path[:i])] for i in range(len(path), -1, -1) if tuple(path[:i]) in at), None) for n, path in paths.items()}
        assert {r.x.node_id: r.v for r in found.collect()} == {n: x if x is not None and x % 2 == 0 else None for n, x in near.items()}
        return rows_out(found._jdf.queryExecution().executedPlan(), "Generate")

    assert got([0, 2, 3]) <= 2 * 7  # two depths of bindings; the root and six nodes below it are all that readers can tell apart
    assert got([4, 10, 11, 500]) <= 4 * len(paths)
    assert got([]) == 0


@pytest.fixture
def folders(monkeypatch):
    """The folders of tables written on the way."""
    made, folder = [], scratch.folder

    def noted(spark, name):
        made.append(folder(spark, name))
        return made[-1]

    monkeypatch.setattr(scratch, "folder", noted)
    return made


def left(spark, made):
    where = [spark._jvm.org.apache.hadoop.fs.Path(x) for x in made]
    return [x.getName() for x in where if x.getFileSystem(spark._jsc.hadoopConfiguration()).exists(x)]


NODE = "doc_id long, node_id long, parent_id long, at int"


@pytest.mark.parametrize("wide", [False, True])
def test_bushy_trees_need_no_rounds_and_leave_one_table(spark, folders, monkeypatch, wide):
    def ends(*_, **__):
        raise AssertionError("pointer doubling")

    monkeypatch.setattr(spread, "ends", ends)
    docs = {d: [(0, None, 0)] + [(i, 0, i % 3) for i in range(1, 9 - d)] + [(10 * i + j, i, j % 2) for i in range(1, 9 - d, 2) for j in range(d)] for d in range(7)} | {7: [(5, None, 1), (6, None, 0)]}
    placed = from_parents(spark.createDataFrame([(d, *r) for d, rs in docs.items() for r in rs], NODE), "at", wide=wide)
    assert [x.split("-")[1] for x in left(spark, folders)] == ["places"]
    assert {(r.doc_id, r.node_id): (r.enter, r["exit"], r.depth) for r in placed.collect()} == {(d, n): x for d, rs in docs.items() for n, x in walked(rs).items()}
    alone = from_parents(spark.createDataFrame([(1, 7, None, 0), (1, 8, 9, 0), (2, 3, None, 0)], NODE), "at", wide=wide)
    assert {(r.doc_id, r.node_id): (r.enter, r["exit"], r.depth) for r in alone.collect()} == {(1, 7): (0, 1, 0), (1, 8): (None, None, None), (2, 3): (0, 1, 0)}


@pytest.mark.parametrize("wide", [False, True])
def test_places_of_deep_and_bushy_trees_together(spark, wide):
    rng, docs = random.Random(11), {}
    for d in range(12):
        rows = [(i, None, rng.randrange(4)) for i in range(1 + d % 4)]  # some of them bushy, some deep, some alone
        for i in range(len(rows), 40 + 20 * d):
            up = rng.randrange(i) if rng.random() < 0.5 else max(i - 1 - rng.randrange(2), 0)
            rows.append((i, up, rng.randrange(4)))
        docs[d] = rows + [(9000, None, -1), (9001, None, 9)]
    lost = [(d, x, y, 0) for d in range(3) for x, y in ((700, 699), (701, 700), (702, 701), (703, 700), (800, 801), (801, 800), (802, 800), (803, 802))]
    got = {(r.doc_id, r.node_id): (r.enter, r["exit"], r.depth) for r in from_parents(spark.createDataFrame([(d, *r) for d, rs in docs.items() for r in rs] + lost, NODE).repartition(5), "at", wide=wide).collect()}
    want = {(d, n): x for d, rs in docs.items() for n, x in walked(rs).items()} | {(d, n): (None, None, None) for d, n, _, _ in lost}
    assert got == want


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    shuffled = lambda: {f for d in spark._jsc.sc().env().blockManager().diskBlockManager().localDirs() for f in Path(d.getPath()).rglob("shuffle_*")}
    before = shuffled()
    kept = scratch.written(spark.range(1000).repartition(3, "id").groupBy("id").count(), "kept")
    until = time.time() + 10
    while (more := shuffled() - before) and time.time() < until:
        time.sleep(0.1)
    assert not more and kept.count() == 1000
    assert spark.conf.get(scratch.CLEANUP, "false") == "false"


def test_inheritance_by_places_moves_readers_once(spark):
    rng = random.Random(12)
    rows = [(d, i, None if i == 0 or i % 37 == 0 else rng.randrange(max(i - 6, 0), i), i) for d in range(3) for i in range(150)]
    up = {(d, n): u for d, n, u, _ in rows}
    bound = {(d, n): rng.choice([None, n]) for d, n, *_ in rows if n % 4 == d}
    placed = scratch.written(from_parents(spark.createDataFrame(rows, NODE), "at"), "placed")
    given = placed.join(spark.createDataFrame([(*k, v) for k, v in bound.items()], "doc_id long, node_id long, value long"), ["doc_id", "node_id"])
    matches = placed.select("doc_id", F.when(F.col("node_id") != 5, F.struct("node_id", "enter")).alias("x"), F.col("node_id").alias("n"))
    found = scoping.inherited_between(matches, given.select("doc_id", "enter", "exit", "value"), "x", "v")
    assert found.columns == ["doc_id", "x", "n", "v"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan

    def near(d, n):
        while n is not None and (d, n) not in bound:
            n = up[d, n]
        return None if n is None else bound[d, n]

    assert {(r.doc_id, r.n): r.v for r in found.collect()} == {(d, n): None if n == 5 else near(d, n) for d, n in up}


def test_orders_without_their_customer_have_no_places(spark, tmp_path):
    import duckdb

    from copse.catalogue import ORACLES, QUERIES

    con = duckdb.connect()
    for name, kept in {"customer": "c_custkey % 40 = 1", "orders": "o_custkey % 40 < 4", "lineitem": "true"}.items():
        con.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.001/{name}.parquet' WHERE {kept}) TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    for name in ("q_parent_forest", "q_inherit_between"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
        assert len(want) > 20 and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
