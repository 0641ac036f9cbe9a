"""Edges between chunks and lines touched by patches."""

import difflib
import random

from stratalog.functions import code as C
from stratalog.functions import patches
from stratalog.operators import graph as G


def test_ranges_of_patches():
    rng = random.Random(1)
    for _ in range(200):
        old = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        new = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        got = patches.ranges(patches.make("f", "".join(x + "\n" for x in old), "".join(x + "\n" for x in new)))
        want = [("modified" if tag == "replace" else "added", c, d - 1) for tag, _, _, c, d in difflib.SequenceMatcher(None, old, new).get_opcodes() if tag in ("replace", "insert")]
        assert got == want


CHUNKS = "chunk_id string, snapshot_id string, path string, content string, symbols array<string>, imports array<string>, kind string, lang string"


def test_edges(spark):
    rows = [
        ("a", "s", "src/a.py", "def one(): two(); two()", ["one"], ["from lib.bee import two"], "function", "python"), ("b", "s", "lib/bee.py", "class two(one): pass", ["two"], None, "class", "python"),
        ("t", "s", "test/t.py", "one", None, [], None, None), ("o", "other", "x.py", "one()", ["one"], None, "function", "python"), ("a2", "s", "src/a2.py", "def one(): two(); two()", ["one"], None, "function", "python"),
    ]
    c = spark.createDataFrame(rows, CHUNKS)
    pairs = lambda df: {(r.src, r.dst) for r in df.collect()}
    assert pairs(G.call_edges(c)) == {("a", "b"), ("a2", "b"), ("a", "a2"), ("a2", "a")}
    assert pairs(G.inherit_edges(c)) == {("b", "a"), ("b", "a2")} and ("a", "b") in pairs(G.import_edges(c))
    assert pairs(G.test_edges(c)) == {("t", "a"), ("t", "a2")}
    assert {(r.src, r.dst, r.strength) for r in G.similar_edges(c).collect()} == {("a", "a2", 1.0)}
    hops = {(r.src, r.dst): r.hops for r in G.reach(spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "w"), ("w", "v"), ("z", "x")], "src string, dst string")).collect()}
    assert hops[("x", "w")] == 3 and ("x", "v") not in hops and hops[("z", "y")] == 2


def test_uses_are_not_calls(spark):
    rows = [("a", "s", "a.py", "x = two; two(1); two", ["one"], None, None, None), ("b", "s", "b.py", "pass", ["two"], None, None, None)]
    assert [(r.src, r.dst, round(r.strength, 6)) for r in G.use_edges(spark.createDataFrame(rows, CHUNKS)).collect()] == [("a", "b", 0.2)]


def test_quality_and_debt(spark):
    plain, bad = "# says what it does\ndef run(value):\n    return value\n", "var x = eval('1');\n" + "if (a && b) { for (;;) { while (c) { x(); } } }\n" * 60 + 'password = "abc"; // TODO\n'
    df = spark.createDataFrame([(0, plain, "python"), (1, bad, "javascript"), (2, "", None)], "id int, content string, lang string")
    got = {r.id: r for r in df.select("id", C.overall_quality("content", "lang").alias("q"), C.security_score("content", "lang").alias("s"), C.quality_complexity("content").alias("c"), C.debt("content", "lang").alias("d")).collect()}
    assert all(0 <= r.q <= 100 for r in got.values()) and got[0].q > got[1].q + 20
    assert got[0].s == 100 and got[1].s == 75 and got[0].c == 3 and got[1].c == 100
    assert got[0].d.hours == 0 and got[0].d.severity == "none" and got[1].d.hours == 3 * 2 + 2 * 4 and got[1].d.severity == "high"


def test_links_by_text_and_path(spark):
    from stratalog.operators import links as L

    rows = [
        ("a", "s", "src/app/a.ts", "import './b'\nclass A extends Base implements Face { go() { one(); new Base() } }", ["A"], ["./b", "../lib/c", "", None], "class", "typescript"),
        ("b", "s", "src/app/b.ts", "class Base {}\nfunction one() {}", [], [], "class", "typescript"), ("c", "s", "src/lib/c.ts", "interface Face {}", None, None, "interface", "typescript"),
        ("p", "s", "pkg/p.py", "class P(Q): pass", ["P"], ["pkg.q"], "class", "python"), ("q", "s", "pkg/q.py", "class Q: pass\none()", ["Q"], ["lib/other"], "class", "python"), ("x", "t", "src/app/b.ts", "class Base {}", ["one"], [], "class", "typescript"),
    ]
    c = spark.createDataFrame(rows, CHUNKS)
    pairs = lambda df: {(r.src, r.dst) for r in df.collect()}
    assert pairs(L.imported(c)) == {("a", "b"), ("a", "c"), ("p", "q")}
    assert pairs(L.called(c)) == {("a", "b"), ("q", "b")}
    assert {(r.src, r.dst, r.rel) for r in L.inherited(c).collect()} == {("a", "b", "extends"), ("a", "c", "implements"), ("p", "q", "extends")}
    assert ("a", "b") in pairs(L.instantiated(c))
    assert {r.rel for r in L.linked(c, 0.85).collect()} == {"imports", "extends"} and L.linked(c.limit(0)).count() == 0


def test_nesting_and_graph_of_a_file(spark):
    from stratalog.operators import links as L

    pieces = spark.createDataFrame([("s", "f", 0, None, 0, 9), ("s", "f", 1, 0, 2, 4), ("s", "g", 0, None, 0, 1)], "snapshot_id string, path string, ordinal int, parent int, start_line int, end_line int")
    assert {(r.src, r.dst, r.rel) for r in L.nested(pieces).collect()} == {("2-4", "0-9", "extends"), ("0-9", "2-4", "uses")}
    rows = [("a", "s", "f", 0, "two(); two(); extends far", ["one"], ["x"]), ("b", "s", "f", 60, "nothing", ["two"], ["x", "y"]), ("c", "s", "f", 400, "z", ["far"], None), ("d", "s", "f", 10, "q", None, ["x"]), ("e", "s", "g", 0, "one", ["nine"], [])]
    c = spark.createDataFrame(rows, "chunk_id string, snapshot_id string, path string, start_line int, content string, symbols array<string>, imports array<string>")
    got = {(r.src, r.dst): (r.rel, round(r.strength, 6)) for r in L.file_graph(c).collect()}
    assert got == {("a", "b"): ("calls", 0.88), ("a", "c"): ("extends", 0.5), ("b", "a"): ("uses", 0.18)}


def test_checks_of_edges_and_measures(spark):
    from stratalog.operators import validation as V

    edges = spark.createDataFrame([("a", "b", "calls", 0.5, 0.7), ("a", "", "likes", 1.5, None), ("a", "a", "uses", 0.0, 1.0)], "src string, dst string, rel string, strength double, confidence double")
    got = {r.dst: (r.errors, r.warnings, r.score) for r in V.validated_edges(edges).collect()}
    assert got["b"] == ("", "", 100) and got["a"] == ("", "SELF_REFERENCE", 98)
    assert got[""] == ("INVALID_RELATIONSHIP_TYPE|MISSING_TARGET_CHUNK_ID|INVALID_RELATIONSHIP_STRENGTH|INVALID_RELATIONSHIP_CONFIDENCE", "", 60)
    schema = "chunk_id string, start_line int, end_line int, content string, kind string, complexity double, maintainability long, dependencies array<string>, patterns array<string>, smells array<string>, concerns array<string>, frameworks array<string>, documentation double, security_risk int, performance_risk int, layer string"
    rows = [("ok", 0, 1, "x", "class", 3.0, 90, [], [], [], [], [], 0.1, 0, 0, "data"), ("bad", 0, 900, "x" * 10_001, "thing", 90.0, 10, None, [], [], [], [], 2.0, 75, 80, None)]
    got = {r.chunk_id: r for r in V.validated_measures(spark.createDataFrame(rows, schema)).collect()}
    assert got["ok"].score == 100 and got["bad"].errors == "INVALID_SEMANTIC_TYPE|INVALID_DEPENDENCIES|INVALID_DOCUMENTATION_RATIO|INVALID_ARCHITECTURAL_LAYER"
    assert got["bad"].warnings == "LARGE_CHUNK|LARGE_LINE_RANGE|HIGH_COMPLEXITY|LOW_MAINTAINABILITY|HIGH_SECURITY_RISK|HIGH_PERFORMANCE_RISK"
