"""Sources, store, chunkers, ranking, search, triggers, service."""

import random
from datetime import datetime, timedelta

import pytest

from stratalog import api
from stratalog.functions import text as X
from stratalog.operators import chunking as K
from stratalog.operators import ranking as R
from stratalog.operators import triggers as T
from stratalog.operators.vector_search import cosine_top_k, two_rounds
from stratalog.sources import store, tree
from stratalog.streaming import watch

NOW = datetime(2024, 1, 1)


def test_ignore_rules_and_scan(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("*.log\nbuild/\n/only.txt\n!keep.log\n# remark\n")
    for p, b in {"a.py": b"x = 1\n", "b.log": b"l", "sub/keep.log": b"k", "build/x.txt": b"b", "only.txt": b"o", "sub/only.txt": b"s", "node_modules/m/i.js": b"m", "p.png": b"p", "raw": b"\0\1", "utf.md": "grün".encode()}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b)
    got = {r.path: r for r in tree.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {".gitignore", "a.py", "sub/keep.log", "sub/only.txt", "p.png", "raw", "utf.md"}
    assert got["a.py"].content == "x = 1\n" and got["p.png"].is_binary and got["raw"].is_binary and got["raw"].content is None
    (tmp_path / ".snapshotignore").write_text("")
    assert "b.log" in {r.path for r in tree.scan(spark, str(tmp_path)).collect()}


def test_actions(spark, tmp_path):
    (tmp_path / "old").write_text("x")
    rows = [("old", "delete", None), ("new/f", "write", "text")]
    assert tree.apply_actions(spark.createDataFrame(rows, "path string, action string, content string"), str(tmp_path)) == 2
    assert not (tmp_path / "old").exists() and (tmp_path / "new/f").read_text() == "text"
    with pytest.raises(ValueError, match="leads out"):
        tree.apply_actions(spark.createDataFrame([("../evil", "write", "x")], "path string, action string, content string"), str(tmp_path))


def test_globs(spark):
    rows = [("src/a/b.ts",), ("src/c.py",), ("README.md",)]
    df = spark.createDataFrame(rows, "path string")
    match = lambda p, **k: {r.path for r in df.filter(X.path_matches("path", p, **k)).collect()}
    assert match("src/**/*.ts") == {"src/a/b.ts"} and match("src/") == {"src/a/b.ts", "src/c.py"} and match("*.{md,ts}") == {"README.md"}
    assert match("src/c.py") == {"src/c.py"} and match("c.py") == set() and match("c.py", substring=True) == {"src/c.py"}


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "st"))
    assert s.snapshots() is None
    snaps = spark.createDataFrame([("a", NOW), ("b", NOW + timedelta(1)), (None, NOW)], "snapshot_id string, ts timestamp")
    entries = spark.createDataFrame([("a", "f", "1"), ("b", "f", "2"), ("z", "f", "3")], "snapshot_id string, path string, content string")
    s.save(snaps, entries)
    s.save(snaps.filter("snapshot_id = 'b'"), entries.filter("snapshot_id = 'b'").withColumn("content", X.F.lit("new")))
    assert [r.snapshot_id for r in s.listed().collect()] == ["a", "b"] and {r.content for r in s.entries().collect()} == {"1", "new"}
    assert s.export("b", str(tmp_path / "x")) > 10
    s.upsert_vectors(spark.createDataFrame([("a", "c1"), ("b", "c2")], "snapshot_id string, chunk_id string"), spark.createDataFrame([("c1", [1.0]), ("c2", [0.5])], "chunk_id string, embedding array<double>"))
    s.delete("a")
    assert [r.snapshot_id for r in s.listed().collect()] == ["b"] and [r.chunk_id for r in s.vectors().collect()] == ["c2"]
    with pytest.raises(Exception, match="no vector"):
        s.upsert_vectors(spark.createDataFrame([("a", "c9")], "snapshot_id string, chunk_id string"), spark.createDataFrame([("c1", [1.0])], "chunk_id string, embedding array<double>"))


SCRIPT = """import { a } from './a';

export class Outer {
  run(x) {
    if (x) { return "}"; }
  }
  /* { */
  stop() {
  }
}

function helper() {
  return 1;
}
const arrow = (y) => {
  return helper();
};
"""
PYTHON = "import a\n\n@deco\ndef one(x):\n    def inner():\n        return 1\n    return inner\n\nclass Two:\n    def m(self):\n        pass\n\nend = 1\n"


def test_declarations():
    got = [(n.kind, n.name, n.start, n.end, n.level, n.parent) for n in K.nodes(SCRIPT, "javascript")]
    assert got == [("class", "Outer", 2, 9, 0, -1), ("method", "run", 3, 5, 1, 0), ("method", "stop", 7, 8, 1, 0), ("function", "helper", 11, 13, 0, -1), ("function", "arrow", 14, 16, 0, -1)]
    got = [(n.kind, n.name, n.start, n.end, n.level) for n in K.nodes(PYTHON, "python")]
    assert got == [("function", "one", 2, 6, 0), ("function", "inner", 4, 5, 1), ("class", "Two", 8, 10, 0), ("function", "m", 9, 10, 1)]


@pytest.mark.parametrize("strategy", ["base", "semantic", "hierarchical", "context-aware", None])
def test_chunks_lie_in_their_files(spark, strategy):
    files = spark.createDataFrame([("s", "a/x.js", "javascript", SCRIPT), ("s", "b/x.js", "javascript", SCRIPT), ("s", "p.py", "python", PYTHON), ("s", "t.txt", "text", "words\n" * 130), ("s", "n", None, None), ("s", "e", None, " \n")], "snapshot_id string, path string, lang string, content string")
    got = K.chunked(files, strategy, 40, 5).collect()
    text = {r.path: r.content.split("\n") for r in files.collect() if r.content}
    assert {r.path for r in got} == {"a/x.js", "b/x.js", "p.py", "t.txt"} and len({r.chunk_id for r in got}) == len(got)
    for r in got:
        assert 0 <= r.start_line <= r.end_line < len(text[r.path]) and r.content.split("\n") == text[r.path][r.start_line : r.end_line + 1]


def test_strategy_choice():
    assert K.chosen(SCRIPT, "javascript", "context-aware") == "contextAware" and K.chosen(SCRIPT, "javascript") == "semantic" and K.chosen("x", "text", "hierarchical") == "semantic"


def test_sections_and_overlaps():
    spans = K.sections("a\n\n\nb\n" + "x\n" * 500, "text", 100)
    assert spans[0][0] == 0 and all(b - a <= 200 for a, b in spans)
    assert K.overlapped([(0, 9), (5, 12), (14, 20)], 6) == [(0, 12), (10, 20)] and K.packed([(0, 4), (5, 8), (9, 30)], 10) == [(0, 8), (9, 30)]


def test_greedy_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(f"q{q}", q * 1000 + i, i, f"f{rng.randrange(6)}", f"g{rng.randrange(9)}", f"l{rng.randrange(3)}", [f"p{rng.randrange(3)}"] if rng.random() < 0.5 else []) for q in range(12) for i in range(60)]
    got = {(r.query_id, r.hit_id, r.kept) for r in R.greedy(spark.createDataFrame(rows, "query_id string, hit_id long, place int, file_path string, function string, layer string, patterns array<string>")).collect()}
    want = set()
    for q in {r[0] for r in rows}:
        kept, seen = [], set()
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: r[2]):
            n = lambda i: sum(k[i] == r[i] for k in kept)  # noqa: B023, E731
            if len(kept) >= 20 or n(3) >= 3 or n(4) >= 2 or (r[6] and sum(bool(k[6]) for k in kept) > 5 and set(r[6]) <= seen) or (len(kept) > 8 and n(5) >= 3):
                continue
            kept.append(r)
            seen |= set(r[6])
            want.add((q, r[1], len(kept)))
    assert got == want


def test_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 4) for i in range(200)] + [(500, None, 1), (501, [], 1), (502, [0.0] * 8, 1), (503, [1.0], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {}
    for r in cosine_top_k(v, v.filter("vec_id % 20 = 0"), 5, block=3).collect():
        got.setdefault(r.query, []).append((r.place, r.vec_id))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    for q in range(0, 200, 20):
        want = sorted(range(200), key=lambda i: (-cos(rows[q][1], rows[i][1]), i))[:5]
        assert [i for _, i in sorted(got[q])] == want
    assert cosine_top_k(v, v.filter("false"), 5).count() == 0
    hits = spark.createDataFrame([("q", f"f{i % 3}", 1 - i / 100, i) for i in range(30)], "q string, f string, score double, id int")
    assert {r.id for r in two_rounds(hits, ["q"], ["f"], "score", ["id"], 4, 2).collect()} == {0, 1, 2, 3}


def events(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(i, f"t{rng.randrange(3)}", NOW + timedelta(minutes=rng.randrange(20_000))) for i in range(600)], "event_id long, event_type string, ts timestamp")


def test_stream_fires_like_the_batch(spark, tmp_path):
    e = events(spark).orderBy("ts")
    rows = e.collect()
    for n in range(3):  # files that follow one another in time
        spark.createDataFrame(rows[n * 200 : n * 200 + 200], e.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = {(r.rule, r.event_id) for r in T.throttled(e, "event_type", "ts", "event_id", 6).collect()}
    out = []
    stream = watch.throttled(watch.read_events(spark, str(tmp_path / "in"), e), "event_type", "event_id", 6)
    q = stream.writeStream.foreachBatch(lambda df, i: out.extend((r.rule, r.id) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert batch and set(out) == batch and len(out) == len(batch)


def test_stream_sessions_that_closed(spark, tmp_path):
    e = events(spark)
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {(r.event_type, r.started, r.events) for r in T.sessions(e, ["event_type"], "ts", 15).collect()}
    q = watch.sessions(watch.read_events(spark, str(tmp_path / "in"), e), "event_type").writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(r.event_type, r.started, r.events) for r in spark.sql("select * from closed").collect()}
    assert got and got <= batch and len(got) >= len(batch) - 6


def test_service(spark):
    snaps = spark.createDataFrame([("s1", "w", NOW, NOW, ["a"], "first", False, False, None), ("s2", "w", NOW + timedelta(1), NOW, None, None, None, None, None)], "snapshot_id string, workspace string, ts timestamp, received_at timestamp, tags array<string>, description string, is_favorite boolean, is_selective boolean, selected_files array<string>")
    files = spark.createDataFrame([("s1", "a.py", PYTHON, None, None, None, None, NOW), ("s1", "b", "b", None, None, None, None, NOW), ("s2", "a.py", None, "", "s1", None, None, NOW), ("s2", "c", "c", None, None, None, None, NOW)], "snapshot_id string, path string, content string, diff string, base_snapshot_id string, deleted boolean, is_binary boolean, received_at timestamp")
    chunks = K.chunked(spark.createDataFrame([("s1", "a.py", "python", PYTHON)], "snapshot_id string, path string, lang string, content string"), "semantic").withColumns({"lang": X.F.lit("python"), "symbols": X.F.array("name"), "ratio": X.F.lit(0.0), "imports": X.F.array().cast("array<string>")})
    s = api.Service(spark, snaps, files, chunks)
    assert s.get_status()["snapshots"] == 2 and [r.snapshot_id for r in s.get_snapshots(any_tags=["a"]).collect()] == ["s1"]
    assert {(r.path, r.change) for r in s.compare_snapshots("s1", "s2").collect()} == {("a.py", "U"), ("b", "D"), ("c", "A")}
    assert s.get_snapshot_file_content("s2", "a.py").first().content == PYTHON and s.navigate_snapshot("s1").first().snapshot_id == "s2"
    plan = s.restore_snapshot("s1", spark.createDataFrame([("a.py", "x"), ("z", "z")], "path string, content string"))
    assert {(r.path, r.action) for r in plan.collect()} == {("a.py", "overwrite"), ("b", "write"), ("z", "delete")}
    assert {r.change for r in s.take_snapshot(spark.createDataFrame([("a.py", PYTHON, False), ("b", "2", False)], "path string, content string, is_binary boolean"), "s1").collect()} == {"U", "M"}
    s._vectors = s.index_snapshots()
    assert s.enhanced_search("def one inner return", 2, 0.1).count() >= 1 and s.analyze_chunk().count() == 2
    assert s.process_query("how to fix a login error")["intent"] == "find_examples" and s.enhanced_chunk_file("s2", "a.py").count() == 2
    ops = spark.createDataFrame([(1, "nope"), (2, chunks.first().chunk_id)], "id int, chunk_id string")
    assert {(r.id, r.status, r.code) for r in s.batch_analyze(ops).collect()} == {(1, "failed", "RESOURCE_NOT_FOUND"), (2, "done", None)}


def test_small_parsers():
    assert api.relative_time("2d", NOW) == NOW - timedelta(days=2) and api.relative_time("2024-02-01", NOW) == datetime(2024, 2, 1)
    assert api.parsed_tags(" a, ,b") == ["a", "b"] and api.criteria(min_complexity=5, max_complexity=20, quality=0.8, types="function, class") == {"types": ["function", "class"], "complexity": (5, 20), "quality": 0.8}
    calls = []

    def work():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("network down")
        return "ok"

    assert api.retried(work, pause=0.001) == "ok" and len(calls) == 3
    with pytest.raises(RuntimeError, match="permission"):
        api.retried(lambda: {"success": False, "error": "no permission"}, pause=0.001)


def test_snapshots_taken(spark):
    snaps = spark.createDataFrame([("s1", "w", NOW, NOW, None, None, None, None, None)], "snapshot_id string, workspace string, ts timestamp, received_at timestamp, tags array<string>, description string, is_favorite boolean, is_selective boolean, selected_files array<string>")
    files = spark.createDataFrame([("s1", "a", "1", None, None, None, None, NOW), ("s1", "bin", None, None, None, None, True, NOW)], "snapshot_id string, path string, content string, diff string, base_snapshot_id string, deleted boolean, is_binary boolean, received_at timestamp")
    s = api.Service(spark, snaps, files)
    now = lambda *rows: spark.createDataFrame(list(rows), "path string, content string, is_binary boolean")
    same = now(("a", "1", False), ("bin", None, True))
    assert {(r.path, r.change) for r in s.take_snapshot(same, "s1").collect()} == {("a", "U"), ("bin", "U")} and s.take_snapshot(same, "s1", automatic=True).count() == 0
    turned = now(("a", None, True), ("bin", "text", None), ("c", "", False))
    assert {(r.path, r.change, r.content) for r in s.take_snapshot(turned, "s1", automatic=True).collect()} == {("a", "M", None), ("bin", "M", "text"), ("c", "A", "")}


def test_semantic_chunks_keep_all_text():
    text = "import a\n\nx = 1\n\n" + PYTHON + "\n\nif __name__:\n    main()\n"
    rows = text.split("\n")
    nodes = K.STRATEGIES["semanticComplete"](text, "python", 200, 0)
    covered = {i for n in nodes for i in range(n.start, n.end + 1)}
    assert all(i in covered for i, r in enumerate(rows) if r.strip()) and {n.kind for n in nodes} >= {"code", "function"}
    assert [(n.start, n.end) for n in K.STRATEGIES["semantic"](text, "python", 200, 0)] == [(n.start, n.end) for n in nodes if n.kind != "code"]


def test_batches_are_analysed(spark):
    chunks = spark.createDataFrame([("c1", "s", "a.py", 0, 1, "def a():\n    return 1", "python", ["a"], [], 0.0)], "chunk_id string, snapshot_id string, path string, start_line int, end_line int, content string, lang string, symbols array<string>, imports array<string>, ratio double")
    empty = spark.createDataFrame([], "snapshot_id string, workspace string, ts timestamp, received_at timestamp, is_selective boolean, selected_files array<string>"), spark.createDataFrame([], "snapshot_id string, path string, content string, diff string, base_snapshot_id string, deleted boolean, is_binary boolean, received_at timestamp")
    s = api.Service(spark, *empty, chunks)
    ops = spark.createDataFrame([(1, "c1"), (2, "no"), (3, None)], "id int, chunk_id string")
    got = {r.id: r for r in s.batch_analyze(ops).collect()}
    assert got[1].status == "done" and got[1].kind == "function" and got[1].complexity is not None and got[2].status == got[3].status == "failed" and got[2].kind is None
    assert {r.id: r.status for r in s.batch_analyze(ops, all_or_none=True).collect()} == {1: "skipped", 2: "failed", 3: "failed"}


def test_filters_are_counted_and_described():
    f = api.Filters(any_tags=["x"], since="2024-01-01", until="2024-02-01", pattern="")
    assert f.count() == 2 and f.toggle_favorite().count() == 3 and f.toggle_favorite().count() == 2
    assert f.description() == "2024-01-01 to 2024-02-01; any tags: x" and f.clear("any_tags").count() == 1 and f.clear().count() == 0
    with pytest.raises(KeyError):
        f.set("other", 1)


def test_filtered_hits_and_alternatives(spark):
    from stratalog.operators import ranking as R

    rows = [(1, "q", 1, "src/a.ts", "function", 0.9, 0.9, 3, ["Factory"], ["Dead Code"]), (2, "q", 2, "src/a.ts", "function", 0.85, 0.7, 9, [], []), (3, "q", 3, "lib/b.ts", "class", 0.2, 0.9, 1, None, None), (4, "q", 4, "src/c.ts", "function", 0.8, None, 2, [], [])]
    h = spark.createDataFrame(rows, "hit_id long, query_id string, place int, file_path string, kind string, score double, readability double, cyclomatic int, patterns array<string>, smells array<string>").withColumn("hit_ts", X.F.lit(NOW))
    ids = lambda **k: {r.hit_id for r in R.selected(h, **k).collect()}
    assert ids() == {1, 2, 4} and ids(quality=0.8) == {1} and ids(complexity=(2, 3)) == {1, 4} and ids(least=0, types=["class"]) == {3} and ids(patterns=["Factory"]) == {1}
    assert ids(without_smells=["Dead Code"]) == {2, 4} and ids(include=["src/*.ts"], exclude=["**/c.ts"]) == {1, 2} and ids(until="2000-01-01") == set()
    got = {(r.hit_id, r.other): (r.similarity, r.prefer) for r in R.alternatives(h, ["query_id"]).collect()}
    assert got[(1, 4)][0] == 0.75 and (1, 2) not in got and (1, 3) not in got  # the last are too far, the others the same


def test_no_machine_folder_on_a_cluster(spark, monkeypatch):
    from stratalog import session

    class Remote:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        session.shared_folder(Remote())


def test_vector_index(spark):
    import numpy as np

    from stratalog.operators import vector_index as I
    from stratalog.operators.vector_search import cosine_top_k

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 2
    rows = [(i, (centres[i % 12] + rng.normal(size=16)).tolist()) for i in range(1500)] + [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [1.0, 2.0]), (9005, [float("nan")] * 16)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = v.filter("vec_id % 100 = 0 or vec_id > 9000")
    c = I.fit(v)
    index = I.indexed(v, c)
    assert index.count() == 1504 and {r.vec_id for r in index.filter("list = -1").collect()} == {9002, 9003, 9004, 9005}
    exact, n = cosine_top_k(v, v.filter("vec_id % 100 = 0"), 10), I.probes_for(v, c, 10)
    assert 1 <= n < len(c)
    got = I.recall(I.search(index, c, asked, 10, n), exact).collect()
    assert len(got) == 15 and sum(r.found for r in got) >= 0.9 * sum(r.wanted for r in got)
    whole = I.search(index, c, asked, 10, probes=10**6)
    assert {(r.query, r.vec_id, r.place) for r in whole.collect()} == {(r.query, r.vec_id, r.place) for r in exact.collect()}
    assert I.fit(v.limit(0)).size == 0 and I.search(I.indexed(v, I.fit(v.limit(0))), I.fit(v.limit(0)), asked, 10, 1).count() == 0
