import json
import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import shared
from glyphmill.functions import text as T
from glyphmill.operators import fuzzy, graph, index, outline, search, symbols, versions
from glyphmill.plans import dispatch
from glyphmill.plans import queries as Q
from glyphmill.sources import files as S
from glyphmill.sources import logs, projects, snapshot
from glyphmill.streaming import changes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    return tuple(map(_norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = duck.sql(Q.ORACLE[name])
    at = [rel.columns.index(c) for c in columns]
    got = sorted(repr(tuple(_norm(r[c]) for c in columns)) for r in df.collect())
    assert sorted(rel.columns) == columns
    assert got == sorted(repr(tuple(_norm(r[i]) for i in at)) for r in rel.fetchall())


def test_fuzzy_facts():
    paths = ["src/auth_middleware.py", "src/auth.py", "src/middleware/auth.py", "src/utils.py"]
    assert fuzzy.fuzzy_score("authmid", paths).argmax() == 0
    exact, partial = fuzzy.fuzzy_score("main.zig", ["src/main.zig", "src/main_helper.zig"])
    assert exact > partial
    assert math.isnan(fuzzy.fuzzy_score("zzzzxyz", ["src/main.zig"])[0])


def test_words_and_subtokens(spark):
    files = spark.createDataFrame([("a.zig", "get_or_put validateToken HTTPHandler x")], "path string, content string")
    got = {r.word for r in index.word_hits(files).collect()}
    assert {"get_or_put", "get", "or", "put", "validatetoken", "validate", "token", "httphandler", "http", "handler"} == got


def test_regex_decomposition_and_dialect():
    every, groups = search.regex_trigrams("handleRequest")
    assert len(every) == 11 and not groups
    assert len(search.regex_trigrams("foo.*bar.*baz")[0]) == 3
    assert [len(g) for g in search.regex_trigrams("alpha|beta|gamma")[1]] == [8]
    assert search.regex_trigrams("ab|foobar") == ([], [])
    assert T.line_regex("abc\\") is None


def test_graph_cycle_and_basename(spark):
    e = spark.createDataFrame([("a", 0, "b"), ("b", 0, "c"), ("c", 0, "a"), ("src/main.zig", 0, "store.zig")], "path string, ord int, dep string")
    assert {r.path for r in graph.transitive(e, "a").collect()} == {"b", "c"}
    assert [r.path for r in graph.imported_by(e, "src/store.zig").collect()] == ["src/main.zig"]


def test_edits_and_invalid_ranges(spark):
    df = spark.createDataFrame([("line 1\nline 2\n",)], "c string")
    edit = lambda *a: df.select(versions.apply_edit(F.col("c"), *a).alias("x")).first().x
    assert edit("replace", 0, 1, "n") is None and edit("replace", 3, 3, "n") is None
    assert edit("replace", 2, 9, "n") == "line 1\nn\n"


def test_outline_of_python_docstrings(spark):
    code = 'def real_func():\n    """\n    def fake():\n    """\n    return 1\n\nclass A:\n    pass\n'
    rows = symbols.symbols(spark.createDataFrame([("m.py", code)], "path string, content string")).orderBy("ord").collect()
    assert [(r.name, r.line_start, r.line_end) for r in rows] == [("real_func", 1, 5), ("A", 7, 8)]


def _tree(folder, files):
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


def test_reading_a_tree_and_snapshots(spark, tmp_path):
    root = _tree(tmp_path / "a+b (c).d", {
        "src/a.py": "x = 1\n", "node_modules/b.js": "y", ".env": "k", "skip.log": "z", ".gitignore": "*.log\n/gone\nlater/\n", "bin.dat": b"a\0b", "pkg/__init__.py": "", "pkg/_priv.py": "p\n",
        ".github/ci.yml": "on: push\n", "gone/x.py": "1", "deep/later/y.py": "2", S.IGNORE_FILE: "# own\n!kept\nsecret_dir\n", "secret_dir/z.py": "3", "big.txt": "b" * (S.LARGEST + 1), "odd.txt": b"\xff\xfe ok",
    })
    files = S.read_files(spark, root, policy=False)
    assert {r.path for r in files.collect()} == {"src/a.py", ".gitignore", "pkg/__init__.py", "pkg/_priv.py", ".github/ci.yml", S.IGNORE_FILE, "odd.txt"}
    assert files.where("path = 'src/a.py'").first()["size"] == 6
    assert not S.indexable_root("/tmp/x") and not S.safe_path("a/../b")
    with pytest.raises(ValueError):
        S.read_files(spark, "/tmp/x")
    assert S.read_file(root, "src/a.py") == "x = 1\n" and S.read_file(root, ".env") is None and S.read_file(root, "../x") is None and S.read_file(root, "none") is None
    out = str(tmp_path / "snap")
    snapshot.write_snapshot(files, {"words": index.word_hits(files)}, out, root="r", git_head="abc")
    assert snapshot.read_snapshot(spark, out, root="other") is None
    assert snapshot.read_snapshot(spark, out, root="r", git_head="def") is None
    assert snapshot.read_snapshot(spark, out, root="r", git_head="abc")["files"].count() == 7
    assert [r.path for r in snapshot.lookup(spark, out, "words", ["push"]).collect()] == [".github/ci.yml"]
    (tmp_path / "broken" / "meta").mkdir(parents=True)
    assert snapshot.read_snapshot(spark, str(tmp_path / "broken")) is None
    assert S.with_trigrams(files, largest=3).where("eligible").count() == 2


def test_projects_and_requests(spark, tmp_path):
    root = _tree(tmp_path / "proj", {"src/main.py": "import store\n\ndef main():\n    return store.get_item()\n", "src/store.py": "def get_item():\n    # nothing\n    return 1\n", "notes.md": "get_item here\n"})
    store = str(tmp_path / "store")
    cache = projects.Projects(spark, store, most=1)
    e = dispatch.Engine.of(cache.load(root))
    assert cache.load(root)["files"].count() == 3 and [p["snapshot"] for p in projects.list_projects(store)] == [True]
    ask = lambda tool, **a: dispatch.call(e, tool, a).collect()
    assert [r.text for r in ask("tree")] == ["notes.md  markdown  2L  0 sym", "src/", "  main.py  python  5L  2 sym", "  store.py  python  4L  1 sym"]
    assert [(r.name, r.line_start, r.line_end) for r in ask("outline", path="src/main.py")] == [("import store", 1, 1), ("main", 3, 4)]
    assert {r.path for r in ask("search", query="GET_item", indexed=True)} == {"src/main.py", "src/store.py", "notes.md"}
    assert [(r.path, r.scope_name) for r in ask("search", query="store.get", scope=True)] == [("src/main.py", "main")]
    assert [r.path for r in ask("deps", path="src/store.py")] == ["src/main.py"] or ask("deps", path="store.py")
    assert [r.text for r in ask("read", path="src/store.py", line_start=1, line_end=3, compact=True)] == ["    1 | def get_item():\n    3 |     return 1"]
    known = ask("read", path="notes.md")[0].hash
    assert [(r.state, r.text) for r in ask("read", path="notes.md", if_hash=known)] == [("unchanged", None)]
    assert [r.path for r in ask("word", word="Item")] == ["notes.md", "src/main.py", "src/store.py"]
    assert ask("find", query="main")[0].path == "src/main.py" and ask("status")[0].contents == 3
    assert {r.name for r in ask("bundle", calls=[{"tool": "status"}, {"tool": "word", "args": {"word": "here"}}])} == {"0:status", "1:word"}
    assert [r.path for r in ask("query", steps=[{"op": "search", "query": "get_item"}, {"op": "filter", "ext": ".py"}, {"op": "sort"}])] == ["src/main.py", "src/store.py"]
    assert ask("edit", path="notes.md", op="insert", start=1, content="new")[0].content == "get_item here\nnew\n"
    for tool, a in (("read", {"path": "../x"}), ("read", {"path": ".env"}), ("none", {}), ("outline", {}), ("bundle", {"calls": [{"tool": "edit"}]})):
        with pytest.raises(ValueError):
            dispatch.call(e, tool, a)
    assert projects.remote("o/r", "tree", lambda url: url, "https://h", q="a b") == "https://h/o/r/tree?q=a+b"
    with pytest.raises(ValueError):
        projects.remote("o/../r", "tree", str, "https://h")


def test_watching_and_logs(spark, tmp_path):
    root = _tree(tmp_path / "w", {"a.py": "1\n", "b.py": "2\n"})
    w = changes.Watcher(spark, root)
    (tmp_path / "w" / "b.py").unlink()
    _tree(tmp_path / "w", {"c.py": "3\n", "a.py": "1 + 1\n"})
    got, moved = w.poll()
    assert {(r.path, r.change) for r in got.collect()} == {("a.py", "modified"), ("b.py", "deleted"), ("c.py", "created")} and not moved
    assert w.poll()[0].isEmpty()
    changes.event_queue(got, str(tmp_path / "q"))
    stream = changes.events(spark, str(tmp_path / "q")).writeStream.format("memory").queryName("queue").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    stream.awaitTermination(60)
    assert spark.table("queue").count() == 3

    log = str(tmp_path / "wal")
    logs.log_queries(spark, log, [{"ts": 1, "tool": "search", "query": 'a"b\n'}, {"ts": 2, "tool": "read", "path": "a.py"}])
    rows = logs.read_events(spark, log).orderBy("ts").collect()
    assert [(r.ev, r.query, r.path) for r in rows] == [("query", "a'b ", None), ("access", None, "a.py")]
    sink = logs.telemetry_sink(str(tmp_path / "t"))
    for _ in range(2):  # a repeated batch replaces itself
        sink(spark.createDataFrame([(1, "tool_call", "search")], "timestamp_ms long, event_type string, tool string"), 0)
    assert logs.read_events(spark, str(tmp_path / "t"), logs.TELEMETRY_SCHEMA).count() == 1
    _tree(tmp_path / "n", {"1": "a.py\n\nb.py\n", "2": "a.py\n"})
    seen = []
    changes.file_changes(spark, str(tmp_path / "n"), lambda d: seen.extend(r.path for r in d.collect()), str(tmp_path / "cp2")).awaitTermination(60)
    assert sorted(seen) == ["a.py", "b.py"]
    assert sorted(logs.take_notices(spark, str(tmp_path / "n"))) == ["a.py", "b.py"] == sorted(set(seen)) and logs.take_notices(spark, str(tmp_path / "n")) == []


def test_json_document(spark):
    files = spark.createDataFrame([("b.py", "import os\n\ndef f():\n    pass\n"), ("a.md", "x")], "path string, content string")
    doc = json.loads(snapshot.json_document(snapshot.json_snapshot(files, symbols.symbols(files), outline.imports(files), 3)))
    assert doc["seq"] == 3 and doc["tree"] == ["a.md", "b.py"] and doc["dep_graph"] == {"b.py": ["os.py"]} and list(doc["symbol_index"]) == ["f"]


def plain_score(query, path):
    """The alignment score of one path, cell by cell."""
    q, t, f = query.encode(), path.encode(), np.float32
    low = lambda c: c + 32 if 65 <= c <= 90 else c
    name = t.rfind(b"/") + 1
    above, gap, matched = [f(0)] * (len(t) + 1), [f(-3)] * (len(t) + 1), 0
    for i, c in enumerate(q):
        row, side, hit = [f(0)], f(-3), False
        new_gap = [f(-3)]
        for j, d in enumerate(t):
            if low(c) == low(d):
                score = f(16) + f(8) * (j == 0 or t[j - 1] in b"/_-.\\") + f(6) * (j >= name) + f(6) * (j in (0, name)) + f(2) * (c == d)
                if i and j and above[j] > above[j + 1] * f(0.5):
                    score += f(4)
            else:
                score = f(-8)
            new_gap.append(max(above[j + 1] + f(-3), gap[j + 1] + f(-1)))
            side = max(row[j] + f(-3), side + f(-1))
            row.append(max(f(0), above[j] + score, new_gap[-1], side))
            hit |= row[-1] > 0
        matched, above, gap = (i + 1 if hit else matched), row, new_gap
    top = max(above)
    if top <= 0 or matched < (len(q) + 1) // 2 or top < f(len(q)) * f(16) * f(0.3):
        return None
    return float((top + top * f(0.05) if path.rsplit("/", 1)[-1] in fuzzy.ENTRY_POINTS else top) / np.sqrt(f(len(t))))


def test_fuzzy_scores_as_plain_alignment():
    rng = random.Random(2)
    paths = ["/".join("".join(rng.choice("abMain_-.") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 4))) for _ in range(150)] + ["src/main.zig", "a/main.rs"]
    for query in ("main", "aMi", "ab.n", "zzz", "_a-"):
        got = fuzzy.fuzzy_score(query, paths)
        want = [plain_score(query, p) for p in paths]
        assert [None if np.isnan(x) else round(float(x), 3) for x in got] == [None if x is None else round(x, 3) for x in want]


def test_combo_boost_without_sessions(spark):
    rows, want, last = [], {}, None
    rng = random.Random(3)
    for i in range(500):
        ev = rng.choice(["query", "access", "other"])
        rows.append((i, i * 1000, ev, rng.choice(["auth", "main", "au"]) if ev == "query" else None, f"p{rng.randrange(4)}"))
        if ev == "query":
            last = rows[-1]
        elif ev == "access" and last and rows[-1][1] - last[1] <= 5000 and ("auth" in last[3] or last[3] in "auth"):
            want[rows[-1][4]] = want.get(rows[-1][4], 0) + 5.0
    log = spark.createDataFrame(rows, "pos long, ts long, ev string, query string, path string").repartition(5)
    assert {r.path: r.boost for r in fuzzy.combo_boost(log, "auth").collect()} == want


def test_agents_and_lines_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r.pos == r.x + 1 for r in shared.numbered(df, ["x"]).collect())
    agents = spark.createDataFrame([], "id long, name string, state string, cursor long, last_seen long, edit_count long")
    agents = versions.register(agents, ["a", "b"], 10)
    assert [r.id for r in agents.orderBy("id").collect()] == [1, 2]
    stale = versions.reap_stale(versions.heartbeat(agents, [2], 50), F.lit(60), 30)
    assert {r.id: r.state for r in stale.collect()} == {1: "crashed", 2: "active"}
    locks = spark.createDataFrame([(1, "f", 99), (2, "g", 99)], "agent_id long, path string, expiry long")
    assert [r.path for r in versions.held_locks(locks, stale).collect()] == ["g"]
    e = spark.createDataFrame([("a", 0, "b"), ("c", 0, "a")], "path string, ord int, dep string")
    assert sorted((r.path, r.dep) for r in graph.set_deps(e, "a", ["x", "x"]).collect()) == [("a", "x"), ("a", "x"), ("c", "a")]
    assert graph.remove(e, "a").count() == 1 and graph.reverse_edges(e).count() == 2 and graph.sources(e).count() == 2


def test_outline_fixtures():
    kinds = lambda path, text: [(name, kind, a, b) for name, kind, a, b, _, _ in outline.outline(path, text)]
    assert kinds("a.py", 'def real():\n    """\n    def fake():\n    """\n\n    x = 1\n# note\n\ny = 2\n') == [("real", "function", 1, 6)]
    assert kinds("a.zig", "fn foo(\n    a: u8,\n) void {\n    // }\n    const s = \"{\";\n}\n")[0] == ("foo", "function", 1, 6)
    assert kinds("a.go", "/* func no() {\n*/ func yes() {\n}\n") == [("yes", "function", 2, 3)]
    assert kinds("a.rb", "module M\n  class A\n    def b\n      if x\n      end\n    end\n  end\nend\n") == [("M", "struct_def", 1, 8), ("A", "struct_def", 2, 7), ("b", "function", 3, 6)]
    assert [d for *_, d in outline.outline("a.php", "<?php\nuse A\\B\\C;\nuse A\\{D, E AS F, G};\n")] == [["a/B/C.php"], ["a/D.php", "a/E.php", "a/G.php"]]
    assert kinds("a.php", "<?php\n/* class X { */ \nclass A {\n  // function no()\n  private static function f() {\n    $s = '}';\n  }\n}\nfunction g() {}\n") == [("A", "class_def", 3, 8), ("f", "method", 5, 7), ("g", "function", 9, 9)]
    assert kinds("a.rs", "struct A;\n" + "\n" * 12 + "struct B {\n}\n") == [("A", "struct_def", 1, 1), ("B", "struct_def", 14, 15)]
    assert outline.outline("a.txt", "def x():") == []
