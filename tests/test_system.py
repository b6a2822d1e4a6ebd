"""Scan, analysis, store and streams end to end on small folders."""

import re

import pyarrow.fs
import pytest
from pyspark.sql import Observation, functions as F

from conftest import rows
from strata.model import EDGE_SCHEMA, nodes_like
from strata.plans.analyze import AnalyzeConfig, analyze, analyze_directory
from strata.plans.graph import schema, unresolved
from strata.sources import facts, files, globs
from strata.sources.bindings import doc_files
from strata.sources.corpus import scan_corpus, scan_errors, scan_roots, spread
from strata.sources.store import GraphStore, check_graph, lookup
from strata.streaming import watch


@pytest.fixture
def corpus(tmp_path):
    files = {
        "src/a.ts": "import { b } from './b';\nexport function a() { b(); }\n", "src/b.ts": "export function b() {}\n",
        "src/B.TS": "export function big() {}\n", "src/b.spec.ts": "function no() {}\n", "node_modules/x/i.js": "function no() {}\n",
        "dist/o.js": "function no() {}\n", "py/m.py": "def f(): return 1\nf()\n", "read me+%.md": "no", "py/bad.py": "def (",
        "src/with space+plus.ts": "export function sp() {}\n"}
    for name, body in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    return tmp_path


def test_glob_regex():
    hit = lambda g, p: bool(re.search(globs.glob_regex(g), p))
    assert hit("**/node_modules/**", "/r/node_modules/x/y.js") and hit("**/node_modules/**", "/r/node_modules")
    assert not hit("**/node_modules/**", "/r/node_modules2/x") and not hit("**/*.log", "/r/.log") and hit("**/*.log", "/r/a.log")
    assert hit("**/*.test.ts", "/r/a.test.ts") and not hit("**/*.test.ts", "/r/a.test.tsx") and not hit(".DS_Store", "/r/.DS_Store")
    assert hit("src/**/a?.ts", "src/x/y/ab.ts") and hit("src/**/a?.ts", "src/ab.ts") and hit("**/*.{js,ts}", "/r/b.ts")
    assert hit("**/.git/**", "/r/.git/config") and not hit("**/bin/**", "/r/.cache/bin/x")
    assert globs.ignore_patterns(["a", "**/dist/**"]).count("**/dist/**") == 1


def test_scan_filters_and_observes(spark, corpus):
    seen = Observation("scan")
    df = scan_corpus(spark, str(corpus), observation=seen)
    assert [r[0].replace(str(corpus), "") for r in rows(df, "path")] == [
        "/py/bad.py", "/py/m.py", "/src/B.TS", "/src/a.ts", "/src/b.ts", "/src/with space+plus.ts"]
    assert seen.get["files"] == 6
    assert not any("node_modules" in p or p.endswith("dist") for p in scan_roots(spark, str(corpus), globs.ignore_patterns()))
    flat = scan_corpus(spark, str(corpus), prune=False)
    assert rows(flat, "path") == rows(df, "path") == rows(spread(df, 3), "path")
    assert scan_corpus(spark, str(corpus), exts=["py"]).count() == 2


def test_scan_is_the_same_with_and_without_pruning(spark, tmp_path):
    for name in ("Foo.Java", "a.py", "_priv/x.py", "pkg/B.tSx", "pkg/deep/c.PY", "dist/no.py", "pkg/dist/no.py", "note.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    want = ["Foo.Java", "_priv/x.py", "a.py", "pkg/B.tSx", "pkg/deep/c.PY"]
    for prune in (True, False):
        assert [r[0].replace(f"{tmp_path}/", "") for r in rows(scan_corpus(spark, str(tmp_path), prune=prune), "path")] == want
    empty = scan_corpus(spark, str(tmp_path / "pkg" / "deep"), exts=["go"])
    assert empty.count() == 0 and "text" in empty.columns
    assert scan_roots(spark, str(tmp_path), ()).count(str(tmp_path)) == 0


def test_unreadable_files_are_skipped(spark, corpus):
    df = scan_corpus(spark, str(corpus))
    (corpus / "src/b.ts").unlink()
    assert df.count() == 5


def test_names_that_spark_hides_are_scanned_and_watched(spark, tmp_path):
    root = tmp_path / "root"
    for name in ("pkg/__init__.py", "_x/a.py", ".y/b.py", "web.d.ts/_app.tsx", ".py", "__pycache__/c.py", "big/a.py", "big/b.py", "note.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name * 3)
    (root / "link.py").symlink_to(root / "big/a.py")
    want = [".y/b.py", "_x/a.py", "big/a.py", "big/b.py", "pkg/__init__.py", "web.d.ts/_app.tsx"]
    got = rows(scan_corpus(spark, str(root)), "path", "text", "size")
    assert [(p.replace(f"{root}/", ""), t, n) for p, t, n in got] == [(w, w * 3, len(w) * 3) for w in want]
    names = scan_corpus(spark, f"file://{root}", texts=False)
    assert [r[0].replace(f"{root}/", "") for r in rows(names, "path")] == want and names.where("text is not null").count() == 0
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")

    def run(**how):
        q = (watch.watch_files(spark, str(root), **how).select("path").writeStream.format("parquet").option("path", out + str(how))
             .option("checkpointLocation", offsets + str(how)).trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.parquet(out + str(how)).count()
    assert run() == run(rewrites=True) == 6
    (root / "_x/a.py").write_text("again")
    (root / "_x/_z.py").write_text("new")
    assert run() == 7 and run(rewrites=True) == 8


def test_slices_of_a_folder_cover_it_once(tmp_path, monkeypatch):
    for i in range(50):
        (tmp_path / f"{i}.py").write_text("x" * i)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/s.py").write_text("s")
    monkeypatch.setattr(files, "SLICE_FILES", 8)
    monkeypatch.setattr(files, "BATCH_BYTES", 100)
    folder = files.Folder({"path": str(tmp_path), "extensions": '[".py"]'})
    parts = folder.slices()
    assert len(parts) == 8 and {p.n for p in parts} == {1, 7}
    batches = [b for p in parts for b in folder.read(p)]
    assert sorted(x for b in batches for x in b.column("size").to_pylist()) == sorted([*range(50), 1]) and len(batches) > len(parts)


def test_tasks_that_share_a_folder_look_at_each_file_once(tmp_path, monkeypatch):
    for i in range(60):
        (tmp_path / f"{i}.py").write_text("x")
    monkeypatch.setattr(files, "SLICE_FILES", 10)
    folder = files.Folder({"path": str(tmp_path), "extensions": '[".py"]'})
    parts, looked = folder.slices(), []
    real = pyarrow.fs.FileInfo
    monkeypatch.setattr(files.pyarrow.fs, "FileInfo", lambda path, *a, **k: looked.append(path) or real(path, *a, **k))
    assert len(parts) == 6 and sum(b.num_rows for p in parts for b in folder.read(p)) == 60
    assert len(looked) == 60


def test_document_files_hold_every_row(spark, tmp_path):
    """Keys and texts may repeat or be null."""
    given = [("a", "x"), ("a", "x"), ("a", None), (None, "y"), ("", "z\n"), ("b c/d", "é")]
    spark.createDataFrame(given, "source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    doc_files(spark, str(tmp_path), str(tmp_path / "out"), "source")
    found = rows(scan_corpus(spark, str(tmp_path / "out"), exts=["txt"]), "text", "path")
    assert sorted(t for t, _ in found) == sorted((t or "") + "\n" for _, t in given)
    assert sum("/source=a/" in p for _, p in found) == 3 and sum("/source=__HIVE_DEFAULT_PARTITION__/" in p for _, p in found) == 2


def test_what_cannot_be_read_is_a_row(spark, tmp_path, monkeypatch):
    lost = rows(scan_errors(spark, str(tmp_path / "none")), "path", "error")
    assert len(lost) == 1 and lost[0][0] == str(tmp_path / "none") and "FileNotFound" in lost[0][1]
    with pytest.raises(Exception, match="cannot read"):
        scan_corpus(spark, str(tmp_path / "none"), on_error="fail").collect()
    seen = Observation("errors")
    assert scan_corpus(spark, str(tmp_path / "none"), observation=seen).count() == 0 and seen.get["errors"] == 1
    (tmp_path / "a.py").write_text("a")
    (tmp_path / "b.py").write_text("b")
    folder = files.Folder({"path": str(tmp_path), "extensions": '[".py"]'})

    class Broken:
        def open_input_stream(self, path):
            if path.endswith("a.py"):
                raise PermissionError("no")
            return real.open_input_stream(path)
    part, real = folder.slices()[0], folder.fs
    monkeypatch.setattr(folder, "list", lambda f, listed=folder.list(str(tmp_path)): listed)
    folder.fs = Broken()
    batch, = folder.read(part)
    assert batch.column("text").to_pylist() == [None, "b"] and batch.column("error").to_pylist() == ["PermissionError: no", None]


def test_analysis_is_closed_unique_and_repeatable(spark, corpus, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graph"))
    assert store.version() == 0 and store.read()[0].count() == 0
    cfg = AnalyzeConfig(exts if (exts := globs.dotted(["ts", "py"])) else [], created_at="2024-01-01 00:00:00")
    v = analyze_directory(spark, str(corpus), store, cfg)
    nodes, edges = store.read()
    first = rows(nodes, "entity_id", "kind", "name"), rows(edges, "entity_id", "type", "weight")
    ids = {r[0] for r in first[0]}
    assert all(s in ids and t in ids for s, t in rows(edges, "source_id", "target_id"))
    assert check_graph(nodes, edges).count() == 0
    calls = edges.where("type = 'CALLS'").first()
    assert calls["target_id"].endswith("src/b.ts:b:1") and calls["weight"] == 6
    # The same run again changes nothing.
    assert analyze_directory(spark, str(corpus), store, cfg) == v + 1
    again = store.read()
    assert (rows(again[0], "entity_id", "kind", "name"), rows(again[1], "entity_id", "type", "weight")) == first
    plan = lookup(again[0], "Function", name="b")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "EqualTo(name,b)" in plan
    assert store.reset() == v + 2 and store.read()[0].count() == 0 and store.read(v)[0].count() == len(first[0])


def test_an_unfinished_write_is_not_seen(spark, tmp_path, sources):
    store = GraphStore(spark, str(tmp_path / "g"))
    n = spark.createDataFrame([("a", "k")], "entity_id string, kind string")
    e = spark.createDataFrame([("e", "T", "a", "a")], "entity_id string, type string, source_id string, target_id string")
    store.write(n, e)
    n.write.parquet(str(tmp_path / "g/v2/nodes/kind=x"))
    assert store.version() == 1 and store.read()[0].count() == 1


def test_layout_does_not_change_the_graph(spark, sources):
    src = sources(("/a.ts", "import d, { f as g } from './b';\nfunction h() { g(); d(); k(); }\n"),
                  ("/b.ts", "export function f() {}\nexport default class D {}\n"), ("/c.ts", "export function k() {}\n"))
    a, b = analyze(src), analyze(src.repartition(3, "path").orderBy(F.desc("path")))
    assert rows(a.edges, "entity_id", "type", "weight") == rows(b.edges, "entity_id", "type", "weight")
    assert {r[0] for r in rows(a.edges.where("type = 'CALLS'"), "target_id")} == {
        "function:/b.ts:f:1", "class:/b.ts:d", "function:/c.ts:k:1"}
    assert unresolved(a).count() == 0 and schema(a).where("type = 'CALLS'").count() == 2
    only = analyze(src, AnalyzeConfig(targets=src.where("path = '/c.ts'").select("path")))
    assert only.nodes.where("kind = 'File'").count() == 1


def test_fact_files_round_trip(spark, tmp_path):
    good = '{"filePath": "/a", "nodes": [{"entityId": "x", "kind": "K", "properties": {"a": "1"}}], "relationships": []}'
    for i, t in enumerate([good, '{"filePath": "/b", "nodes": []}', "{broken"]):
        (tmp_path / f"{i}.json").write_text(t)
    nodes, edges = facts.read_facts(spark, str(tmp_path))
    assert rows(nodes, "entity_id", "file_path") == [("x", "/a")] and edges.count() == 0


def test_streams_pick_up_new_files_and_the_log_finds_the_rest(spark, corpus, tmp_path):
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    def run():
        q = (watch.watch_files(spark, str(corpus)).select("path").writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", offsets).trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.parquet(out).count()
    log = str(tmp_path / "log")
    assert run() == 6 and watch.append_changes(spark, scan_corpus(spark, str(corpus)), log) == 1
    (corpus / "src/c.ts").write_text("let c = 1;\n")
    (corpus / "src/a.ts").write_text("let a = 2;\n")
    (corpus / "py/bad.py").unlink()
    assert run() == 7 and watch.append_changes(spark, scan_corpus(spark, str(corpus)), log) == 2
    got = spark.read.option("recursiveFileLookup", True).parquet(f"{log}/log").where("version = 2")
    assert [(p.split("/")[-1], o) for p, o in rows(got, "path", "operation")] == [("bad.py", "deleted"), ("a.ts", "changed"), ("c.ts", "added")]


def test_two_writers_never_share_a_version(spark, tmp_path):
    a, b = (GraphStore(spark, str(tmp_path / "g")) for _ in range(2))
    assert [a._claim(), b._claim(), a._claim()] == [1, 2, 3] and a.version() == 0
    assert a.reset() == 4 and b.version() == 4 and b.read()[0].count() == 0


def test_registered_language_with_its_resolver(spark, sources):
    from strata.functions import ids
    from strata.model import edges_like, nodes_like
    from strata.plans import registry
    from strata.plans.analyze import analyze

    toy = registry.Extractor(
        ("Toy",), lambda s: s.select("path", "language", F.explode(F.split("text", "\n")).alias("name")),
        lambda d: nodes_like(d.select(ids.entity_id("toy", "name").alias("entity_id"), F.lit("Toy").alias("kind"), "name",
                                      F.col("path").alias("file_path"), "language", F.lit(0).alias("seq"))),
        lambda d: edges_like(d.limit(0).select(F.lit("x").alias("entity_id"), F.lit("T").alias("type"), F.lit("a").alias("source_id"),
                                               F.lit("b").alias("target_id"), F.lit(0).alias("seq"))))

    def resolver(facts, nodes):
        rows = facts.constructs("toy").select(ids.edge_id(F.lit("NAMES"), F.lit("toy:a"), F.lit("toy:b")).alias("entity_id"), F.lit("NAMES").alias("type"),
                                              F.lit("toy:a").alias("source_id"), F.lit("toy:b").alias("target_id"), F.lit(0).alias("seq"))
        return [rows.limit(1)]
    try:
        registry.register("toy", toy, resolver, {".toy": "Toy"})
        g = analyze(sources(("/x.toy", "a\nb")))
        assert g.nodes.where("kind = 'Toy'").count() == 2 and g.edges.where("type = 'NAMES'").count() == 1
    finally:
        registry.EXTRACTORS.pop("toy"), registry.RESOLVERS.pop("toy"), ids.LANGUAGE_BY_EXTENSION.pop(".toy"), ids.EXTENSIONS.remove(".toy")


def test_upserts_of_two_writers_both_survive(spark, tmp_path):
    def node(i):
        return spark.sql(f"SELECT 'n{i}' AS entity_id, 'File' AS kind, 'f{i}' AS name, 0L AS seq")

    class Slow(GraphStore):
        """Another writer commits while this one's first version is being written."""
        meanwhile = True

        def _claim(self):
            v = super()._claim()
            if self.meanwhile:
                self.meanwhile = False
                GraphStore(spark, self.path).upsert(nodes_like(node(2)), none)
            return v

    path = str(tmp_path / "g")
    none = spark.createDataFrame([], EDGE_SCHEMA)
    GraphStore(spark, path).upsert(nodes_like(node(0)), none)
    v = Slow(spark, path).upsert(nodes_like(node(1)), none)
    store = GraphStore(spark, path)
    assert store.version() == v and rows(store.read()[0], "entity_id") == [("n0",), ("n1",), ("n2",)]


def test_updates_drop_state_behind_the_watermark(spark, tmp_path):
    batches = [[("a", "2024-01-01 00:00:00", 1, "x"), ("b", "2024-01-01 01:00:00", 2, "y"), ("a", "2024-01-01 02:00:00", 3, "z"), (None, None, 4, "no time")],
               [("a", "2024-02-01 00:00:00", 5, "v")],
               [("b", "2024-01-01 03:00:00", 6, "too late"), ("a", "2024-02-01 00:00:00", 7, "tie goes to the larger id"), (None, "2024-02-01 00:00:00", 8, None)]]
    for i, b in enumerate(batches):
        df = spark.createDataFrame(b, "k string, at string, id long, v string").withColumn("at", F.col("at").cast("timestamp"))
        df.coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    q = None
    for i in range(len(batches)):
        # The folder grows between runs of the same query.
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"in{i}").glob("part-*.parquet"):
            (tmp_path / "in" / f"{i}-{f.name}").write_bytes(f.read_bytes())
        stream = spark.readStream.schema("k string, at timestamp, id long, v string").parquet(str(tmp_path / "in"))
        q = watch.append_stream(watch.latest_updates(stream, "k", "at", ["id"], "v", watermark="1 day", width="1 day"), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {tuple(r) for r in watch.latest(out, "k", ["at", "id"], "id", "v").collect()} == {("a", 7, "tie goes to the larger id"), ("b", 2, "y"), (None, 8, None)}
    # January's rows have left the state; what remains is February's.
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 2


def test_analysis_broadcasts_no_facts(spark, sources):
    """Files tell Spark little of the room that ids and paths take, so tables of facts are merged, however small they look."""
    from strata.plans.extract import python
    from strata.session import written
    src = written(sources(("/a.py", "def f(x):\n    return g(x)\n\n\ndef g(x):\n    return x\n"), ("/b.ts", "export function h() { return 1; }\n")))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(python.decorate(src.where("language = 'Python'")))
    g = analyze(src)
    assert "BroadcastHashJoin" not in plan(g.nodes)
    assert {r["name"] for r in g.nodes.where("kind in ('PythonFunction', 'Function')").collect()} == {"f", "g", "h"}
