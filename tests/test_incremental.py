"""An updated graph equals that of a full analysis, and only dependants are resolved again."""

from conftest import rows
from strata.plans import incremental
from strata.plans.analyze import AnalyzeConfig, analyze
from strata.plans.incremental import IncrementalGraph

CORPUS = {
    "/a.ts": "import { b } from './b';\nimport d from './lib';\nexport function a() { b(); d(); lone(); }\n",
    "/b.ts": "export function b() { return 1; }\nexport class B {}\n",
    "/lib/index.ts": "export default function d() {}\n",
    "/c.ts": "import { B } from './b';\nexport class C extends B { run() { later(); } }\n",
    "/alone.ts": "export function lone() {}\nfunction own() { own(); }\n",
    "/u.tsx": "import { V } from './v';\nexport const U = () => { return <V className=\"p-1 x\" />; };\n",
    "/v.tsx": "export const V = () => { return <b className=\"p-1\">v</b>; };\n",
    "/p.cpp": "#include \"p.h\"\nclass P : public Base {\n};\n", "/p.h": "class Base {\n};\n",
    "/m.py": "def f():\n    return g()\n", "/q.sql": "CREATE VIEW v AS SELECT id FROM t;\n", "/t.sql": "CREATE TABLE t (id INT);\n",
}
CHANGED = {
    "/b.ts": "export function b2() {}\nexport class B {}\n", "/later.ts": "export function later() {}\n",
    "/lib.ts": "export default function d() {}\n", "/t.sql": "CREATE TABLE s (id INT);\n", "/m.py": "def g():\n    return 1\n"}
DELETED = ["/alone.ts", "/v.tsx", "/p.h"]
# Besides the changed files: who imports /b.ts, asked for lone and later, may now mean /lib.ts, used V, included /p.h, read t.
DEPENDANTS = ["/a.ts", "/c.ts", "/u.tsx", "/p.cpp", "/q.sql"]


def plain(graph):
    nodes = rows(graph.nodes, *[c for c in graph.nodes.columns if c not in ("seq", "properties")])
    edges = rows(graph.edges, "entity_id", "type", "source_id", "target_id", "weight", "properties")
    return nodes, edges


def test_updates_equal_full_runs(spark, sources, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "SEGMENTS", 1)
    state = IncrementalGraph(spark, str(tmp_path / "state"))
    untouched = {f"/x{i}.ts": f"export function x{i}() {{ x{i}(); }}\n" for i in range(5)}
    before = CORPUS | untouched
    state.update_sources(sources(*before.items()))
    assert (state.parsed, state.resolved) == (17, 17)
    after = sources(*((p, t) for p, t in (before | CHANGED).items() if p not in DELETED))
    got = plain(state.update_sources(after))
    assert got == plain(analyze(after, AnalyzeConfig()))
    assert (state.parsed, state.resolved) == (len(CHANGED), len(CHANGED) + len(DEPENDANTS))
    # Nothing changed: two segments are merged into one, and the graph stays.
    assert plain(state.update_sources(after)) == got
    assert (state.parsed, state.resolved, state.versions.version()) == (0, 0, 3)
    assert {r[0] for r in rows(state._table("live", 3, incremental.LIVE), "segment")} == {-3}


def test_a_directory_is_read_where_it_changed(spark, tmp_path):
    root = tmp_path / "code"
    root.mkdir()
    (root / "a.ts").write_text("import { b } from './b';\nexport function a() { b(); }\n")
    (root / "b.ts").write_text("export function b() {}\n")
    (root / "_c.ts").write_text("export function c() {}\n")
    state = IncrementalGraph(spark, str(tmp_path / "state"))
    state.update_directory(str(root))
    assert (state.parsed, state.resolved) == (3, 3)
    (root / "b.ts").write_text("export function b() { return 22; }\n")
    graph = state.update_directory(str(root))
    assert (state.parsed, state.resolved) == (1, 2)
    assert [t for t, in rows(graph.edges.where("type = 'CALLS'"), "target_id")] == [f"function:{str(root).lower()}/b.ts:b:1"]
    state.update_directory(str(root))
    assert (state.parsed, state.resolved) == (0, 0)
