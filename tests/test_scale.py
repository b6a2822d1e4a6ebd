"""Steps whose costs must not outgrow their input: who walks folders, and what is shuffled."""

from strata.checks import relations
from strata.plans.graph import Graph, profile
from strata.sources import files


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_walk_many_folders(tmp_path, monkeypatch):
    """from a level of many folders on, the driver lists nothing; rows are those of a plain walk."""
    for k in range(9):
        for name in ("_x/a.txt", ".h.txt", "deep/er/b.txt", "skipped/c.txt", "d.bin"):
            at = tmp_path / f"doc-{k}" / name
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(f"{k} {name}")
    (tmp_path / "top.txt").write_text("top")
    options = {"path": str(tmp_path), "extensions": '[".txt"]', "ignoreregex": "/skipped(/|$)"}

    def rows(parts):
        return sorted((r["path"], r["text"]) for p in parts for b in files.Folder(options).read(p) for r in b.to_pylist())
    want = rows(files.Folder(options).slices())
    assert len(want) == 28
    listed, plain = [], files.Folder.list
    monkeypatch.setattr(files, "SUBTREES", 4)
    monkeypatch.setattr(files, "FEWEST", 2)
    monkeypatch.setattr(files.Folder, "list", lambda self, folder, *mine: listed.append(folder) or plain(self, folder, *mine))
    parts = files.Folder(options).slices()
    assert listed == [str(tmp_path)] and len(parts) == 6
    assert rows(parts) == want


def test_call_edges_shuffle_keys(spark):
    """ids are put together after the joins."""
    plan = _plan(relations._call_edges(spark, "/root/testdata/sf0.001"))
    assert not [line for line in plan.splitlines() if "Exchange" in line and ("source_id" in line or "entity_id" in line and "CALLS" in line)]
    assert "concat(orders:" in plan.split("Exchange")[0]


def test_profile_joins_edges_once_a_side(spark):
    """both sides' kinds are looked up apart from each other, with the same shapes."""
    nodes = spark.createDataFrame([("a", "A", None), ("b", "B", "a"), ("c", "B", "a"), ("d", "D", None)], "entity_id string, kind string, parent_id string")
    edges = spark.createDataFrame([("e", "CALLS", "b", "a"), ("f", "CALLS", "c", "a"), ("g", "USES", "b", "gone"), ("h", "CALLS", None, "d")],
                                  "entity_id string, type string, source_id string, target_id string")
    found = profile(Graph(nodes, edges))
    assert "Union" in _plan(found)
    assert sorted(tuple(r) for r in found.collect() if r["kind"] != "A") == [
        ("B", "A", "CALLS>A", 1, "c"), ("B", "A", "CALLS>A;USES>Placeholder", 1, "b"), ("D", None, "CALLS<Placeholder", 1, "d")]


def _spread_again(df):
    """Shuffles that Spark adds by itself."""
    return [line for line in _plan(df).splitlines() if "Exchange" in line and "ENSURE_REQUIREMENTS" in line]


def test_lexed_tokens_stay(sources):
    """Behind the Python lexer no window per file shuffles tokens."""
    from strata.plans.extract import typescript
    texts = sources(*[(f"/a{k}.ts", "function f() { g(); }\n" * 30_000) for k in range(3)])
    assert _spread_again(typescript.decorate(typescript.tokens(texts))) == []


def test_statements_stay(sources):
    """nor does one shuffle statements; columns and lines are those of a text in one piece."""
    from strata.plans.extract import sql
    assert _spread_again(sql.statements(sources(*[(f"/a{k}.sql", "SELECT a FROM b;\n" * 40_000) for k in range(3)]))) == []
    found = sql.statements(sources(("/a.sql", "SELECT 1; SELECT 2;\n SELECT ';'"))).collect()
    assert sorted((r["seq"], r["code"], r["line"], r["col"]) for r in found) == [(0, "SELECT 1", 1, 0), (1, "SELECT 2", 1, 10), (2, "SELECT '_'", 2, 1)]


def test_sites_are_made_once(spark):
    """Counting the keys of a join does not make its rows again."""
    from strata.plans import resolve
    made = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 50)], "k string, i int").mapInArrow(pass_on, "k string, i int")
    right = spark.createDataFrame([("hot", "x"), ("other", "y")], "k string, v string")
    found = resolve._meet(left, right, "k", limit=10).collect()
    assert made.value == 51
    assert sorted((r["i"], r["v"]) for r in found) == [(i, "x") for i in range(50)] + [(50, None)]
