"""Extraction on small own sources: traps, and forms the rendered corpora lack."""

from pyspark.sql import functions as F

from conftest import rows
from strata.plans.extract import cfamily, golang, java, lexical, markup, python, sql, typescript
from strata.functions import text


def _ts(sources, code, path="/a.ts"):
    return typescript.decorate(typescript.tokens(sources((path, code)))).cache()


def test_blank_keeps_length_and_lines(sources):
    code = "a /* { \n */ 'x{y' \"\\\"}\" `t\n${q}` // if (\r\nb"
    out = sources(("/a.ts", code)).select(lexical.blank("text")).first()[0]
    assert len(out) == len(code) and out.count("\n") == code.count("\n")
    assert not any(ch in out for ch in "{}(")


def test_traps_in_strings_comments_and_line_ends(sources):
    d = _ts(sources, "// function no() {\r\nconst s = 'function no() {';\r\n/* class No { */\r\nfunction yes() {\r\n  return \"}\";\r\n}\r\nfunction Ünï() {}\n")
    n = typescript.nodes(d).where("kind in ('Function', 'Class')")
    assert rows(n, "name", "start_line", "end_line") == [("yes", 4, 6)]


def test_empty_file_and_names_that_differ_by_case(sources):
    assert typescript.nodes(_ts(sources, "")).count() == 0
    d = _ts(sources, "class Foo {}\nclass foo {}\n")
    assert {r[0] for r in rows(typescript.nodes(d), "entity_id")} == {"class:/a.ts:foo"}


def test_function_forms(sources):
    code = ("export default async function* gen(a, {b, c}, d = f(1, 2)) { yield 1; }\n"
            "const one = x => x + 1;\nlet two = function (y: Map<string, number>) { go(); };\n"
            "run(1, (e) => { stop(); });\nfunction over(a: string): void;\nfunction over(a) { return (() => 1)(); }\n")
    n = typescript.nodes(_ts(sources, code))
    f = n.where("kind = 'Function' and name <> 'anonymousLambda'")
    assert rows(f, "name", "start_line", "is_async", "is_generator", "is_default_export") == [
        ("callback_run_arg1", 4, False, False, False), ("gen", 1, True, True, True),
        ("one", 2, False, False, False), ("over", 6, False, False, False), ("two", 3, False, False, False)]
    assert [r[0] for r in rows(n.where("kind = 'Parameter' and parent_id like '%gen%'"), "name")] == ["a", "d", "{b, c}"]


def test_conditional_and_awaited_calls(sources):
    code = ("function f(x) {\n  a();\n  if (b()) c(); else d();\n  while (x) { e(); }\n  switch (x) { case 1: g(); }\n"
            "  const h = x ? i() : 0;\n  do { j(); } while (k());\n  xs.map(y => { l(y); });\n  await m();\n  n?.o();\n"
            "  if (x) xs.map(y => { p(y); });\n  return new Q(r());\n}\n")
    sites = {r["name"]: (r["is_conditional"], r["is_awaited"]) for r in typescript.call_sites(_ts(sources, code)).collect()}
    assert {k for k, v in sites.items() if v[0]} == {"b", "c", "d", "e", "g", "i", "j", "k", "p", "map"} - {"map"} | ({"map"} if sites["map"][0] else set())
    assert {k for k, v in sites.items() if v[1]} == {"m"}
    assert {"a", "l", "o", "r"} <= set(sites) and "Q" not in sites and not sites["l"][0]


def test_every_complexity_token(sources):
    code = ("function f(a) {\n if (a) {}\n for (const x of a) {}\n for (let i = 0; i < 1; i++) {}\n while (a) {}\n do {} while (a);\n"
            " switch (a) { case 1: case 2: default: }\n try {} catch {}\n return a ? 1 : a && a || a ?? a?.b;\n}\n")
    n = typescript.nodes(_ts(sources, code)).where("kind = 'Function'")
    assert n.first()["complexity"] == 1 + 5 + 2 + 1 + 4


def test_assignments_and_catches(sources):
    code = "function f(a = 1) { b = 2; c.d = 3; e[0] = 4; if (g == h || i <= j) {} k += 1; const l = 5; try {} catch (e: any) {} }\n"
    d = _ts(sources, code)
    assert [r[0] for r in rows(typescript.assignments(d), "target")] == ["b", "c.d", "e[0]"]
    assert typescript.handlers(d).first()["target_id"].endswith(":catch:e:1")


def test_attributes_are_no_assignments(sources):
    code = "const A = () => { x = 1; return <div className=\"a\" b={c}><B d='e' /></div>; };\n"
    d = _ts(sources, code, "/a.tsx")
    assert [r[0] for r in rows(typescript.assignments(d), "target")] == ["x"]


def test_markup_nesting(sources):
    code = "export const A = () => (\n  <ul>\n    {xs.map((x: Array<T>) => <li key={x}>Don't</li>)}\n    <img /><B><C/></B>\n  </ul>\n);\n"
    els = markup.elements(sources(("/a.tsx", code)))
    by_id = {r["entity_id"]: r["tag"] for r in els.collect()}
    got = {r["tag"]: by_id.get(r["parent_id"]) for r in els.collect()}
    assert got == {"ul": None, "li": "ul", "img": "ul", "B": "ul", "C": "B"}


def test_python_forms_and_errors(sources):
    code = "@d(1)\nclass K:\n    async def m(self, *a, k=1, **kw):\n        def inner(): return self.q()\n        x = y = 1\n        a.b = 2\nfrom .. import z\n"
    src = sources(("/a.py", code), ("/bad.py", "def f(:\n"), ("/empty.py", ""), ("/deep.py", "x = " + "(" * 60 + "1" + ")" * 60))
    d = python.decorate(src).cache()
    assert rows(python.nodes(d).where("kind <> 'PythonParameter'"), "kind", "name") == [
        ("PythonClass", "K"), ("PythonMethod", "inner"), ("PythonMethod", "m"), ("PythonModule", "."),
        ("PythonVariable", "x"), ("PythonVariable", "x"), ("PythonVariable", "y")]
    assert [r[0] for r in rows(python.parse_errors(python.parse(src)), "path")] == ["/bad.py"]


def test_java_go_cpp_corners(sources):
    src = sources(
        ("/A.java", "class A {\n  int[] xs = {1, 2}, ys;\n  @Deprecated(since = \"1\") protected static <T> T id(T t) { return t; }\n  Runnable r = () -> { go(); };\n  class In { In() {} void deep() {} }\n  void after() {}\n}\n"),
        ("/a.go", "package p\nimport \"os\"\nfunc (s Server) V() {}\nfunc f(g func(int) int) (int, error) { return g(1), nil }\n"),
        ("/a.c", "static int *f(int a)\n{\n  if (a) { g(a); }\n  return 0;\n}\nint proto(int);\nstruct s { int x; };\n"))
    j = rows(java.nodes(java.decorate(src)), "kind", "name", "parent_id")
    assert ("JavaMethod", "after", "javaclass:a") in j and ("JavaMethod", "deep", "javaclass:in") in j
    assert ("JavaField", "ys", "javaclass:a") in j and ("JavaMethod", "id", "javaclass:a") in j
    assert ("JavaMethod", "In", "javaclass:in") in j
    assert rows(golang.nodes(golang.decorate(src)), "kind", "name") == [
        ("GoFunction", "f"), ("GoMethod", "V"), ("ImportSpec", "os"), ("PackageClause", "p")]
    assert rows(cfamily.nodes(cfamily.decorate(src)), "kind", "name", "start_line", "end_line") == [("CFunction", "f", 1, 5)]


def test_sql_corners(sources):
    code = "CREATE VIEW v AS WITH c AS (SELECT 1) SELECT * FROM c JOIN s.t ON f(1);\nselect 1; select 2;\n\n  delete from t"
    d = sql.decorate(sources(("/a.sql", code)), "dbo").cache()
    assert rows(sql.nodes(d), "kind", "start_line", "start_col") == [
        ("SQLDeleteStatement", 4, 2), ("SQLSelectStatement", 2, 0), ("SQLSelectStatement", 2, 10), ("SQLView", 1, 0)]
    assert rows(sql.reference_rows(d), "form", "object") == [("function", "f"), ("relation", "s.t"), ("relation", "t")]
    assert d.where("kind = 'SQLView'").first()["entity_id"] == "sqlview:dbo.v"


def test_balance_report_finds_open_braces(sources):
    src = sources(("/a.ts", "function f() { '}' "), ("/b.ts", "{}"))
    assert rows(lexical.balance_report(src), "path", "open_braces") == [("/a.ts", 1)]


def test_attr_values(spark):
    d = spark.createDataFrame([('"a b"',), ("'c'",), ("{ x }",), ("{}",), ("",), ("bare",)], "c string")
    assert [r[0] for r in d.select(text.attr_value("c")).collect()] == ["a b", "c", "{x}", "{expression}", "true", "bare"]


def _deep(left, right, core, n=50):
    return left * n + core + right * n


def test_brackets_to_depth_fifty(sources):
    """What lies deep in brackets costs no declaration, parameter, column or element."""
    call = "".join("f(" for _ in range(50)) + "1" + ")" * 50
    types = "".join("Map<string, " for _ in range(50)) + "number" + ">" * 50
    d = _ts(sources, f"function deep(a = {call}, b = 2) {{\n}}\nfunction gen(x: {types}, y: number) {{\n}}\n")
    n = typescript.nodes(d)
    assert {r[0] for r in rows(n.where("kind = 'Function'"), "name")} == {"deep", "gen"}
    assert [r[0] for r in rows(n.where("kind = 'Parameter'"), "name")] == ["a", "b", "x", "y"]
    j = java.decorate(sources(("/A.java", f"class A {{\n  @Tag({_deep('(', ')', '1')})\n  {types.replace('string', 'String').replace('number', 'Integer')} f;\n"
                                          f"  void run(@B({_deep('(', ')', '2')}) int q) {{\n  }}\n}}\n")))
    assert {r[0] for r in rows(java.nodes(j), "name")} >= {"f", "run"}
    s = sql.decorate(sources(("/a.sql", f"create table t (id int, name varchar(9) default lower({_deep('(', ')', '3')}), amount decimal(3, 2));")))
    assert rows(sql.columns(s), "name") == [("amount",), ("id",), ("name",)]
    m = markup.elements(sources(("/a.tsx", f"const x = (\n  <Foo on={_deep('{', '}', 'a')} id=\"1\" />\n);\n")))
    assert rows(m, "tag") == [("Foo",)]


def test_nesting_goes_by_names():
    def tree(html, text):
        found = [("close" if t.startswith("/") else "single" if t in markup.VOID or t.endswith("/") else "open", t.strip("/")) for t in text.split()]
        parents, ends = markup.match(found, html)
        return ([(n, found[p][1] if p >= 0 else None) for (f, n), p in zip(found, parents) if f != "close"], ends)
    got, ends = tree(True, "html body p b br p /article footer /footer /body /html")
    assert got == [("html", None), ("body", "html"), ("p", "body"), ("b", "p"), ("br", "b"), ("p", "body"), ("footer", "body")]
    assert ends[2] == (5, False) and ends[3] == (5, False) and ends[5] == (7, False) and ends[7] == (8, True) and ends[0] == (10, True)
    assert tree(True, "ul li ul li /ul li /ul p")[0] == [("ul", None), ("li", "ul"), ("ul", "li"), ("li", "ul"), ("li", "ul"), ("p", None)]
    assert tree(True, "p table tr td p td /p tr th /table div")[0] == [
        ("p", None), ("table", None), ("tr", "table"), ("td", "tr"), ("p", "td"), ("td", "tr"), ("tr", "table"), ("th", "tr"), ("div", None)]
    assert tree(True, "div table td /div p /table em /div")[0] == [("div", None), ("table", "div"), ("td", "table"), ("p", "td"), ("em", "div")]
    assert tree(False, "A B p p C/ /B D /A /A E") [0] == [("A", None), ("B", "A"), ("p", "B"), ("p", "p"), ("C", "p"), ("D", "A"), ("E", None)]
    deep = [("open", "div")] * 50_000 + [("close", "p")] * 50_000 + [("close", "div")] * 50_000
    parents, ends = markup.match(deep, True)
    assert parents[49_999] == 49_998 and ends[0] == (149_999, True)


def test_script_bodies_are_no_markup(sources):
    page = "<html><head><script>var t = \"</p></html>\"; if (a<b) {}</script><title>a <b> c</title></head><body><p>x</p></body></html>"
    m = markup.elements(sources(("/a.html", page)).withColumn("language", F.lit("HTML")))
    parent = {r["entity_id"]: r["tag"] for r in m.collect()}
    assert {(r["tag"], parent.get(r["parent_id"])) for r in m.collect()} == {
        ("html", None), ("head", "html"), ("script", "head"), ("title", "head"), ("body", "html"), ("p", "body")}


def test_go_type_block(sources):
    code = "package p\n\ntype (\n\tA struct {\n\t\tx int\n\t\ty struct {\n\t\t\tz int\n\t\t}\n\t}\n\n\tB interface {\n\t\tRun()\n\t}\n)\n\ntype C struct {\n}\n"
    n = golang.nodes(golang.decorate(sources(("/a.go", code))))
    assert rows(n.where("kind in ('GoStruct', 'GoInterface')"), "kind", "name", "start_line", "end_line") == [
        ("GoInterface", "B", 11, 13), ("GoStruct", "A", 4, 9), ("GoStruct", "C", 16, 17)]


def test_tokens_are_not_shuffled_and_tasks_grow_with_the_texts(spark, sources):
    """Only whole texts move, so that what a task has to sort does not grow with the corpus."""
    from strata.plans.extract.lexical import by_file
    src = sources(*[(f"/a/{i}.go", "package p\n\nfunc F() {\n}\n" * 20) for i in range(40)])
    assert by_file(src, 2000).rdd.getNumPartitions() == 10 and by_file(src.limit(0)).rdd.getNumPartitions() == 1
    plan = golang.decorate(src)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.index("Generate ") < plan.index("Exchange ")


def test_markup_of_many_files_in_one_batch(spark, sources):
    """Files do not see one another, and none costs a call of its own."""
    src = sources(*[(f"/u/{i}.tsx", f"const A = () => <div id='{i}'><b>x</b>{'<i>' * (i % 2)}</div>;\n") for i in range(30)])
    els = markup.elements(src)
    assert "FlatMapGroupsInArrow" not in els._jdf.queryExecution().executedPlan().toString()
    got = els.groupBy("path").agg(F.count("tag").alias("n"), F.count("parent_id").alias("inside")).collect()
    assert sorted((r["n"], r["inside"]) for r in got) == [(2, 1)] * 15 + [(3, 2)] * 15
    assert all(p is None or f"{path}:div:".lower() in p for path, p in els.select("path", "parent_id").collect())
