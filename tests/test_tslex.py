"""The TypeScript lexer by itself: equal length, inert text, live code."""

from strata.plans.extract.tslex import DECLARATORS, code


def shown(text):
    out = code(text)
    assert len(out) == len(text) and [i for i, c in enumerate(text) if c == "\n"] == [i for i, c in enumerate(out) if c == "\n"]
    for name, mark in DECLARATORS.items():
        out = out.replace(mark, f"<{name}>")
    return out


def test_slashes():
    assert shown("a = b / c; d = e / 'f/'") == "a = b / c; d = e / 'f/'"
    assert "'" not in shown("return /don't/.test(x)") and shown("i++ / 2 / '('") == "i++ / 2 / '_'"
    assert shown("<A b={x} /><C d={y} />") == "<A b={x} /><C d={y} />" and shown("a => /`/") == 'a => "_"'
    assert shown("/a'/.test(b) // c'").startswith('"a_".test(b)') and shown("} /* ' */ / 2") == "}         / 2"


def test_templates():
    assert shown("`a ${f(`b ${g({x: 1})} c`)} d`; h()") == "`a_` f(`b_` g({x: 1})`_c`)`_d`; h()"
    assert shown("`open ${a(") == "`open_` a(" and shown("`never closed") == "`never_closed"


def test_declarators():
    assert shown("const a = 1, b = f(1, 2), c = [1, 2], d = {e: 1, g: 2};") == "const a = 1<const> b = f(1, 2)<const> c = [1, 2]<const> d = {e: 1, g: 2};"
    assert shown("let m: Map<string, X<a, b>> = new Map<string, X<a, b>>(), n") == "let m: Map<string, X<a, b>> = new Map<string, X<a, b>>()<let> n"
    assert shown("var x = a < b, y = c > d") == "var x = a < b<var> y = c > d"
    assert shown("export declare const u: string, v = 1\nf(w, z)") == "export declare const u: string<export const> v = 1\nf(w, z)"
    assert shown("let a = 1\nb, c\nlet d\n  , e") == "let a = 1\nb, c\nlet d\n  <let> e"
    assert shown("for (let i = 0, n = 3;;) { let j, k }") == "for (let i = 0, n = 3;;) { let j<let> k }"
    assert shown("const a = () => { const b = 1, c = 2; }, d = 3") == "const a = () => { const b = 1<const> c = 2; }<const> d = 3"
    assert shown("const a = 1,\n  // first\n  b = 2") == "const a = 1<const>\n          \n  b = 2"


def test_depth_and_length():
    deep = "`${" * 3000 + "f(1)" + "}`" * 3000
    assert "f(1)" in shown(deep)
    long = "const a = [" + "'x', /y/, " * 50_000 + "];"
    assert len(shown(long)) == len(long)
