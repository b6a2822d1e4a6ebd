from collections import Counter, defaultdict
from math import log

from pyspark.sql import functions as F

from strata.llm.styletree import ALIKE, DAMPING, HIGH, LOW, PRIOR, main_texts, parse

PAGE = ('<!DOCTYPE html><html><head><title>t</title></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a>Home</a></ul></nav>'
        '<div class="cookie-notice">We use</div><article><header><h1>Head {i}</h1></header><p><b>One &amp; &lt;two&gt; {i}<br>three<p>Four  {i}'
        '<span class="ad">BUY</span> five<script>if (a<b) "</p>"</script><form><input>name</form><section id="comments"><article>hi</article></section>'
        '</article><div class="sidebar"><p>side</div><footer>foot')


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id bigint, url string, html string")


def text_of(page):
    own = [b for b in parse(page)[0] if not b[2]]
    return [b[1] for b in [b for b in own if b[3]] or own]


def test_article_and_edges(spark):
    rows = [(1, "http://a.org/1", PAGE.replace("{i}", "x")), (2, None, None), (None, "u", ""), (4, "http://b.org/", "plain &eacute; < text\n\n more"),
            (5, "http://b.org/2", "<p>a<p>b<div>c<br>d</div>e"), (5, "http://b.org/2", "<p>a<p>b<div>c<br>d</div>e"), (6, "x", "<nav>only"), (7, "x", "<p " * 2000)]
    got = main_texts(frame(spark, *rows).withColumn("text", F.lit("clash"))).collect()
    by = {(r["id"], r["url"]): r["text"] for r in got}
    assert len(got) == len(rows)
    assert by[1, "http://a.org/1"] == "Head x\n\nOne & <two> x three\n\nFour x five"
    assert by[2, None] == by[None, "u"] == by[6, "x"] == ""
    assert by[4, "http://b.org/"] == "plain é < text more" and by[5, "http://b.org/2"] == "a\n\nb\n\nc d\n\ne"
    assert main_texts(frame(spark)).count() == 0


def test_template_of_a_site(spark):
    """Without any mark in the tags, what most pages of a host share goes, branch by branch or text by text."""
    pages = [(i, f"http://s.org/{i}", f"<div class=x><div>About us</div><div>Imprint</div></div><div class=y><p>Story {i} tells of {i * 7}.<p>More of {i}."
                                      f"<p>Read our other stories!</div>") for i in range(20)]
    lone = [(99, "http://t.org/", "<div class=x><div>About us</div></div><div class=y><p>Story.</div>")]
    got = {r["id"]: r["text"] for r in main_texts(frame(spark, *pages, *lone)).collect()}
    assert all(got[i] == f"Story {i} tells of {i * 7}.\n\nMore of {i}." for i in range(20))
    assert got[99] == "About us\n\nStory."


def test_copies_of_an_article_stay(spark):
    pages = [(i, f"http://c.org/{i}", "<article><p>The same text on all pages.</article>") for i in range(12)]
    assert {r["text"] for r in main_texts(frame(spark, *pages)).collect()} == {"The same text on all pages."}


def test_parse():
    assert text_of("<ul><li>one<li>two <select><option>o</select>x</ul><table><tr><td>a<td>b</table>") == ["one", "two x", "a", "b"]
    assert text_of("<p>a</p></div></b>b<!-- <p>c --><style>p{}</style>") == ["a", "b"]
    assert text_of("<main><p>in</main><p>out") == ["in"]
    assert text_of("<div hidden>h</div><div style='display: none'>n</div><div role=navigation>r</div>ok &am") == ["ok &am"]


def test_words_of_an_articles_own_sections():
    """Inside an article a class or id alone drops no heading, paragraph or section; containers of links go."""
    page = ('<article><h2 id="copyright-law">Law</h2><p class="legal">A</p><section id="discussion"><h2>Talk</h2><p>B <a>c</a> and more.</section>'
            '<div class="side-by-side"><p>D</div><section class="related-work"><p>E</section><div class="related"><a>x</a><ul><li><a>y</a></ul></div>'
            '<div class="newsletter">n</div><p>F</article>')
    assert text_of(page) == ["Law", "A", "Talk", "B c and more.", "D", "E", "F"]


def test_inline_words_stay_in_their_sentence():
    page = ('<article><p>We saw <em class="notice">a sign</em> and <a class="related">a link</a> there.<span class="sponsored">BUY</span></p>'
            '<p><a class="share">Tweet</a> <a class="share">Mail</a></p><p>End</article>')
    assert text_of(page) == ["We saw a sign and a link there.", "End"]


def test_near_copies_of_an_article_stay(spark):
    """Twelve of a host's twenty pages are one article with another date; a line that all articles carry goes."""
    body = "".join(f"<p>Paragraph {k} of the story that is told again and again by this site.</p>" for k in range(5))
    pages = [(i, f"http://n.org/{i}", f"<article><h1>Date {i}</h1>{body if i < 12 else f'<p>Other story {i} with words of its own, {i * 7} of them.</p>'}"
                                      "<p class=more>Read on!</p></article>") for i in range(20)]
    got = {r["id"]: r for r in main_texts(frame(spark, *pages)).collect()}
    assert all(got[i]["text"].count("Paragraph") == 5 and f"Date {i}\n" in got[i]["text"] for i in range(12))
    assert all(f"Other story {i}" in got[i]["text"] for i in range(12, 20))
    assert all("Read on!" not in r["text"] and r["by_tree"] == 1 for r in got.values())


def test_host_after_the_first_mark(spark):
    pages = [(i, f"http://h{i}.org/x?u=http://other.org/x", f"<p>Our common line.<p>Story {i}") for i in range(10)]
    assert all("Our common line." in r["text"] for r in main_texts(frame(spark, *pages)).collect())


def tree_by_hand(pages):
    """Main texts of one host's pages, by plain loops."""
    parsed = [parse(p) for p in pages]
    own, copies, heads = [], set(), {}
    for blocks, _ in parsed:
        free = [b for b in blocks if not b[2]]
        own.append([b for b in free if b[3]] or free)
    for i, blocks in enumerate(own):
        texts = {b[1] for b in blocks}
        if texts:
            longest = max(texts, key=lambda t: (len(t), t))
            head = heads.setdefault(longest, i)
            if head != i and sum(len(t) for t in texts & {b[1] for b in own[head]}) >= ALIKE * sum(map(len, texts)):
                copies.add(i)
    d, m, marked, styles = Counter(), Counter(), Counter(), defaultdict(Counter)
    for i, (blocks, style) in enumerate(parsed):
        if i not in copies:
            seen = {b[:3] for b in blocks}
            d.update(b[:2] for b in seen)
            marked.update(b[:2] for b in seen if b[2])
            m.update({b[0] for b in blocks})
            for path, x in style.items():
                styles[path][x] += 1
    worth = {k: max(0, 1 - log(n) / log(m[k[0]] + PRIOR)) for k, n in d.items()}
    nodes = {}
    for path in m:
        keys = [k for k in d if k[0] == path]
        n = sum(d[k] for k in keys)
        nodes[path] = (sum(d[k] * worth[k] for k in keys) * (1 - sum(marked[k] for k in keys) / n), n)
    texts = {k for k in d if worth[k] < LOW and 2 * d[k] >= m[k[0]] + PRIOR}
    branches = set()
    for path in {"/".join(p.split("/")[:k]) for p in m for k in range(2, p.count("/") + 2)}:
        below = [nodes[p] for p in nodes if f"{p}/".startswith(f"{path}/")]
        content, most = sum(s for s, _ in below) / sum(n for _, n in below), max(s / n for s, n in below)
        counts = styles[path].values()
        total, weight = sum(counts), DAMPING ** max(1, len(counts))
        spread = -sum(c / total * log(c / total) for c in counts) / log(total) if total > 1 else 1
        if most <= HIGH and (1 - weight) * spread + weight * content < LOW:
            branches.add(path)
    out = []
    for blocks in own:
        left = [b for b in blocks if b[:2] not in texts and not any(f"{b[0]}/".startswith(f"{x}/") for x in branches)]
        out.append("\n\n".join(b[1] for b in left or blocks))
    return out


def test_tree_against_plain_loops(spark):
    """A site of marked and unmarked pages with near copies, a template inside articles, and boxes that are links on some pages only."""
    pages = []
    for i in range(40):
        box = f'<div class="related"><a>More {i % 3}</a>{" and a word" if i % 9 == 0 else ""}</div>'
        about = '<div class="about"><p>About the writer</p><div><p>Born in a town</p></div></div>'
        story = "<p>The same story, told by all of these pages once more.</p>" if i < 9 else f"<p>Story {i} tells of {i * 7} things.</p><p>More of {i}.</p>"
        inner = f"<h2>Head {i}</h2>{story}{about if i % 10 else ''}{box}<p>Stay with us!</p>"
        pages.append(f"<body><nav><a>Home</a></nav><div class=top><div>Imprint</div><div>Jobs</div></div>"
                     f"{'<article>' if i % 2 else '<div class=text>'}{inner}{'</article>' if i % 2 else '</div>'}<footer>Foot</footer>")
    rows = [(i, f"http://w.org/{i}", p) for i, p in enumerate(pages)]
    got = {r["id"]: r["text"] for r in main_texts(frame(spark, *rows).coalesce(1)).collect()}
    assert [got[i] for i in range(40)] == tree_by_hand(pages)
    assert all("Stay with us" not in t and "Imprint" not in t for t in got.values()) and sum("same story" in t for t in got.values()) == 9
