"""Main text of web pages by a site style tree.

A page's elements are merged with those of all pages of the same host: elements with equal paths (tags
with their classes and ids from the root) become one node. A node knows on how many pages it occurs,
in which styles (orders of child elements), and with which contents. All blocks enter the tree, those that
their markup excludes as well.

* Content importance of a text at a node that ``m`` pages have, found on ``d`` of them:
  1 - log d / log (m + PRIOR), one minus its entropy over the pages, as if ``PRIOR`` more pages had been seen
  without it: on a small site a repeated text proves little, and the proof grows with the site without a step.
  It is multiplied by the share of pages on which markup does not exclude the node.
* Style importance of a node: the entropy of its styles over its pages, to the base ``m``.
* A branch weighs both: (1 - g^l) * style + g^l * mean content importance below it, with ``l`` styles and
  g = 0.9. Branches under ``LOW`` are template, unless a node below is important in itself (over ``HIGH``), and so
  are texts under ``LOW`` that the majority of a node's pages (and of the ``PRIOR``) share.

Near copies of an article are no template: pages of a host whose longest text is the same and of whose
text at least ``ALIKE`` is also on the first page of that group count as one page. So each article counts once.

Elements whose markup says that they are not text of the article (menus, forms, adverts, comments and so
on) have no importance on the page itself, since many hosts have too few pages to compare.
Inside an article, headings and paragraphs never count so by their class or id, and containers whose words an
article's own sections use too (``related``, ``discussion``) only if half of their text or more is in links;
inline elements with such words go only if nothing else is in their block.
If a page marks its article (``article`` or ``main``), the text is taken from there, less the tree's texts and
branches. A page that would lose everything keeps what its own markup leaves.

Blocks are the texts between the borders of block elements; ``br`` is white space. Character references
are decoded. The tree is built by aggregations on (host, path); a host's template, which is as long as a page,
then joins its pages: by a broadcast while all templates together are small, else by host, where Spark
splits the pages of a host that has very many.

Edge cases: null and empty pages give empty text; null urls and such without a host share one host;
unclosed and stray tags are closed or skipped; a page cut off anywhere is read to its end; rows equal in
id, url and html are one page and get one result; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from strata.llm.common import ascii_lower, map_arrow, stored
from strata.session import written

LOW = 0.2
HIGH = 0.5
DAMPING = 0.9
PRIOR = 5
ALIKE = 0.8
BROADCAST_ITEMS = 200_000  # texts (hashes) and paths of all templates

# Names of elements, and words that class, id and role use for what is not article text.
BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol
    p pre section summary table tbody td tfoot th thead title tr ul""".split())
EMPTY_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
NOISE_TAGS = frozenset("""aside button canvas dialog footer form head iframe input label legend map menu nav noembed
    noframes noscript object optgroup option script select style svg template textarea title""".split())
NOISE_WORDS = frozenset("""ad ads advert adverts advertisement advertisements advertising adbox adsense sponsor sponsored
    sponsors promo promos promotion banner cookie cookies consent gdpr notice notices notification alert popup modal
    overlay newsletter subscribe subscription signup login menu menus nav navbar navigation navi breadcrumb breadcrumbs
    sidebar sidebars side rail widget widgets related recommended recommendations share sharing social comment comments
    commentlist reply replies respond responses disqus discussion footer masthead topbar toolbar pagination pager skip
    search searchbox copyright legal disclaimer outbrain taboola""".split())
# Of the next list, words that an inline element in an article is an advert by.
ADVERT_WORDS = frozenset("ad ads promotion sponsor sponsored sponsors".split())
# Words that an article's own sections use as well: inside an article they count for containers of links only.
AMBIGUOUS_WORDS = frozenset("""ad ads alert banner comment copyright cookie cookies discussion disclaimer legal notice notices notification popup
    promotion rail recommendations recommended related replies reply respond responses search share sharing side skip
    social sponsor sponsored sponsors subscription""".split())
HEADINGS_AND_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
NOT_BEFORE = frozenset("has with no without".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "tbody": {"tr", "td", "th", "thead", "tbody"}}
HOLDERS = frozenset("ul ol menu dl table tbody thead tfoot select div section article main body aside nav td th blockquote".split())

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v[1:-1] if v[:1] in "\"'" and len(v) > 1 else v) for k, v in _ATTRIBUTE.findall(text)} if text.strip(" /") else {}


def _is_noise(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in ("html", "body", "article", "main") and not attributes:
        return False
    if tag in NOISE_TAGS or tag == "header" and not in_article:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return tag not in ("html", "body")
    if tag in ("html", "body", "main"):
        return False
    if attributes.get("role", "").lower() in NOISE_ROLES:
        return True
    parts = [p.lower() for p in _PARTS.findall(f"{attributes.get('class', '')} . {attributes.get('id', '')}")]
    noisy = [p for before, p in zip(["", *parts], parts) if p in NOISE_WORDS and before not in NOT_BEFORE]
    if in_article and tag in BLOCK_TAGS:
        return tag not in HEADINGS_AND_TEXT and any(p not in AMBIGUOUS_WORDS for p in noisy)
    if in_article:
        return any(p not in AMBIGUOUS_WORDS or p in ADVERT_WORDS for p in noisy)
    return bool(noisy) or tag == "div" and not in_article and "header" in parts


def _is_doubtful(tag: str, attributes: dict[str, str]) -> bool:
    """An element inside an article whose words say noise or a section of the article: what is in it, and around it, decides."""
    parts = [p.lower() for p in _PARTS.findall(f"{attributes.get('class', '')} . {attributes.get('id', '')}")]
    return tag not in HEADINGS_AND_TEXT and any(p in AMBIGUOUS_WORDS and before not in NOT_BEFORE for before, p in zip(["", *parts], parts))


def parse(page: str) -> tuple[list[tuple], dict[str, int]]:
    """Blocks of a page as (path, text, noise, in_article) in order, and of each path with children a hash of its
    children's tags in order."""
    blocks: list[tuple] = []
    children: dict[str, list[str]] = defaultdict(list)
    # Open elements: tag, path, noise, inside an article.
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]
    text: list[str] = []
    doubts: list[list] = []  # of each doubtful container: depth while open, first and last block, characters, those in links
    open_doubts: list[int] = []
    linked = 0  # open links
    muted = 0  # open inline elements of no importance: their text is left out of the block around them
    hushed: list[int] = []  # depths of open doubtful inline elements
    outside = False  # the block has text outside of those

    def flush() -> None:
        nonlocal outside
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if words:
                blocks.append((stack[-1][1], words, not outside or any(s[2] and s[0] in BLOCK_TAGS for s in stack), any(s[3] for s in stack)))
        outside = False

    def close(depth: int) -> None:
        nonlocal muted, linked
        if any(s[0] in BLOCK_TAGS for s in stack[depth:]):
            flush()
        linked -= sum(s[0] == "a" for s in stack[depth:])
        while open_doubts and doubts[open_doubts[-1]][0] >= depth:
            doubts[open_doubts.pop()][2] = len(blocks)
        muted -= sum(s[2] and s[0] not in BLOCK_TAGS for s in stack[depth:])
        while hushed and hushed[-1] >= depth:
            hushed.pop()
        del stack[depth:]

    def add(piece: str) -> None:
        nonlocal outside
        if not muted:
            text.append(piece)
            size = len("".join(piece.split()))
            outside = outside or size > 0 and not hushed
            for d in open_doubts:
                doubts[d][3] += size
                doubts[d][4] += size if linked else 0

    at, n = 0, len(page)
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            add(page[at:])
            break
        m = _TAG.match(page, tag)
        if not m:  # a sign, not a tag
            add(page[at:tag + 1])
            at = tag + 1
            continue
        if tag > at:
            add(page[at:tag])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            found = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if found:
                close(found)
            elif name in BLOCK_TAGS:
                flush()
            continue
        if name in EMPTY_TAGS:
            text.append(" ")
            if name == "hr":
                flush()
            continue
        if name in RAW_TAGS:
            end = re.compile(rf"</{re.escape(name)}\s*/?>", re.I).search(page, at)
            at = end.end() if end else n
            text.append(" ")
            continue
        if name in BLOCK_TAGS:
            # An open paragraph ends, and so do items of the same list that are still open.
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p" or stack[k][0] in CLOSED_BY.get(name, ()):
                    close(k)
                elif stack[k][0] in HOLDERS:
                    break
            flush()
        attributes = _attributes(m[3])
        in_article = any(s[3] for s in stack)
        noise = _is_noise(name, attributes, in_article)
        path = stack[-1][1]
        if name in BLOCK_TAGS:
            mark = "".join(f".{c}" for c in sorted(attributes.get("class", "").split())) + (f"#{attributes['id']}" if attributes.get("id") else "")
            children[path].append(name)
            path = f"{path}/{name}{mark.replace('/', '_')}"
        if not m[3].rstrip().endswith("/") or name in BLOCK_TAGS:
            if noise and name not in BLOCK_TAGS:
                text.append(" ")
                muted += 1
            if in_article and not noise and name not in BLOCK_TAGS and _is_doubtful(name, attributes):
                hushed.append(len(stack))
            elif in_article and not noise and _is_doubtful(name, attributes):
                open_doubts.append(len(doubts))
                doubts.append([len(stack), len(blocks), None, 0, 0])
            linked += name == "a"
            stack.append((name, path, noise, name in ("article", "main") and not noise))
    flush()
    for _, first, last, chars, in_links in doubts:
        if 2 * in_links >= chars:
            blocks[first:last] = [(path, words, True, inside) for path, words, _, inside in blocks[first:last]]
    return blocks, {p: xxhash.xxh64_intdigest(" ".join(c)) >> 1 for p, c in children.items()}


def page_nodes(pages: DataFrame, id: str, url: str, source: str) -> DataFrame:
    """One row per page, with its blocks side by side in arrays, and its longest text; written once."""
    kind = pages.schema[id].dataType.simpleString()
    after = F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1)
    host = F.coalesce(ascii_lower(F.regexp_extract(after, r"^[^/?#]*", 0)), F.lit(""))
    picked = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.monotonically_increasing_id().alias("key"), host.alias("host"),
                          F.coalesce(F.col(source), F.lit("")).alias("source"))
    names = ("paths", "texts", "noise", "article", "hashes", "nodes", "styles", "own", "sizes", "longest")

    def run(batch: pa.RecordBatch):
        out = {n: [] for n in names}
        for page in batch.column("source").to_pylist():
            blocks, styles = parse(page)
            hashes = [xxhash.xxh64_intdigest(b[1]) >> 1 for b in blocks]
            own = {h: len(b[1]) for h, b in zip(hashes, blocks) if not b[2] and b[3]} or {h: len(b[1]) for h, b in zip(hashes, blocks) if not b[2]}
            longest = max(own, key=lambda h: (own[h], h), default=None)
            for n, x in zip(names, (*([b[k] for b in blocks] for k in range(4)), hashes, list(styles), list(styles.values()),
                                    list(own), list(own.values()), longest)):
                out[n].append(x)
        yield {n: batch.column(n) for n in ("id", "url", "key", "host")} | out
    schema = (f"id {kind}, url string, key bigint, host string, paths array<string>, texts array<string>, noise array<boolean>, "
              "article array<boolean>, hashes array<bigint>, nodes array<string>, styles array<bigint>, own array<bigint>, sizes array<bigint>, longest bigint")
    return stored(map_arrow(picked, run, schema), "pages")


def copies(nodes: DataFrame) -> DataFrame:
    """(key) of pages that are near copies of another page of their host, the first of each group excepted."""
    pages = nodes.where("longest is not null")
    first = (pages.groupBy("host", "longest").agg(F.min_by(F.struct("key", "own"), "key").alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("host", "longest", F.col("first.key").alias("head"), F.col("first.own").alias("theirs")))
    both = pages.select("host", "longest", "key", "own", "sizes").join(first, ["host", "longest"]).where("key <> head")
    total = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    shared = F.aggregate(F.filter(F.arrays_zip("own", "sizes"), lambda b: F.array_contains(F.col("theirs"), b["own"])), F.lit(0).cast("bigint"), lambda a, b: a + b["sizes"])
    return both.where(shared >= ALIKE * total).select("key")


def template(nodes: DataFrame) -> DataFrame:
    """(host, low_texts, low_branches): texts at their paths, and branches, of low importance that markup does
    not exclude everywhere. A text listed is on half of the pages that have its path, so a host's list is no longer than a few pages."""
    leaf = (nodes.select("host", F.explode(F.array_distinct(F.arrays_zip("paths", "hashes", "noise"))).alias("b"))
            .groupBy("host", F.col("b.paths").alias("path"), F.col("b.hashes").alias("hash"))
            .agg(F.count(F.lit(1)).alias("d"), F.sum(F.col("b.noise").cast("bigint")).alias("marked")))
    leaf = written(leaf, "leaves")
    on_pages = nodes.select("host", F.explode(F.array_distinct("paths")).alias("path")).groupBy("host", "path").agg(F.count(F.lit(1)).alias("m"))
    # Importance depends on d and m alone, so a node's texts are counted by d before they meet its m.
    nodes_by_d = leaf.groupBy("host", "path", "d").agg(F.count(F.lit(1)).alias("n"), F.sum("marked").alias("marked"))
    importance = F.greatest(F.lit(0.0), 1 - F.log("d") / F.log(F.col("m") + PRIOR))
    sums = (nodes_by_d.join(on_pages, ["host", "path"]).groupBy("host", "path")
            .agg(F.sum(F.col("n") * F.col("d") * importance).alias("s"), F.sum(F.col("n") * F.col("d")).alias("n"), F.sum("marked").alias("marked")))
    sums = sums.withColumn("s", F.col("s") * (1 - F.col("marked") / F.col("n")))
    texts = (leaf.where((F.col("marked") < F.col("d")) & (2 * F.col("d") > PRIOR)).join(on_pages, ["host", "path"])
             .where((importance < LOW) & (2 * F.col("d") >= F.col("m") + PRIOR)).select("host", "path", "hash"))
    # Mean content importance below every branch, and that of its most important node.
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    below = (sums.where(F.size(parts) >= 2).select("host", F.explode(prefixes).alias("path"), "s", "n", "marked").groupBy("host", "path")
             .agg((F.sum("s") / F.sum("n")).alias("content"), F.max(F.col("s") / F.col("n")).alias("most"), F.sum(F.col("n") - F.col("marked")).alias("unmarked"))
             .where((F.col("unmarked") > 0) & (F.col("most") <= HIGH)))
    style = (nodes.select("host", F.explode(F.arrays_zip("nodes", "styles")).alias("x")).groupBy("host", F.col("x.nodes").alias("path"), F.col("x.styles").alias("style"))
             .agg(F.count(F.lit(1)).alias("c")).groupBy("host", "path")
             .agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("l"), F.sum(F.col("c") * F.log("c")).alias("clogc")))
    spread = F.when(F.col("m") > 1, (F.log("m") - F.col("clogc") / F.col("m")) / F.log("m")).otherwise(1.0)
    whole = below.join(style, ["host", "path"], "left").na.fill({"m": 0, "l": 1, "clogc": 0.0})
    weight = F.pow(F.lit(DAMPING), F.col("l"))
    branches = whole.where((1 - weight) * spread + weight * F.col("content") < LOW).select("host", "path")
    by_text = texts.groupBy("host").agg(F.collect_list(F.struct("path", "hash")).alias("low_texts"))
    by_branch = branches.groupBy("host").agg(F.collect_list("path").alias("low_branches"))
    return by_text.join(by_branch, "host", "full")


def main_texts(pages: DataFrame, id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(id, url, text, by_tree) of every page: its article, blocks joined by empty lines. ``by_tree`` counts the blocks
    that markup left and the tree took."""
    nodes = page_nodes(pages, id, url, source)
    low = stored(template(nodes.join(stored(copies(nodes), "copies"), "key", "left_anti")), "template")
    # Pages stay where they are if the templates are small enough to send to all of them.
    items = low.agg(F.coalesce(F.sum(F.coalesce(F.size("low_texts"), F.lit(0)) + F.coalesce(F.size("low_branches"), F.lit(0))), F.lit(0))).first()[0]
    low = F.broadcast(low) if items <= BROADCAST_ITEMS else low
    kind = pages.schema[id].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        out, taken, known = [], [], {}
        for host, paths, texts, noise, article, hashes, low_texts, low_branches in zip(*(batch.column(k).to_pylist() for k in range(2, 10))):
            if host not in known:  # pages of one host come in a row or not; few hosts are in one slice
                known[host] = ({(x["path"], x["hash"]) for x in low_texts or ()}, set(low_branches or ()))
            one, branches = known[host]
            own = [k for k in range(len(texts)) if not noise[k]]
            own = [k for k in own if article[k]] or own
            left = [k for k in own if (paths[k], hashes[k]) not in one]
            if branches:
                left = [k for k in left if paths[k] not in branches and not any(paths[k][:i] in branches for i, c in enumerate(paths[k]) if c == "/")]
            out.append("\n\n".join(texts[k] for k in left or own))
            taken.append(len(own) - len(left or own))
        yield {"id": batch.column("id"), "url": batch.column("url"), "text": out, "by_tree": taken}
    joined = nodes.select("id", "url", "host", "paths", "texts", "noise", "article", "hashes").join(low, "host", "left")
    return map_arrow(joined.select("id", "url", "host", "paths", "texts", "noise", "article", "hashes", "low_texts", "low_branches"), run,
                     f"id {kind}, url string, text string, by_tree int", rows=256)
