"""Tokens with places and owners for brace languages, as one Spark job over whole texts.

1. Texts are spread by path over as many tasks as their length asks for. There, comments and string bodies are blanked
   without moving any character, and one regex cuts each text at its tokens; the tokens stay where they are.
2. Running sums over a file give offsets, lines, columns and brace levels; braces of one level
   alternate open and close, so the next row of the level is the match.
3. A sweep over declaration spans gives each token its innermost declaration.

Windows here run per file. A file is one input row, so its tokens fit one task by construction.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strata.plans.extract import tslex

# Pieces of C-like text: comments, strings, and what lies between them.
_C_PIECES = (
    r"(?s)/\*.*?(?:\*/|\z)|//[^\n]*+"
    r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?'
    r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?"
    r"|`[^`\\]*+(?:\\.[^`\\]*+)*+`?"
    r"""|[^/"'`]++|/"""
)
_SQL_PIECES = r"""(?s)/\*.*?(?:\*/|\z)|--[^\n]*+|'[^']*+(?:''[^']*+)*+'?|[^/'-]++|[/-]"""
# Characters of a string body that could be taken for code.
_CODE_CHARS = r"""[ \t\r{}()\[\];=<>?&|!,*"'`\\$#]"""


def _blank(piece: Column) -> Column:
    return F.regexp_replace(piece, r"[^\n]", " ")


def blank(text, style: str = "c", keep_docs: bool = False) -> Column:
    """Text of the same length and lines with comments emptied and string bodies made inert.
    ``keep_docs`` leaves ``/** … */`` blocks; style ``ts`` is that of ``tslex``."""
    text = F.col(text) if isinstance(text, str) else text
    if style == "ts":
        return tslex.blank(text, keep_docs)
    pieces = F.regexp_extract_all(text, F.lit(_SQL_PIECES if style == "sql" else _C_PIECES), F.lit(0))
    line_comment = "--" if style == "sql" else "//"

    def inert(p):
        comment = p.startswith("/*") | p.startswith(line_comment)
        quoted = F.substring(p, 1, 1).isin('"', "'", "`") & (F.length(p) > 1)
        body = F.regexp_replace(F.substring(p, F.lit(2), F.length(p) - 2), _CODE_CHARS, "_")
        doc = p.startswith("/**") & (p != "/**/")
        out = F.when(quoted, F.concat(F.substring(p, 1, 1), body, F.substring(p, F.length(p), F.lit(1))))
        out = out.when(comment & ~doc if keep_docs else comment, _blank(p))
        return out.otherwise(p)

    return F.array_join(F.transform(pieces, inert), "")


def for_headers(code: Column) -> Column:
    """Semicolons of ``for (;;)`` headers become commas, so a semicolon always ends a statement."""
    return F.regexp_replace(code, r"(\bfor\s*\([^;{}]*);([^;{}]*);", "$1,$2,")


@dataclass(frozen=True)
class Grammar:
    """Token classes in order of precedence, and what they mean for nesting. A token is
    (class, regex) or (class, regex, what must follow, what must precede).

    Most positions of a text start no token. Tokens are therefore tried only where a word
    starts, or, for the classes in ``marks`` (and ``either``), at one of ``mark_chars``."""

    tokens: list[tuple]
    decls: list[str]
    owners: list[str]
    marks: list[str]
    mark_chars: str = r"{};"
    either: list[str] = field(default_factory=list)
    conditional: list[str] = field(default_factory=list)
    decisions: list[str] = field(default_factory=list)
    style: str = "c"
    keep_docs: bool = False
    semicolon_for: bool = False

    @property
    def regex(self) -> str:
        marks = {"open", "close", "semi", *self.marks}
        words = self._any(lambda name: name not in marks)
        others = self._any(lambda name: name in marks or name in self.either)
        return rf"(?:(?<![\w$.])(?=[A-Za-z_$@])(?:{words})|(?=[{self.mark_chars}])(?:{others}))"

    def _any(self, wanted) -> str:
        around = [(rx, *more, "", "")[:3] for name, rx, *more in self.tokens if wanted(name)]
        return "|".join(f"(?:{lead}(?:{rx}){follow})" for rx, follow, lead in around)

    def classify(self, tok: Column) -> Column:
        out = F.when(tok == "{", "open").when(tok == "}", "close").when(tok == ";", "semi")
        for name, rx, *_ in self.tokens:
            if name not in ("open", "close", "semi"):
                out = out.when(tok.rlike(rf"(?s)\A(?:{rx})\z"), name)
        return out


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def tail(c: Column) -> Column:
    """Characters after the last newline."""
    return F.length(F.substring_index(c, "\n", -1))


# Characters of text in one task. The sorts below hold about a hundred times that.
TASK_CHARS = 4 << 20


def by_file(df: DataFrame, chars: int = TASK_CHARS, made: Column | None = None) -> DataFrame:
    """Texts spread by path, as many parts as their length asks for. Windows per file then need no shuffle of tokens,
    and no task has more to sort than it can hold, however large the corpus. ``made`` is what a Python function makes of
    the text and takes its place; as Spark forgets behind such a function how rows lie, those texts are spread once more."""
    total = df.agg(F.sum(F.length("text"))).first()[0] or 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-total // chars), min(cores, -(-total // (chars >> 4))), 1)
    spread = df.repartition(parts, "path")
    return spread if made is None else spread.withColumn("text", made).repartition(parts, "path")


def cut(df: DataFrame, code: Column, regex: str, keep=("path", "language"), made: Column | None = None) -> DataFrame:
    """(keep…, idx, tok, start, stop, line, col, stop_line, stop_col, gap_blank) per match of
    ``regex``: offsets are 1-based, columns 0-based, ``stop`` exclusive. ``made`` as in ``by_file``."""
    df = by_file(df.select(*dict.fromkeys([*keep, "path", "language", "text"])), made=made)
    # One pass marks both ends of every token; the cuts are plain string work after that.
    clean = F.translate(code, "\x01\x02", "  ")
    marked = F.regexp_replace(clean, f"(?s){regex}", "\x01$0\x02")
    rows = df.select(*keep, F.posexplode(F.split(marked, "\x02")).alias("idx", "piece"))
    rows = rows.where(F.contains("piece", F.lit("\x01"))).select(
        *keep, "idx", F.substring_index("piece", "\x01", 1).alias("gap"), F.substring_index("piece", "\x01", -1).alias("tok"))
    gap, tok = F.col("gap"), F.col("tok")
    narrow = rows.select(
        *keep, "idx", "tok", (F.length(gap) + F.length(tok)).alias("plen"), F.length(tok).alias("tlen"),
        newlines(gap).alias("gnl"), tail(gap).alias("gtail"),
        newlines(tok).alias("tnl"), tail(tok).alias("ttail"),
        (~gap.rlike(r"\S")).alias("gap_blank"))
    run = W.partitionBy(keep[0]).orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    placed = narrow.withColumns({
        "stop": F.sum("plen").over(run) + 1,
        "stop_line": F.sum(F.col("gnl") + F.col("tnl")).over(run) + 1})
    start = F.col("stop") - F.col("tlen")
    # Offset of the first character of the line that the token starts / stops in.
    starts_line = F.when(F.col("gnl") > 0, start - F.col("gtail"))
    after_tok = F.when(F.col("tnl") > 0, F.col("stop") - F.col("ttail"))
    placed = placed.withColumns({"start": start, "_bol": starts_line, "_eol": after_tok})
    before = W.partitionBy(keep[0]).orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    bol = F.coalesce("_bol", F.greatest(F.max("_bol").over(before), F.max("_eol").over(before)), F.lit(1))
    placed = placed.withColumn("bol", bol)
    return placed.select(
        *keep, "idx", "tok", "start", "stop",
        (F.col("stop_line") - F.col("tnl")).cast("int").alias("line"),
        (F.col("start") - F.col("bol")).cast("int").alias("col"),
        F.col("stop_line").cast("int").alias("stop_line"),
        F.when(F.col("tnl") > 0, F.col("ttail")).otherwise(F.col("stop") - F.col("bol")).cast("int").alias("stop_col"),
        "gap_blank")


def scan(sources: DataFrame, g: Grammar, prepare: Callable[[Column], Column] = lambda code: code) -> DataFrame:
    """Classified tokens of each file with nesting facts.

    Columns added to ``cut``: ``cls``; ``level`` (brace depth the token lies in, for a brace the
    depth inside it); ``end``/``end_line``/``end_col`` of the block or statement it opens;
    ``closed`` (its brace has a match); ``complexity``; ``cond_depth`` and ``in_cond``;
    ``doc`` (comment right before); ``owner_*`` of the innermost declaration around it.
    ``prepare`` may change the blanked code, but not its length."""
    code = blank("text", g.style, g.keep_docs)
    made = code if g.style == "ts" else None
    code = F.col("text") if g.style == "ts" else code
    code = prepare(for_headers(code) if g.semicolon_for else code)
    toks = cut(sources, code, g.regex, made=made).withColumn("cls", g.classify(F.col("tok")))
    by_idx = W.partitionBy("path").orderBy("idx")
    run = by_idx.rowsBetween(W.unboundedPreceding, 0)
    opens = F.when(F.col("tok").endswith("{"), 1).otherwise(0)
    closes = F.when(F.col("cls") == "close", 1).otherwise(0)
    is_cond = F.col("cls").isin(g.conditional) if g.conditional else F.lit(False)
    decision = F.col("cls").isin(g.decisions) if g.decisions else F.lit(False)
    semi = F.col("tok").endswith(";")
    ends_stmt = semi | (F.col("cls") == "close") | F.col("tok").endswith("{")
    toks = toks.withColumns({
        "opens": opens,
        "depth": F.sum(opens - closes).over(run),
        "decided": F.sum(F.when(decision, 1).otherwise(0)).over(run),
        "stmt": F.sum(F.when(ends_stmt, 1).otherwise(0)).over(run) - F.when(ends_stmt, 1).otherwise(0),
        "prev_tok": F.lag("tok").over(by_idx), "prev_cls": F.lag("cls").over(by_idx)})
    level = F.when(F.col("opens") == 1, F.col("depth")).when(F.col("cls") == "close", F.col("depth") + 1) \
        .otherwise(F.col("depth"))
    in_stmt = W.partitionBy("path", "stmt").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    toks = toks.withColumns({
        "level": level,
        "doc": F.when((F.col("prev_cls") == "doc") & F.col("gap_blank"), F.col("prev_tok")),
        "cond_stmt": F.max(F.when(is_cond, 1).otherwise(0)).over(in_stmt)})
    # Matching brace: within a level, the row after an opening one among the braces.
    is_brace = (F.col("opens") == 1) | (F.col("cls") == "close")
    by_level = W.partitionBy("path", "level").orderBy("idx")
    # Backwards, so that the nearest row behind is the last one seen.
    behind = W.partitionBy("path", "level").orderBy(F.desc("idx")).rowsBetween(W.unboundedPreceding, -1)
    brace = F.when(F.col("cls") == "close", F.struct("idx", "stop", "stop_line", "stop_col", "decided"))
    enders = F.when(semi | (F.col("cls") == "close"), F.struct("idx", "start", "line", "col", "decided"))
    is_owner = F.col("cls").isin(g.owners)
    cond_open = (F.col("opens") == 1) & (F.col("cond_stmt") == 1) & ~is_owner
    toks = toks.withColumns({
        "_match": F.last(brace, ignorenulls=True).over(behind),
        "_stmt_end": F.last(enders, ignorenulls=True).over(behind),
        "cond_open": cond_open.cast("int"),
        "_closes_cond": F.when(F.col("cls") == "close", F.last(
            F.when(F.col("opens") == 1, cond_open.cast("int")), ignorenulls=True)
            .over(by_level.rowsBetween(W.unboundedPreceding, -1)))})
    is_decl = F.col("cls").isin(g.decls) & ~semi
    braced = F.col("opens") == 1
    toks = toks.withColumns({
        "closed": F.when(braced, F.col("_match").isNotNull()).otherwise(F.lit(True)),
        "end": F.when(braced, F.col("_match.stop")).when(is_decl, F.col("_stmt_end.start")).otherwise(F.col("stop")),
        "end_line": F.when(braced, F.col("_match.stop_line")).when(is_decl, F.col("_stmt_end.line"))
        .otherwise(F.col("stop_line")),
        "end_col": F.when(braced, F.col("_match.stop_col")).when(is_decl, F.col("_stmt_end.col"))
        .otherwise(F.col("stop_col")),
        "complexity": (F.lit(1) + F.coalesce(
            F.when(braced, F.col("_match.decided")).when(is_decl, F.col("_stmt_end.decided")),
            F.col("decided")) - F.col("decided")).cast("int"),
        "cond_depth": F.sum(F.col("cond_open") - F.coalesce("_closes_cond", F.lit(0))).over(run)})
    toks = toks.withColumns({
        "end": F.coalesce("end", "stop"), "end_line": F.coalesce("end_line", "stop_line"),
        "end_col": F.coalesce("end_col", "stop_col")})
    return _owners(toks, is_owner)


def _owners(toks: DataFrame, is_owner: Column) -> DataFrame:
    """Sweep: a declaration opens at its start and closes at its end; tokens fall between. The
    last declaration opened at a token's depth is its owner."""
    me = F.struct("start", "stop", "cls", "tok", "level", "opens", "cond_depth", "line")
    mark = lambda at, step, delta, far: F.struct(
        at.alias("at"), F.lit(step).alias("step"), F.lit(delta).alias("delta"), far.alias("far"))
    point = mark(F.col("start"), 0, 0, F.lit(0).cast("bigint"))
    opened = mark(F.col("start"), 1, 1, -F.col("end"))
    closed = mark(F.col("end"), -1, -1, F.lit(0).cast("bigint"))
    marks = toks.withColumn("_m", F.explode(
        F.when(is_owner, F.array(point, opened, closed)).otherwise(F.array(point))))
    order = W.partitionBy("path").orderBy("_m.at", "_m.step", "_m.far", "idx")
    deep = marks.withColumn("decl_depth", F.sum("_m.delta").over(order.rowsBetween(W.unboundedPreceding, 0)))
    group = W.partitionBy("path", "decl_depth").orderBy("_m.at", "_m.step", "_m.far", "idx") \
        .rowsBetween(W.unboundedPreceding, 0)
    owned = deep.where("_m.delta >= 0").withColumn(
        "owner", F.last(F.when(F.col("_m.delta") == 1, me), ignorenulls=True).over(group))
    inside = F.when(F.col("decl_depth") > 0, F.col("owner"))
    out = owned.where("_m.delta = 0").withColumn("owner", inside)
    direct_level = F.when(F.col("opens") == 1, F.col("level") - 1).otherwise(F.col("level"))
    return out.select(
        "path", "language", "idx", "cls", "tok", "start", "stop", "line", "col", "stop_line", "stop_col",
        "level", "opens", "closed", "end", "end_line", "end_col", "complexity", "doc", "prev_tok", "prev_cls",
        F.col("owner.start").alias("owner_start"), F.col("owner.cls").alias("owner_cls"),
        F.col("owner.tok").alias("owner_tok"), F.col("owner.line").alias("owner_line"),
        # Directly in the owner's body, not in a block or initialiser inside it.
        (F.col("owner").isNotNull() & (F.col("owner.level") == direct_level)).alias("direct"),
        ((F.col("cond_stmt") == 1)
         | (F.col("cond_depth") - F.col("opens") * F.col("cond_open") > F.coalesce(F.col("owner.cond_depth"), F.lit(0)))
         ).alias("in_cond"))


def balance_report(sources: DataFrame, style: str = "c") -> DataFrame:
    """Files whose braces do not close: where lexical facts may be off."""
    code = blank("text", style)
    return sources.select("path", (F.regexp_count(code, F.lit(r"\{")) - F.regexp_count(code, F.lit(r"\}")))
                          .alias("open_braces")).where("open_braces <> 0")
