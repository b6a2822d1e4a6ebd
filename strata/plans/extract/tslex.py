"""Lexer of TypeScript and JavaScript: what a character is depends on what stands before it.

``code`` returns a text of the same length and lines in which comments are empty, and strings, regular
expressions and the text of template literals are quoted and inert. The code in ``${…}`` stays code, to any depth, and its own
braces count apart from those around it. A slash begins a regular expression where no value can end: after
an operator, an opening bracket, a keyword or nothing. A comma that parts the declarators of one ``const``, ``let`` or ``var``
becomes a mark of that keyword, so that each declarator can be told by itself; declarations end at a semicolon, at
the bracket around them, or at a line break after which a statement cannot go on.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

# What a further declarator is marked with, in place of its comma.
DECLARATORS = {"const": "", "let": "", "var": "", "export const": "", "export let": "", "export var": ""}
MARKS = "-"

_INERT = str.maketrans({c: "_" for c in " \t\r{}()[];=<>?&|!,*\"'`\\$#"})
_FOREIGN = str.maketrans({m: "_" for m in DECLARATORS.values()})
_TOKEN = re.compile(r"""(?sx)
    (?P<doc>/\*\*(?!/).*?(?:\*/|\Z))
  | (?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)
  | (?P<string>"(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.)*+'?)
  | (?P<declare>(?<![\w$.])(?:const|let|var)(?=\s))
  | (?P<angle>(?<=[\w$])<)
  | (?P<mark>[`/()\[\]{},;\n])""")
_TEMPLATE = re.compile(r"(?s)(?:[^`\\$]|\\.|\$(?!\{))*+")
_REGEX = re.compile(r"/(?![*/>])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[A-Za-z]*")
_TYPES = re.compile(r"[^<>(){};=]*+")
_WORD = re.compile(r"[\w$]+\Z")
_NEXT = re.compile(r"(?s)(?:\s|//[^\n]*|/\*.*?\*/)*+(.)")
_NAME_NEXT = re.compile(r"(?s)(?:\s|//[^\n]*|/\*.*?\*/)*+[A-Za-z_$]")
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%~^")
_WORDS_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}
_CLOSES = {")": "(", "]": "[", "}": "{"}
_GOES_ON_AFTER = set(",=([{+-*/%&|?:<>!~^.")
_GOES_ON_WITH = set(",=)]}+-*/%&|?:<>.;([`")


def _inert(text: str) -> str:
    return text.translate(_INERT).replace("/*", "_*")


def _quoted(piece: str) -> str:
    return piece[:1] + _inert(piece[1:-1]) + (piece[-1:] if len(piece) > 1 else "")


def _blank(piece: str) -> str:
    return re.sub(r"[^\n]", " ", piece)


def _type_arguments(text: str, at: int) -> int | None:
    """End of the type arguments that open at ``at``, or None if it is a comparison."""
    depth = 0
    while at < len(text):
        if text[at] == "<":
            depth += 1
        elif text[at] == ">":
            depth -= 1
            if depth == 0:
                return at + 1
        else:
            return None
        at = _TYPES.match(text, at + 1).end()
    return None


def _exported(text: str, at: int) -> bool:
    """``export`` (and ``declare``) stands before the place."""
    for word in ("declare", "export"):
        while at and text[at - 1].isspace():
            at -= 1
        if text.endswith(word, 0, at):
            if word == "export":
                return True
            at -= len(word)
    return False


def code(text: str, keep_docs: bool = False) -> str:
    text = text.translate(_FOREIGN)
    out: list[str] = []
    frames: list[list] = [["", None]]  # [bracket, mark of the declaration under way]
    at, before = 0, ""  # ``before`` ends with the last thing that counts

    def template(start: int) -> int:
        """Text of a template from ``start`` (its first character is a quote by now) to its end or next hole."""
        stop = _TEMPLATE.match(text, start).end()
        out.append(_inert(text[start:stop]))
        if text.startswith("${", stop):
            out.append("` ")
            frames.append(["${", None])
            return stop + 2
        out.append(text[stop:stop + 1])
        return min(stop + 1, len(text))
    while True:
        found = _TOKEN.search(text, at)
        gap = text[at:found.start() if found else len(text)]
        out.append(gap)
        before = gap.rstrip() or before
        if not found:
            return "".join(out)
        kind, piece, here = found.lastgroup, found.group(), found.start()
        at = found.end()
        frame = frames[-1]
        if kind in ("doc", "comment"):
            out.append(piece if kind == "doc" and keep_docs else _blank(piece))
            continue
        if kind == "string":
            out.append(_quoted(piece))
            before = '"'
            continue
        if kind == "declare":
            out.append(piece)
            before = piece
            if frame[0] != "(":
                frame[1] = DECLARATORS[("export " if _exported(text, here) else "") + piece]
            continue
        if kind == "angle":
            end = _type_arguments(text, here)
            if end is not None and (_NEXT.match(text, end) is None or _NEXT.match(text, end).group(1) in "=(,;)\n"):
                out.append(text[here:end])
                at, before = end, ">"
            else:
                out.append("<")
                before = "<"
            continue
        if piece == "\n":
            out.append(piece)
            if frame[1] and before[-1:] not in _GOES_ON_AFTER:
                ahead = _NEXT.match(text, at)
                if ahead and ahead.group(1) not in _GOES_ON_WITH:
                    frame[1] = None
            continue
        if piece == "`":
            out.append(piece)
            at, before = template(at), "`"
            continue
        if piece == "/":
            word = _WORD.search(before)
            doubled = before[-2:] in ("++", "--")
            value_ends = (word.group() not in _WORDS_BEFORE_REGEX) if word else before != "" and not (
                before[-1] in _BEFORE_REGEX and not doubled or before.endswith("=>"))
            regex = None if value_ends else _REGEX.match(text, here)
            if regex:
                out.append('"' + _inert(regex.group()[1:-1]) + '"')
                at, before = regex.end(), '"'
                continue
        elif piece == "}" and frame[0] == "${":
            frames.pop()
            out.append("`")
            at, before = template(at), "`"
            continue
        elif piece in "([{":
            frames.append([piece, None])
        elif piece in _CLOSES:
            if frame[0] == _CLOSES[piece]:
                frames.pop()
        elif piece == ";":
            frame[1] = None
        elif piece == "," and frame[1] and _NAME_NEXT.match(text, at):
            out.append(frame[1])
            before = ","
            continue
        out.append(piece)
        before = before[-1:] + piece


def blank(text: Column, keep_docs: bool = False) -> Column:
    """``code`` of a column, in Arrow batches."""
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else code(t, keep_docs))
    return F.pandas_udf(run, "string")(text)
