"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A word is a string of symbols: its bytes, the last one marked as the word's end. An Aho-Corasick
automaton lists the tokens at every place of a word. The encoder takes the longest token whose
pair with the token before it is compatible, that is, whose border no merge would have crossed;
where none fits it steps back and marks the place as a dead end. Each place dies at most once, so
a word takes linear time, and the tokens are those that merging pair by pair gives.

Edge cases: null is the empty text, with no tokens; texts are encoded whole, piece by piece; equal
texts give equal rows; an empty table gives an empty table; other columns are left as they are.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from strata.llm.common import fresh, map_arrow

# Fixed values of this tokenizer's file format.
END = "</w>"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Words whose tokens a worker keeps, in each of two generations.
WORDS_KEPT = 1 << 16
# Pairs of tokens of which a worker keeps whether they can be neighbours. What is kept stays as long as the worker, through other stages too.
PAIRS_KEPT = 1 << 18
# Tokens decoded at once.
SPAN = 1 << 18


@dataclass
class Vocabulary:
    """Tokens by id as symbol strings (bytes as characters 0-255, a word's last byte as 256-511), as
    written in the file, and the two parts that each was merged from (itself twice for a symbol)."""
    symbols: list[str]
    written: list[str]
    parts: list[tuple[int, int]]
    special: dict[str, int]


def byte_letters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: printable ones as
    themselves, the others in order from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def load(path: str) -> Vocabulary:
    """Read a tokenizers file whose BPE marks the ends of words."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    of_letter = {c: b for b, c in enumerate(byte_letters())}
    size = max([*vocab.values(), *special.values()]) + 1
    symbols, written, parts = [""] * size, [""] * size, [(i, i) for i in range(size)]
    for token, i in vocab.items():
        written[i] = token
        ends = token.endswith(END) and len(token) > len(END)
        data = [of_letter[c] for c in (token[:-len(END)] if ends else token) if c in of_letter]
        symbols[i] = "".join(map(chr, data[:-1])) + chr(data[-1] + 256 * ends) if data else ""
    for token, i in special.items():
        symbols[i], written[i] = "", token
    for merge in merges:
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        if a + b in vocab:
            parts[vocab[a + b]] = (vocab[a], vocab[b])
    return Vocabulary(symbols, written, parts, special)


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, v: Vocabulary):
        self.parts, self.special = v.parts, v.special
        self.merged = {p: i for i, p in enumerate(v.parts) if p != (i, i)}
        self.length = [len(s) for s in v.symbols]
        self.marks = regex.compile("|".join(map(regex.escape, v.special))) if v.special else None
        self.pieces = regex.compile(PIECES)
        self.ascii_pieces = re.compile(PIECES.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r ")).findall
        self.odd_space = regex.compile("[\x1c-\x1f]")
        self.spaces = regex.compile(r"\p{White_Space}+")
        self._pairs: dict[int, bool] = {}
        self._young: dict[str, bytes] = {}  # words met lately, and those met before them
        self._old: dict[str, bytes] = {}
        known = {s: i for i, s in enumerate(v.symbols) if s}
        # A token that its own symbols would never merge to cannot occur.
        known = {s: i for s, i in known.items() if self._reached(i)}
        self.shorter = [next((known[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in known), -1) for s in v.symbols]
        self.known = known
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for s, i in known.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        # Decoding: all written tokens, each with a space behind it, end to end.
        data = [f"{w} ".encode() for w in v.written]
        self.offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(data), np.uint8)

    def _reached(self, token: int) -> bool:
        """Its two parts are reached themselves and border on each other until they are merged."""
        a, b = self.parts[token]
        return a == token or (self._reached(a) and self._reached(b) and self._borders(a, b, token))

    def _borders(self, left: int, right: int, before: int) -> bool:
        """No merge earlier than ``before`` joins what lies on either side of the border. Tokens are
        numbered in the order of their merges, so undoing the younger one first runs time backwards."""
        while True:
            crossing = self.merged.get((left, right))
            if crossing is not None and crossing < before:
                return False
            # Of two equal pairs the left one is merged first: a right token counts half a step later.
            last_left, first_right = self.parts[left][1], self.parts[right][0]
            if left > right and last_left != left or first_right == right:
                if last_left == left:
                    return True
                left, before = last_left, left
            else:
                right, before = first_right, right + 1

    def compatible(self, left: int, right: int) -> bool:
        if len(self._pairs) > PAIRS_KEPT:
            self._pairs.clear()
        known = self._pairs[left << 20 | right] = self._borders(left, right, 1 << 30)
        return known

    def _encode_symbols(self, s: str) -> list[int]:
        whole = self.known.get(s)
        if whole is not None:
            return [whole]
        n, length, shorter, pairs = len(s), self.length, self.shorter, self._pairs
        longest = [-1] * n
        for end, token in self.automaton.iter(s):  # of the matches from one place, the last is the longest
            longest[end + 1 - length[token]] = token
        dead, out, last, at, token = None, [], -1, 0, longest[0]
        while at < n:
            while token >= 0:
                if dead is None or at + length[token] not in dead:
                    if last < 0:
                        break
                    fits = pairs.get(last << 20 | token)
                    if fits or fits is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                last = token
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                dead = dead or set()
                dead.add(at)
                out.pop()
                at -= length[last]
                token = shorter[last]
                last = out[-1] if out else -1
        return out

    def _encode_chunk(self, chunk: str) -> bytes:
        """A stretch without white space."""
        ids: list[int] = []
        at = 0
        if self.marks and "<|" in chunk:
            for mark in self.marks.finditer(chunk):
                self._encode_plain(chunk[at:mark.start()], ids)
                ids.append(self.special[mark.group()])
                at = mark.end()
        self._encode_plain(chunk[at:], ids)
        return array("I", ids).tobytes()

    def _encode_plain(self, text: str, ids: list[int]) -> None:
        if text.isascii():
            for piece in self.ascii_pieces(text.lower()):
                ids += self._encode_symbols(piece[:-1] + chr(ord(piece[-1]) + 256))
            return
        # Letters are lowered one by one: a sigma at the end of a word stays a plain one.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        for piece in self.pieces.findall(text):
            data = piece.encode("utf-8", "surrogatepass").decode("latin-1")
            ids += self._encode_symbols(data[:-1] + chr(ord(data[-1]) + 256))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        young, old, out = self._young, self._old, []
        for chunk in (self.spaces.split(text) if self.odd_space.search(text) else text.split()):
            ids = young.get(chunk)
            if ids is None:
                ids = old.get(chunk)
                if ids is None:
                    ids = self._encode_chunk(chunk)
                if len(chunk) < 64:
                    if len(young) >= WORDS_KEPT:
                        self._old, self._young = old, young = young, {}
                    young[chunk] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> list[bytes]:
        """The text's bytes in spans."""
        all_ids, out = np.frombuffer(ids, "<u4"), []
        for at in range(0, len(all_ids), SPAN):
            part = all_ids[at:at + SPAN]
            start = self.offsets[part]
            size = self.offsets[part + 1] - start
            ends = np.cumsum(size)
            out.append(self.blob[np.repeat(start - ends + size, size) + np.arange(ends[-1])].tobytes())
        if out:
            out[-1] = out[-1][:-1]
        return out


_codecs: dict[str, Codec] = {}


def _codec(key: str, vocabulary) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary.value)
    return _codecs[key]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``ids``: the tokens of the whole text as little-endian unsigned 32-bit integers."""
    return _run(docs, path, text, digests=False)


def encode_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256: the digests of the ids and of the text decoded from
    those very ids."""
    return _run(docs, path, text, digests=True)


def _run(docs: DataFrame, path: str, text: str, digests: bool) -> DataFrame:
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(path))  # as large as the file
    data, = fresh(docs, "_text")
    others = [f for f in docs.schema.fields if f.name != text or not digests]
    added = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids binary"
    clash = {f.split()[0] for f in added.split(", ")}
    others = [f for f in others if f.name.lower() not in clash]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), added])

    def run(batch: pa.RecordBatch):
        codec = _codec(path, vocabulary)
        out = {f.name: batch.column(f.name) for f in others}
        ids = (codec.encode(t) for t in batch.column(data).to_pylist())
        if not digests:
            yield out | {"ids": list(ids)}
            return
        rows = [], [], []
        for data_ids in ids:
            digest = hashlib.sha256()
            for span in codec.decode(data_ids):
                digest.update(span)
            for col, x in zip(rows, (len(data_ids) // 4, hashlib.sha256(data_ids).hexdigest(), digest.hexdigest())):
                col.append(x)
        yield out | dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), rows))
    picked = docs.select(*[f"`{f.name}`" for f in others], F.coalesce(F.col(text), F.lit("")).alias(data))
    return map_arrow(picked, run, schema, rows=128)
