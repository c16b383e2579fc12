"""Byte-level BPE by dynamic programming over prefixes.

The BPE encoding of a piece has a unique last token, and without it it is the
encoding of the rest. So each prefix stores one token: of those that end there
(found together, longest first, by an automaton over the vocabulary's suffixes)
the one that can stand after the last token of the prefix before it. Back-pointers
from the whole piece give the ids. Whether two tokens can stand side by side is
decided by their edges: the merges that build the right edge of the first and the
left edge of the second run in the order of their ranks, and no merge across the
border may come before one of theirs.

A text is first cut at special tokens, then at single spaces before a non-space,
which no piece crosses; what lies between is cut into pieces by the pattern, and
each distinct cut is encoded once. Null texts count as empty: no ids, empty text.
The vocabulary has a fixed size and is broadcast. Decoding needs nothing but ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Entries of each half of a worker's cache of encoded cuts. When the newer half is
#: full it becomes the older one, from which cuts that come again move back.
CACHE = 400_000
#: Pairs of tokens whose compatibility a worker remembers, and short pieces.
PAIRS = 250_000
SHORT = 5

# Letters and numbers of Unicode 17, which the tokenizer's older
# tables don't have and treat as symbols.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)

_new = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NEWER)
_letter, _number = rf"[\p{{L}}--[{_new}]]", rf"[\p{{N}}--[{_new}]]"
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_letter}+| ?{_number}+| ?(?:(?!{_letter}|{_number})\S)+|\s+(?!\S)|\s+", regex.V1)
#: A place no piece crosses. Python's \s has a few characters more, which only makes cuts longer.
CUT = re.compile(r" (?=\S)")
ODD = re.compile(r" (?=\s|\Z)")


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file, by rule: printable ones stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary: encode and decode."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        letters = byte_letters()
        model = data["model"]
        self.token = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens") or ()}
        self.bytes_of = self.token | {i: t.encode() for t, i in self.special.items()}
        id_of = {t: i for i, t in self.token.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = (model["vocab"][x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = id_of[self.token[a] + self.token[b]]
            self.rank[a, b] = r
            self.halves.setdefault(whole, (a, b, r))
        self.ends = ahocorasick.Automaton()
        for i, t in self.token.items():
            if len(t) == 1 or i in self.halves:
                self.ends.add_word(t.decode("latin-1"), (i, len(t)))
        self.ends.make_automaton()
        self.edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.bytes_of_name = {str(i): t for i, t in self.bytes_of.items()}
        self.fits: dict[int, bool] = {}
        self.short: dict[str, str] = {}
        self.cuts: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one side of a token while it is built, each with the rank of the merge that takes it in."""
        if (found := self.edges.get((token, side))) is None:
            found, t, taken = [], token, float("inf")
            while True:
                found.append((t, taken))
                if t not in self.halves:
                    break
                *half, taken = self.halves[t]
                t = half[side]
            found.reverse()
            self.edges[token, side] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether a text of the two tokens' bytes encodes as just these two."""
        if (found := self.fits.get(a << 32 | b)) is None:
            left, right = self.edge(a, 1), self.edge(b, 0)
            i = j = 0
            while True:
                (x, x_taken), (y, y_taken) = left[i], right[j]
                across = self.rank.get((x, y), float("inf"))
                # Equal ranks run from left to right.
                if across < x_taken and across <= y_taken and across != float("inf"):
                    found = False
                    break
                if i + 1 == len(left) and j + 1 == len(right):
                    found = True
                    break
                if x_taken <= y_taken:
                    i += 1
                else:
                    j += 1
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            self.fits[a << 32 | b] = found
        return found

    def piece(self, data: bytes) -> list[int]:
        last, fits = [-1] * (len(data) + 1), self.fits
        for end, (token, size) in self.ends.iter(data.decode("latin-1")):
            end += 1
            if last[end] < 0:
                if size == end:
                    last[end] = token
                elif (before := last[end - size]) >= 0:
                    ok = fits.get(before << 32 | token)
                    if self.compatible(before, token) if ok is None else ok:
                        last[end] = token
        ids, end = [], len(data)
        while end:
            ids.append(last[end])
            end -= len(self.token[last[end]])
        return ids[::-1]

    def named(self, text: str) -> str:
        """The ids of a piece, joined by commas; those of short ones are remembered."""
        if (found := self.short.get(text)) is None:
            found = ",".join([str(i) for i in self.piece(text.encode())])
            if len(text) <= SHORT and len(self.short) < PAIRS:
                self.short[text] = found
        return found

    def cut(self, text: str) -> str:
        """The ids, joined by commas, of what lies between two cuts."""
        if (found := self.cuts.get(text)) is None:
            found = self.older.get(text)
            if found is None:
                found = ",".join([self.named(p) for p in PIECE.findall(text)])
            if len(self.cuts) >= CACHE:
                self.cuts, self.older = {}, self.cuts
            self.cuts[text] = found
        return found

    def parts(self, text: str) -> Iterator[str]:
        start = 0
        for m in self.at_special.finditer(text) if self.at_special else ():
            if m.start() > start:
                yield from self.plain(text[start : m.start()])
            yield str(self.special[m[0]])
            start = m.end()
        if start < len(text):
            yield from self.plain(text[start:])

    def plain(self, text: str) -> Iterator[str]:
        first, *rest = CUT.split(text) if ODD.search(text) else text.split(" ")
        cut = self.cut
        if first:
            yield cut(first)
        for x in rest:
            x = " " + x
            yield self.cuts.get(x) or cut(x)

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids in self.parts(text) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode(errors="replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """(tokens, SHA-256 of the ids joined by commas, SHA-256 of the text that the ids decode to)."""
        ids = ",".join(self.parts(text))
        names = ids.split(",") if ids else []
        back = b"".join(map(self.bytes_of_name.__getitem__, names)).decode(errors="replace").encode()
        return len(names), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()


_loaded: dict[int, Bpe] = {}


def _of(spec) -> Bpe:
    """One vocabulary per worker process."""
    key = hash(spec.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(spec.value)
    return _loaded[key]


def _spec(df: DataFrame, path: str):
    small_batches(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(Path(path).read_text())


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids, for the vocabulary file at path."""
    spec = _spec(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(spec)
        for batch in batches:
            ids = pa.array([bpe.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text."""
    spec = _spec(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(spec)
        for batch in batches:
            texts = pa.array([bpe.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    rows = encoded.select(F.col(id).alias("doc_id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded again in one pass."""
    spec = _spec(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(spec)
        for batch in batches:
            found = [bpe.digest(t or "") for t in batch.column(1).to_pylist()]
            n, ids, back = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
