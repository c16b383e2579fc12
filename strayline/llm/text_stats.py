"""Counts per text that quality models read, from word tables of a batch.

Null texts have no words; all their counts are 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import owners, per_text, small_batches, words

SYMBOLS = r"[#*$%&|<>]"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_symbol_words", "n_bar_words",
    "n_upper_words", "n_bang_words", "n_twin_words", "n_letters", "n_digits", "n_stop_words", "n_long_words", "n_other",
)


def repeated_words(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text the words in 3-word windows that are in it twice or more."""
    n = len(codes)
    covered = np.zeros(n, bool)
    if n >= 3:
        text = owners(offsets)
        start = np.flatnonzero(text[:-2] == text[2:])
        # Equal windows have equal mixes; the few that share a mix are compared themselves.
        with np.errstate(over="ignore"):
            mix = text[start].astype(np.uint64)
            for i in range(3):
                mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[start + i].astype(np.uint64)
        twice = start[pd.Series(mix).duplicated(keep=False).to_numpy()]
        keys = list(zip(text[twice].tolist(), codes[twice].tolist(), codes[twice + 1].tolist(), codes[twice + 2].tolist()))
        found = Counter(keys)
        hit = twice[np.fromiter((found[k] > 1 for k in keys), bool, len(keys))]
        for i in range(3):
            covered[hit + i] = True
    return per_text(covered, offsets)


def lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    if "\n" not in text:
        return int(bool(text.strip(" \t\n\x0b\x0c\r"))), 0
    own = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(own), len(own) - len(set(own))


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    codes, offsets, known = words(texts)
    of = lambda a: np.asarray(a).astype(np.int64)
    chars = of(pc.utf8_length(known))
    symbols = of(pc.count_substring_regex(known, SYMBOLS))
    letters = of(pc.count_substring_regex(known, r"\pL"))
    digits = of(pc.count_substring_regex(known, r"[0-9]"))
    other = chars - letters - digits - of(pc.count_substring_regex(known, r"[.,;:!?'\"()-]")) - symbols
    upper = of(pc.equal(pc.utf8_upper(known), known)) * (letters > 1)
    total = lambda w: per_text(w[codes], offsets)
    twin = np.zeros(len(codes), bool)
    text = owners(offsets)
    twin[1:] = (codes[1:] == codes[:-1]) & (text[1:] == text[:-1])
    split = [lines(t or "") for t in texts.to_pylist()]
    return {
        "n_words": np.diff(offsets),
        "word_chars": total(chars),
        "n_symbols": total(symbols),
        "n_lines": np.array([a for a, _ in split], np.int64),
        "n_dup_lines": np.array([b for _, b in split], np.int64),
        "n_repeat_words": repeated_words(codes, offsets),
        "n_symbol_words": total((symbols > 0).astype(np.int64)),
        "n_bar_words": total(of(pc.equal(known, "|"))),
        "n_upper_words": total(upper),
        "n_bang_words": total(of(pc.ends_with(known, "!"))),
        "n_twin_words": per_text(twin, offsets),
        "n_letters": total(letters),
        "n_digits": total(digits),
        "n_stop_words": total((chars <= 3).astype(np.int64)),
        "n_long_words": total((chars >= 14).astype(np.int64)),
        "n_other": total(other),
    }


def with_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in carry and COUNTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = counts(batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(found[c].astype(np.int64)) for c in COUNTS]], [*batch.schema.names[1:], *COUNTS])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text"), F.col(id).alias("doc_id"), *carry)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kept}, " + ", ".join(f"{c} long" for c in COUNTS))
