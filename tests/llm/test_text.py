import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from strayline.llm import text_stats
from strayline.llm.common import per_text, words

from .conftest import edge_rows

ODD = st.text(st.sampled_from("ab \t\n\x0b\x0c\r\x1c\x85\xa0éA#|"), max_size=25)


def plain_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), ODD), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    codes, offsets, known = words(pa.array(texts, pa.string()))
    known = known.to_pylist()
    assert [[known[c] for c in codes[a:b]] for a, b in zip(offsets, offsets[1:])] == [plain_words(t) for t in texts]
    assert per_text(np.ones(len(codes)), offsets).tolist() == [len(plain_words(t)) for t in texts]


def brute_counts(t):
    t = t or ""
    w = plain_words(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if plain_words(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for x in w for c in x), "n_dup_lines": dup, "n_repeat_words": len(hit)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), ODD, st.text("ab \n", max_size=40)), max_size=6))
def test_counts_are_brute_force(texts):
    found = text_stats.counts(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        for k, v in brute_counts(t).items():
            assert found[k][i] == v, (k, t)


def test_counts_of_edge_rows():
    texts = [r[1] for r in edge_rows() if not r[1] or len(r[1]) < 10_000]
    found = text_stats.counts(pa.array(texts, pa.string()))
    assert [found["n_words"][i] for i in range(len(texts))] == [len(plain_words(t)) for t in texts]
    assert set(found) == set(text_stats.COUNTS)
