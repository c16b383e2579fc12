import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strayline.llm import common, suffix_tree
from strayline.llm.common import bucketed
from strayline.llm.packing import pack, pack_words, unpack, unpack_words

from .conftest import edge_rows, sentences


def tokens(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def brute_base(rows):
    count = Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(count.values()), len(count)
    out = {}
    for i, t in rows:
        ts = tokens(t)
        out.setdefault((i, t), (held(i), len(ts), sum(count[x] > 0 for x in ts), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts)))
    return out


def check_base(found, rows):
    expected = sorted((-1 if i is None else i, *v) for (i, t), v in brute_base(rows).items() for _ in range(sum(r == (i, t) for r in rows)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert [g[5] for g in got] == pytest.approx([e[5] for e in expected])


def test_base_is_brute_force(documents):
    found = suffix_tree.score(documents).collect()
    check_base(found, [(r.doc_id, r.text) for r in documents.collect()])
    assert all(r.score < 0 for r in found)


def test_edges(edges, nothing):
    check_base(suffix_tree.score(edges).collect(), [(r[0], r[1]) for r in edge_rows()])
    assert suffix_tree.score(nothing).count() == 0


class BruteTree:
    """The tree of training texts, one context at a time."""

    def __init__(self, texts):
        self.count, self.follow = Counter(), {}
        for t in texts:
            ts = tokens(t)
            self.count.update(ts)
            for i, x in enumerate(ts):
                for k in range(1, min(i, suffix_tree.DEPTH) + 1):
                    self.follow.setdefault(tuple(ts[i - k : i]), Counter())[x] += 1
        self.unit = sum(self.count.values()) + 0.5 * (len(self.count) + 1)
        self.state = {}
        for c in sorted((c for c, f in self.follow.items() if sum(f.values()) >= suffix_tree.MIN_CONTEXT), key=len):
            total, stored, rest = self.parts(c)
            q = {s: self.p(s, c[1:]) for s in stored}
            p = {s: n / (total + suffix_tree.KAPPA) + rest * q[s] for s, n in stored.items()}
            gain = sum(p[s] * math.log(p[s] / q[s]) for s in stored) + rest * max(0, 1 - sum(q.values())) * math.log(rest)
            self.state[c] = gain >= suffix_tree.MIN_DIVERGENCE

    def parts(self, c):
        follow = self.follow[c]
        total = sum(follow.values())
        stored = {s: n for s, n in follow.items() if n >= suffix_tree.MIN_JOINT}
        return total, stored, (total - sum(stored.values()) + suffix_tree.KAPPA) / (total + suffix_tree.KAPPA)

    def p(self, s, c):
        """Of a symbol after a context, by its longest retained suffix."""
        while c and not self.state.get(c):
            c = c[1:]
        if not c:
            return (self.count[s] + 0.5) / self.unit
        total, stored, rest = self.parts(c)
        return stored.get(s, 0) / (total + suffix_tree.KAPPA) + rest * self.p(s, c[1:])

    def score(self, t):
        ts = tokens(t)
        return sum(math.log10(self.p(x, tuple(ts[max(0, i - suffix_tree.DEPTH) : i]))) for i, x in enumerate(ts))


PIECES = ["red fish", "blue fish", "one", "two", "red hen", "the big red fish swims"]


@pytest.fixture(scope="module")
def corpus():
    texts = sentences(250, PIECES, 3)
    return [*enumerate(texts), (0, texts[0]), (0, texts[0]), (900, None), (901, "Zebra zebra RED"), (902, "zebra yak"), (903, "gnu red hen")]


@pytest.fixture(scope="module")
def brute(corpus):
    return BruteTree([t for i, t in corpus if not held(i)])


# A block for all texts or for a few; no hot context, some, or all of them.
@pytest.mark.parametrize("bounds", [{}, {"block_bytes": 600, "part_tokens": 200}, {"block_bytes": 600, "part_tokens": 200, "hot": 100}, {"block_bytes": 3000, "part_tokens": 50, "hot": 3}, {"hot": 1}])
def test_texts_are_scored_by_the_tree(spark, corpus, brute, bounds, monkeypatch):
    """Whatever a task holds, parts together are the tree of the training texts; rows that repeat teach as often as they are there."""
    monkeypatch.setattr(common, "BATCH_ROWS", 20)
    found = suffix_tree.score(spark.createDataFrame(corpus, "doc_id long, text string"), **bounds).collect()
    text = dict(corpus)
    assert sorted(r.doc_id for r in found) == sorted(i for i, _ in corpus)
    assert [r.score for r in found] == pytest.approx([brute.score(text[r.doc_id]) for r in found], rel=1e-6)
    check_base(found, corpus)


def test_hot_contexts_are_of_all_lengths(brute):
    for k in range(1, suffix_tree.DEPTH + 1):
        sizes = [sum(f.values()) for c, f in brute.follow.items() if len(c) == k]
        assert max(sizes) >= 100 and any(s == k for s in map(len, (c for c, on in brute.state.items() if on)))


def test_states_sum_to_one(brute):
    known = list(brute.count)
    for c, on in brute.state.items():
        if on:
            assert sum(brute.p(s, c) for s in known) + brute.p("?", c) == pytest.approx(1, abs=1e-9)


def test_structure_beats_single_words(brute):
    texts = sentences(40, ["red fish", "the big red fish swims", "one"], 99)
    plain = sum(math.log10((brute.count[x] + 0.5) / brute.unit) for t in texts for x in tokens(t))
    assert sum(map(brute.score, texts)) > plain + 0.05 * sum(len(tokens(t)) for t in texts)


def test_what_is_kept_does_not_shrink(spark, corpus):
    """Texts score alike per context, whatever else the corpus holds: what occurs twice is kept."""
    pair = [(2000, "quick wombat digs here"), (2002, "quick wombat digs here")]
    other = [(3000 + i, t) for i, t in enumerate(sentences(2000, ["sun", "moon", "tide", "sand"], 8))]
    assert not any(held(i) for i, _ in pair)
    for rows in (corpus + pair, corpus + pair + other):
        found = {r.doc_id: r for r in suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert found[2000].score > 0.5 * found[2000].base_score


def test_blocks_are_not_shuffled_again(spark, corpus, monkeypatch):
    """Blocks lie where their groups are asked for, and the catalog is left as it was."""
    monkeypatch.setattr(common, "BATCH_ROWS", 20)
    before = {t.name for t in spark.catalog.listTables()}
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    blocks = bucketed(suffix_tree.encoded(docs, "doc_id", "text", 5, 1, 600), "block", 4, "blocks")
    plan = blocks.groupBy("block").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert blocks.count() > 4 and {t.name for t in spark.catalog.listTables()} == before


def test_arrays_come_back():
    arrays = [np.array([], np.int64), np.array([5, 5, 5]), np.array([-3, 0, 2**40]), np.array([1.5, -2.25]), np.arange(300, dtype=np.int32), np.array([0.1], np.float32)]
    for a, b in zip(arrays, unpack(pack(*arrays))):
        assert a.tolist() == b.tolist()
    names = np.array(["b", "", "\x00é", "c"], object)
    assert unpack_words(pack_words(names)).to_pylist() == names.tolist()
