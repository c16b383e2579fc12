import re

import pytest
from pyspark.sql import functions as F

from strayline.llm import mixing, queries

from ..compare import assert_same, duck
from .conftest import edge_rows


def test_mix_is_its_sql(spark, sf_dir):
    assert_same(queries.op6_mix_sources(spark, sf_dir).toPandas(), duck(sf_dir).execute(queries.OP6_SQL).df())


def brute_targets(sizes, weights=(3, 1, 2)):
    """By rounds: who is above twice its size stops there, and the rest is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, list(names)
    left = 1.5 * sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] >= 2 * sizes[s]]
        if not over:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_edges(edges, nothing):
    found = mixing.plan(edges).toPandas()
    rows = edge_rows()
    assert len(found) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(found["size"]) == sorted(size(r[1]) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    target = brute_targets(sizes)
    for source, own in found.groupby(found["source"].fillna("<null>")):
        name = None if source == "<null>" else source
        assert own["target"].iloc[0] == pytest.approx(target[name])
        assert own["source_size"].iloc[0] == sizes[name]
        # Rows that repeat the cut may lose a word each.
        assert abs(own["taken"].sum() - round(target[name])) <= 2
    assert (found["taken"] <= 2 * found["size"]).all() and (found["taken"] >= 0).all()
    assert mixing.plan(nothing).count() == 0
    assert mixing.mixed(nothing).count() == 0


def test_reruns_agree_and_rows_follow_the_plan(spark, documents):
    a = mixing.plan(documents).select("doc_id", "taken").orderBy("doc_id").collect()
    assert a == mixing.plan(documents.repartition(7)).select("doc_id", "taken").orderBy("doc_id").collect()
    rows = mixing.mixed(documents)
    assert rows.columns == documents.columns
    got = {r.doc_id: r.n for r in rows.groupBy("doc_id").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert got == {r.doc_id: r.taken for r in a if r.taken}


@pytest.mark.parametrize("seed", range(4))
def test_many_sources(spark, seed):
    import random

    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.choice([1, 1, 1, 30]) for _ in range(r.choice([0, 1, 5, 200]))), f"s{min(9, int(r.expovariate(0.4)))}") for i in range(600)]
    found = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    sizes = found.groupby("source")["size"].sum().to_dict()
    target = brute_targets(sizes)
    for source, own in found.groupby("source"):
        assert own["target"].iloc[0] == pytest.approx(target[source])
        # Budgets are whole words.
        assert abs(own["taken"].sum() - target[source]) <= 0.5
        assert (own["taken"] <= 2 * own["size"]).all()


def test_words_at_the_border_of_a_bin(spark, monkeypatch):
    """Cuts may fall between two bins, on a row, or inside one."""
    monkeypatch.setattr(mixing, "BIN_ROWS", 1)
    rows = [(i, "w " * (1 + i % 3), "abc"[i % 3]) for i in range(90)]
    found = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, own in found.groupby("source"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 0.5
