import hashlib
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from strayline.llm import exact_dedup, queries, simhash_bk

from ..compare import assert_same, duck
from .conftest import edge_rows


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_is_its_sql(spark, sf_dir):
    assert_same(queries.op4_exact_dedup(spark, sf_dir).toPandas(), duck(sf_dir).execute(queries.OP4_SQL).df())


@pytest.mark.parametrize("hot", [2, 64])
@pytest.mark.parametrize("capacity", [2, 2048])
def test_exact_edges(edges, capacity, hot, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot)
    found = exact_dedup.build_index(edges, capacity=capacity).toPandas()
    rows = edge_rows()
    assert len(found) == len(rows)
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    of = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for sha, own in found.groupby("text_sha256"):
        ids = of[sha]
        assert len(own) == len(ids) and (own["group_size"] == len(ids)).all()
        known = [i for i in ids if i is not None]
        assert own["keep_id"].dropna().unique().tolist() == ([min(known)] if known else [])
        kept = own[own["kept"]]
        assert len(kept) == 1 and (not known or kept["doc_id"].iloc[0] == min(known))
    sizes = found.groupby("bucket")["text_sha256"].nunique()
    assert (sizes <= max(capacity, 1)).all()


def test_directory_covers_all_slots(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    slots, depth = exact_dedup.directory(keys, 100)
    rows = slots.toPandas()
    assert sorted(rows["slot"]) == list(range(1 << depth))
    for bucket, own in rows.groupby("bucket"):
        assert len(own) == 1 << (depth - own["local_depth"].iloc[0]) and own["slot"].min() == bucket
    counted = keys.withColumn("slot", exact_dedup.slot_of(F.col("key"), depth)).join(slots, "slot").groupBy("bucket").count().toPandas()
    assert counted["count"].max() <= 100


def test_collisions_are_chained(spark, monkeypatch):
    """All texts get one key: their bytes alone tell them apart."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    docs = spark.createDataFrame([(i, f"text {i % 4}") for i in range(20)], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "MAX_DEPTH", 3)
    found = exact_dedup.annotate(docs)[0].toPandas()
    assert (found["group_size"] == 5).all() and found["kept"].sum() == 4
    assert sorted(found["chain"].unique()) == [1, 2, 3, 4]


def test_exact_keeps_columns_and_takes_nothing(edges, nothing):
    kept = exact_dedup.deduplicate(edges)
    assert kept.columns == edges.columns
    assert kept.count() == len({norm(r[1]) for r in edge_rows()})
    assert exact_dedup.build_index(nothing).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.annotate(edges)


def brute_print(t, k=4):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", w)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, radius=4):
    prints = np.array(prints, np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= radius
    label = np.arange(len(prints))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    out = pd.Series(ids, dtype="float").groupby(label).transform("min")
    return out.tolist()


def test_fingerprints_and_components(documents):
    found = simhash_bk.near_duplicates(documents).toPandas()
    texts = documents.toPandas().set_index("doc_id")["text"]
    assert [int(f, 16) for f in found["fingerprint"]] == [brute_print(texts[i]) for i in found["doc_id"]]
    assert found["component_id"].tolist() == brute_components([int(f, 16) for f in found["fingerprint"]], found["doc_id"].tolist())


def test_simhash_edges(edges, nothing):
    found = simhash_bk.near_duplicates(edges).toPandas()
    rows = edge_rows()
    assert len(found) == len(rows)
    expected = sorted((f"{brute_print(r[1]):016x}", -1 if r[0] is None else r[0]) for r in rows)
    assert sorted((f, -1 if pd.isna(i) else int(i)) for f, i in zip(found["fingerprint"], found["doc_id"])) == expected
    assert (found.loc[found["fingerprint"] == "0" * 16, "component_id"] == 0).all()
    assert simhash_bk.near_duplicates(nothing).count() == 0
    kept = simhash_bk.representatives(edges)
    assert kept.columns == edges.columns and kept.filter("doc_id is null").count() == 2


def clusters(seed, centres=30, size=25):
    r = np.random.default_rng(seed)
    out = []
    for c in r.integers(0, 2**63, centres, dtype=np.uint64):
        own = [c]
        for _ in range(size):
            x = own[r.integers(len(own))]
            for b in r.integers(0, 64, r.integers(1, 6)):
                x = x ^ np.uint64(1 << int(b))
            own.append(x)
        out += own
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("block,shard", [(7, 64), (4096, 64), (4096, 1e-3), (50, 1e-9)])
def test_no_link_is_lost_whatever_the_blocks(spark, block, shard, monkeypatch):
    monkeypatch.setattr(simhash_bk, "SHARD", shard)
    prints = clusters(block)
    entries = spark.createDataFrame([(int(x), i) for i, x in enumerate(prints.view(np.int64))], "fp long, low long")
    found = simhash_bk.components(entries, simhash_bk.links(entries.select("fp"), block=block))
    label = {r.fp: r.component_id for r in found.collect()}
    got = [label.get(int(x), i) for i, x in enumerate(prints.view(np.int64))]
    assert got == brute_components(prints, list(range(len(prints))))


def test_long_chains_are_one_component(spark):
    """Neighbours of a chain whose fingerprints are in no order, as of successive revisions."""
    chain = np.random.default_rng(0).permutation(1000).tolist()
    entries = spark.createDataFrame([(x, i) for i, x in enumerate([*chain, 2000, 2001])], "fp long, low long")
    pairs = spark.createDataFrame([*zip(chain, chain[1:]), (2000, 2001)], "a long, b long")
    found = {r.fp: r.component_id for r in simhash_bk.components(entries, pairs).collect()}
    assert found == {**dict.fromkeys(chain, 0), 2000: 1000, 2001: 1000}


def test_larger_corpora_get_more_choices():
    assert len(simhash_bk.tables(10_000)) == 5
    assert len(simhash_bk.tables(15_000_000)) == 15
    assert len(simhash_bk.tables(30_000_000_000)) == 70
    for n in (100, 15_000_000, 10**12):
        for bands in simhash_bk.tables(n):
            assert sum(w for _, w in bands) <= 62


def test_trees_find_what_is_near():
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(0, 2**14, 800).astype(np.uint64))
    tree = np.sort(r.integers(0, 5, len(keys)))
    root, parent, edge = simhash_bk.build(keys, tree)
    for child in np.flatnonzero(parent >= 0):
        assert np.bitwise_count(keys[child] ^ keys[parent[child]]) == edge[child]
        assert tree[child] == tree[parent[child]]
    start = root[np.searchsorted(tree[root], tree)]
    found = {(int(a), int(b)) for q, k in simhash_bk.search(keys, root, parent, edge, keys, start, 3) for a, b in zip(q, k)}
    near = np.bitwise_count(keys[:, None] ^ keys[None]) <= 3
    assert found == {(a, b) for a, b in np.argwhere(near & (tree[:, None] == tree[None])).tolist()}


def test_forests_connect_with_small_degrees():
    label = np.repeat([0, 1], [500, 3])
    a, b = simhash_bk.forest(np.arange(503).astype(np.uint64), label)
    assert len(a) == 501
    degree = np.bincount(np.r_[a, b].astype(int))
    assert degree.max() <= simhash_bk.DEGREE + 1
