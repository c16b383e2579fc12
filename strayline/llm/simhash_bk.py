"""SimHash near-duplicates by BK-trees.

A text's fingerprint has a bit where more than half of the XXH64 (seed 42) of its
word shingles have one. Fingerprints within ``RADIUS`` bits link; a component's id
is the smallest document id in it.

Two fingerprints within r bits agree in m of r + m bands, so every choice of m bands
and their value names a shard, and no link crosses all shards. m is the smallest with
which a shard of evenly spread fingerprints has at most ``SHARD`` entries; a larger
corpus gets more choices of longer values, not larger shards. A shard's tree has children keyed
by their Hamming distance to the parent; a query at distance d from a node follows
only edges from d - r to d + r. Trees of all shards in a task are built and searched
together, a level at a time, in numpy. Equal fingerprints are one entry from the
start. A shard over ``BLOCK`` entries is cut into blocks: each block's tree is sent
to the tasks of the blocks that query it, so a shard never has to fit in one task.

A shard hands on no pairs but a tree of bounded degree over each of its components,
which connects the same fingerprints with at most one edge for each entry.
Components of all shards join by contraction over checkpointed tables: each label goes
to the one of the lowest rank around it, then to where that one goes, and the pairs are
those of the new labels, until none is left. Ranks are hashes that change every round,
so that a label that has neighbours goes on with a chance of a half or more and rounds
grow with the logarithm of a component's size, whatever its form.

Null and empty texts have fingerprint zero, which links like any other. An empty
table gives an empty result; rows that repeat an id are all returned; a null id
takes part and is the smallest only where nothing else is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, words

SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCK = 4096
DEGREE = 16
#: Entries of a shard, and of the shards that one Python call gets together, if spread evenly.
SHARD = 64
TOGETHER = 2048


def fingerprint(tokens: list[bytes], k: int = SHINGLE) -> int:
    """Of one text's words."""
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= k:
        return xxhash.xxh64_intdigest(line, SEED)
    starts = [0]
    for t in tokens:
        starts.append(starts[-1] + len(t) + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, starts[k:])], np.uint64)
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    # Sums of eight bits at a time: bit j of every byte goes to its own byte lane.
    n, counts = len(hashes), np.zeros(64, np.int64)
    lanes = np.uint64(0x0101010101010101)
    for j in range(8):
        lane = (hashes >> np.uint64(j)) & lanes
        full = n // 255 * 255
        total = np.zeros(8, np.int64)
        if full:
            sums = np.add.reduce(lane[:full].reshape(-1, 255), axis=1, dtype=np.uint64)
            total += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        if full < n:
            total += np.add.reduce(lane[full:], dtype=np.uint64).reshape(1).view(np.uint8).astype(np.int64)
        counts[np.arange(8) * 8 + j] = total
    return int(sum(1 << b for b in range(64) if 2 * counts[b] > n))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint((t or "").encode().lower().split(), k) for t in batch.column(1).to_pylist()]
            fp = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def build(keys: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees over keys, one for each value of tree (sorted): (roots of the trees, parent and edge of each key; -1 at a root).

    All keys go down together: of those at the same parent with the same distance to it the first becomes the child.
    """
    n = len(keys)
    parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    root = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if n else np.zeros(0, np.int64)
    at = root[np.cumsum(np.r_[True, tree[1:] != tree[:-1]]) - 1] if n else root
    going = np.setdiff1d(np.arange(n), root, assume_unique=True)
    at = at[going]
    while len(going):
        d = distance(keys[going], keys[at]).astype(np.int64)
        place = at * 65 + d
        _, first, which = np.unique(place, return_index=True, return_inverse=True)
        child = going[first]
        parent[child], edge[child] = at[first], d[first]
        on = going != child[which]
        at, going = child[which][on], going[on]
    return root, parent, edge


def search(keys: np.ndarray, root: np.ndarray, parent: np.ndarray, edge: np.ndarray, queries: np.ndarray, start: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, key) positions within the radius, from each query's root on; only edges that can lead there are followed."""
    order = np.lexsort((edge, parent))
    order = order[parent[order] >= 0]
    place = parent[order] * 65 + edge[order]
    for begin in range(0, len(queries), 1 << 14):
        q = np.arange(begin, min(begin + (1 << 14), len(queries)))
        node = start[q]
        while len(q):
            d = distance(queries[q], keys[node]).astype(np.int64)
            hit = d <= radius
            yield q[hit], node[hit]
            low = np.searchsorted(place, node * 65 + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(place, node * 65 + np.minimum(d + radius, 64), "right")
            n = high - low
            each = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, node = np.repeat(q, n), order[each]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position in the component of each position."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def forest(keys: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of trees of degree DEGREE + 1 over the positions of each label."""
    order = np.lexsort((keys, label))
    lab = label[order]
    first = np.flatnonzero(np.r_[True, lab[1:] != lab[:-1]])
    rank = np.arange(len(lab)) - np.repeat(first, np.diff(np.r_[first, len(lab)]))
    child = np.flatnonzero(rank > 0)
    up = child - rank[child] + (rank[child] - 1) // DEGREE
    return keys[order[child]], keys[order[up]]


def linked(keys: np.ndarray, shard: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is within the radius. shard: sorted; block: 0 for entries of the tree, 1 for those that only query it."""
    tree_at = np.flatnonzero(block == 0)
    names = shard[tree_at]
    root, parent, edge = build(keys[tree_at], names)
    place = np.searchsorted(names[root], shard)
    known = (place < len(root)) & (names[root[np.minimum(place, len(root) - 1)]] == shard) if len(root) else np.zeros(len(shard), bool)
    asks = np.flatnonzero(known)
    found = [(asks[q], tree_at[k]) for q, k in search(keys[tree_at], root, parent, edge, keys[asks], root[place[asks]], radius)]
    a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
    differ = a != b
    label = _roots(len(keys), a[differ], b[differ])
    return forest(keys, label)


def tables(n: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """For n entries the choices of bands, each band as (shift, width)."""
    match = 1
    while n / 2.0 ** (64 * match / (radius + match)) > SHARD and match < 6:
        match += 1
    k = radius + match
    edges = [64 * i // k for i in range(k + 1)]
    return [[(edges[i], edges[i + 1] - edges[i]) for i in own] for own in combinations(range(k), match)]


def value_of(fp: Column, bands: list[tuple[int, int]]) -> Column:
    """The bits of the bands side by side."""
    out: Column = F.lit(0).cast("long")
    for shift, width in bands:
        out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)))
    return out


def links(entries: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """entries: fp, distinct. Pairs a, b of fingerprints that connect all that link."""
    n = entries.count()
    chosen = tables(n, radius)
    bits = min(sum(w for _, w in bands) for bands in chosen)
    pieces = [F.struct(F.lit(i).alias("band"), value_of(F.col("fp"), bands).alias("value")) for i, bands in enumerate(chosen)]
    rows = entries.select("fp", F.explode(F.array(*pieces)).alias("p")).select("fp", "p.band", "p.value")
    sizes = rows.groupBy("band", "value").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    large = stored(sizes.select("band", "value", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large-shards")
    rows = rows.join(large, ["band", "value"], "left").fillna(1, ["blocks"])
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # Block i's tree is asked by its own entries and those of the blocks after it.
    asked = F.explode(F.sequence(F.lit(0), own))
    rows = rows.withColumn("own", own).withColumn("tree", asked)
    rows = rows.select("fp", "band", "value", "tree", (F.col("own") != F.col("tree")).cast("int").alias("asks"))
    # Neighbouring shards share a call; blocks of a large shard have one each.
    shift = max(0, bits - max(0, n // TOGETHER).bit_length())
    rows = rows.withColumn("together", F.shiftright("value", shift))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("value", "ascending"), ("asks", "ascending"), ("fp", "ascending")])
        keys = table["fp"].to_numpy().view(np.uint64)
        a, b = linked(keys, table["value"].to_numpy(), table["asks"].to_numpy(), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return rows.groupBy("band", "together", "tree").applyInArrow(run, "a long, b long").distinct()


def components(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """entries: fp, low (the smallest id). Returns fp and component_id for those that pairs touch."""
    both = stored(pairs.union(pairs.select("b", "a")).toDF("a", "b").filter("a != b").distinct(), "pairs")
    hooks: list[DataFrame] = []
    while not both.isEmpty():
        step = len(hooks)

        def ranked(name: str) -> Column:
            return F.struct(F.xxhash64(F.col(name), F.lit(step)).alias("rank"), F.col(name).alias("label"))  # noqa: B023

        near = both.groupBy(F.col("a").alias("fp")).agg(F.min(ranked("b")).alias("near"))
        up = stored(near.select("fp", F.least(F.col("near"), ranked("fp"))["label"].alias("up")), f"up-{step}")
        further = up.select(F.col("fp").alias("up"), F.col("up").alias("label"))
        hook = stored(up.join(further, "up").select("fp", "label"), f"hooks-{step}")
        hooks.append(hook)
        both = both.join(hook.toDF("a", "x"), "a").join(hook.toDF("b", "y"), "b")
        both = stored(both.filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"pairs-{step}")
    if not hooks:
        return entries.select("fp", F.col("low").alias("component_id")).limit(0)
    # From the last round back: a label that went on is replaced by where it went.
    label = hooks.pop()
    while hooks:
        on = label.toDF("label", "further")
        label = stored(hooks.pop().join(on, "label", "left").select("fp", F.coalesce("further", "label").alias("label")), f"labels-{len(hooks)}")
    lowest = label.join(entries, "fp").groupBy("label").agg(F.min("low").alias("component_id"))
    return label.join(stored(lowest, "lowest"), "label").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    prints = stored(fingerprints(docs, id, text), "fingerprints")
    entries = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "entries")
    of = components(entries, links(entries.select("fp"), radius, block))
    of = stored(entries.join(of, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")), "components")
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their component, with the columns of docs; rows with a null id stay."""
    found = near_duplicates(docs, id, text)
    drop = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(drop.withColumnRenamed("doc_id", id), id, "left_anti").select(*docs.columns)
