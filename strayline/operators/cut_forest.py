"""Random cut forests over tables: sample, build, and question without shuffling queries.

A tree is built from its sample top-down. A node's box draws a cut: the dimension by its
share of the box's sides, the value uniform in it; rows up to the value go left. Equal
rows make one leaf. Samples have at most ``capacity`` rows, so a tree is built in one call
of a grouped pandas function, all trees at once. The forest is at most num_trees * (2 *
capacity - 1) nodes whatever the stream's length: that bounds its broadcast, and scoring is
one pass over the queries, vectorised over them, with no shuffle.

Answers are those of the sequential engine for the same trees: scores, displacement,
attribution, density, neighbours, imputation and extrapolation. Draws come from a hash of
the seed, the tree and the node's path, so a rebuild gives the same forest.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotReadyError
from ..functions import hashing
from ..params import ForestParams
from . import reservoir

NODES = "tree int, path string, depth int, cut_dim int, cut_val double, low array<double>, high array<double>, mass int, is_leaf boolean"
#: The largest forest that is broadcast: numbers in its nodes.
MOST_NUMBERS = 200_000_000
#: Points that go down a tree together, so that they stay in the processor's cache.
ROWS = 2048


def spread(df: DataFrame) -> DataFrame:
    """A table read in fewer pieces than there are cores is dealt out to them; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def build_tree(points: np.ndarray, seed: int, tree: int) -> list[tuple]:
    """Nodes of the tree over points, parents first."""
    out, going = [], [("", np.arange(len(points)))] if len(points) else []
    while going:
        path, rows = going.pop()
        own = points[rows]
        low, high = own.min(axis=0), own.max(axis=0)
        sides = high - low
        ends = np.cumsum(sides)
        leaf = bool(ends[-1] <= 0)
        dim, value = -1, 0.0
        if not leaf:
            at = hashing.uniform_of(seed, "cut", tree, path) * ends[-1]
            dim = int(np.searchsorted(ends, at, "right"))
            value = low[dim] + (at - (ends[dim - 1] if dim else 0.0))
            value = float(min(max(value, low[dim]), np.nextafter(high[dim], -np.inf)))
            left = own[:, dim] <= value
            going += [(path + "1", rows[~left]), (path + "0", rows[left])]
        out.append((tree, path, len(path), dim, value, low.tolist(), high.tolist(), len(rows), leaf))
    return out


def build(samples: DataFrame, params: ForestParams, vector: str = "vec") -> DataFrame:
    """NODES of all trees, from rows of tree and vector."""
    seed = params.seed or 0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.array(pdf["v"].tolist(), np.float64)
        # The order rows arrive in must not matter.
        return pd.DataFrame(build_tree(points, seed, int(pdf["tree"].iloc[0])), columns=[c.split()[0] for c in NODES.split(", ")])

    return samples.select("tree", F.col(vector).alias("v")).groupBy("tree").applyInPandas(run, NODES)


@dataclass
class Tree:
    """One tree as arrays; node 0 is the root, children -1 at leaves."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray
    mass: np.ndarray
    depth: np.ndarray

    def __post_init__(self) -> None:
        self.width = (self.high - self.low).sum(axis=1)

    @property
    def total(self) -> int:
        return int(self.mass[0])

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Tree:
        rows = rows.sort_values(["depth", "path"])
        place = {p: i for i, p in enumerate(rows["path"])}
        child = lambda s: np.array([place.get(p + s, -1) for p in rows["path"]])
        box = lambda c: np.array(rows[c].tolist(), np.float64)
        return cls(rows["cut_dim"].to_numpy(), rows["cut_val"].to_numpy(float), child("0"), child("1"), box("low"), box("high"), rows["mass"].to_numpy(), rows["depth"].to_numpy())

    def probability(self, node: np.ndarray, x: np.ndarray) -> np.ndarray:
        # How far outside the box; a point is never on both sides of it.
        out = np.maximum(self.low.take(node, axis=0) - x, x - self.high.take(node, axis=0))
        excess = np.maximum(out, 0, out=out).sum(axis=1)
        # No excess gives 0, and a box without sides 1.
        return np.divide(excess, self.width.take(node) + excess, out=np.zeros(len(x)), where=excess > 0)

    def descend(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """At each level (rows still above a leaf, their nodes, their cut probabilities, their weights), then the leaves."""
        node, weight, rows = np.zeros(len(x), np.int64), np.ones(len(x)), np.arange(len(x))
        while True:
            rows = rows[self.left[node[rows]] >= 0]
            if not len(rows):
                break
            own = node[rows]
            p = self.probability(own, x[rows])
            yield rows, own, p, weight[rows]
            weight[rows] *= 1 - p
            goes_left = x[rows, self.dim[own]] <= self.cut[own]
            node[rows] = np.where(goes_left, self.left[own], self.right[own])
        yield np.arange(len(x)), node, None, weight

    def score(self, x: np.ndarray, displacement: bool = False) -> np.ndarray:
        total = np.zeros(len(x))
        for rows, node, p, weight in self.descend(x):
            mass, depth = self.mass[node], self.depth[node]
            unseen = mass if displacement else 1 / (depth + 1.0)
            if p is not None:
                total[rows] += weight * p * unseen
            else:
                same = (self.low[node] == x).all(axis=1)
                seen = 1 / (1.0 + mass) if displacement else 1 / (depth + np.log2(1.0 + mass))
                total += weight * np.where(same, (1 - mass / (2 * self.total)) * seen, unseen)
        return total / (1 + self.total) if displacement else total * math.log2(1 + self.total)

    def density(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for rows, node, p, weight in self.descend(x):
            if p is not None:
                total[rows] += weight * p * self.mass[node]
            else:
                total += weight * np.where((self.low[node] == x).all(axis=1), self.mass[node], 0)
        return total

    def attribute(self, x: np.ndarray, out: np.ndarray) -> None:
        """Adds to out (rows x dims x below, above)."""
        norm = math.log2(1 + self.total)
        for rows, node, p, weight in self.descend(x):
            if p is not None:
                dim = self.dim[node]
                above = (x[rows, dim] <= self.cut[node]).astype(int)
                np.add.at(out, (rows, dim, above), weight * p * norm / (self.depth[node] + 1.0))

    def neighbours(self, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs that rows come to; a row may come to several leaves or none."""
        out, row, node = [], np.arange(len(x)), np.zeros(len(x), np.int64)
        while len(row):
            leaf = self.left[node] < 0
            out.append((row[leaf], node[leaf]))
            row, node = row[~leaf], node[~leaf]
            p = self.probability(node, x[row])
            on = (p > threshold) | (self.depth[node] == 0)
            row, node, p = row[on], node[on], p[on]
            goes_left = x[row, self.dim[node]] <= self.cut[node]
            near, far = np.where(goes_left, self.left[node], self.right[node]), np.where(goes_left, self.right[node], self.left[node])
            both = p > 0.5
            row, node = np.r_[row, row[both]], np.r_[near, far[both]]
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def closest(self, x: np.ndarray) -> np.ndarray:
        """For each row the nearest leaf over its known dimensions (not NaN); of equals the leftmost."""
        known = ~np.isnan(x)
        best, distance, rank = np.full(len(x), -1), np.full(len(x), np.inf), np.full(len(x), np.inf)
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        order = self.leaf_order()
        while len(row):
            leaf = self.left[node] < 0
            r, n = row[leaf], node[leaf]
            if len(r):
                d = np.where(known[r], np.abs(self.low[n] - np.nan_to_num(x[r])), 0).sum(axis=1)
                first = np.lexsort((order[n], d, r))
                first = first[np.r_[True, r[first][1:] != r[first][:-1]]]
                r, n, d = r[first], n[first], d[first]
                better = (d < distance[r]) | ((d == distance[r]) & (order[n] < rank[r]))
                r, n, d = r[better], n[better], d[better]
                best[r], distance[r], rank[r] = n, d, order[n]
            row, node = row[~leaf], node[~leaf]
            dim = self.dim[node]
            open_ = ~known[row, dim]
            goes_left = np.where(open_, True, np.nan_to_num(x[row, dim]) <= self.cut[node])
            row, node = np.r_[row, row[open_]], np.r_[np.where(goes_left, self.left[node], self.right[node]), self.right[node][open_]]
        return best

    def leaf_order(self) -> np.ndarray:
        out, going, n = np.zeros(len(self.dim)), [0], 0
        while going:
            node = going.pop()
            if self.left[node] < 0:
                out[node] = n
                n += 1
            else:
                going += [self.right[node], self.left[node]]
        return out


@dataclass
class FrozenForest:
    """A built forest, bounded by its parameters, that questions are put to."""

    params: ForestParams
    trees: dict[int, Tree]
    buffer: np.ndarray | None = None

    @classmethod
    def collect(cls, nodes: DataFrame, params: ForestParams, buffer: np.ndarray | None = None) -> FrozenForest:
        numbers = params.num_trees * 2 * params.capacity * 2 * params.dim
        if numbers > MOST_NUMBERS:
            raise ValueError(f"a forest of up to {numbers} numbers is too large to broadcast; lower num_trees, capacity or dimensions")
        rows = nodes.toPandas()
        return cls(params, {int(t): Tree.of(own) for t, own in rows.groupby("tree")}, buffer)

    def _ask(self, queries: DataFrame, vector: str, schema: str, answer) -> DataFrame:
        """queries with more columns; answer(trees, points) gives them for a batch."""
        spec = queries.sparkSession.sparkContext.broadcast(list(self.trees.values()))
        dim = self.params.dim
        names = [x.strip().split()[0] for x in schema.split(";")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), ROWS):
                    part = pdf.iloc[at : at + ROWS]
                    yield part.assign(**dict(zip(names, answer(spec.value, matrix(part[vector], dim)))))

        own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
        return queries.mapInPandas(run, f"{own}, {schema.replace(';', ',')}")

    def score(self, queries: DataFrame, vector: str = "vec", name: str = "score") -> DataFrame:
        return self._ask(queries, vector, f"{name} double", lambda trees, x: [_mean([t.score(x) for t in trees], x)])

    def displacement_score(self, queries: DataFrame, vector: str = "vec", name: str = "displacement") -> DataFrame:
        return self._ask(queries, vector, f"{name} double", lambda trees, x: [_mean([t.score(x, True) for t in trees], x)])

    def density(self, queries: DataFrame, vector: str = "vec", name: str = "density") -> DataFrame:
        """Small where the forest is full and large far from it, as its formula has it."""
        return self._ask(queries, vector, f"{name} double", lambda trees, x: [_mean([t.density(x) for t in trees], x)])

    def attribution(self, queries: DataFrame, vector: str = "vec", name: str = "attribution") -> DataFrame:
        def answer(trees: list[Tree], x: np.ndarray) -> list:
            out = np.zeros((*x.shape, 2))
            for t in trees:
                t.attribute(x, out)
            out /= max(1, len(trees))
            return [[[{"below": float(b), "above": float(a)} for b, a in row] for row in out]]

        return self._ask(queries, vector, f"{name} array<struct<below: double, above: double>>", answer)

    def near_neighbors(self, queries: DataFrame, top_k: int = 10, percentile: int = 50, vector: str = "vec", name: str = "neighbors") -> DataFrame:
        def answer(trees: list[Tree], x: np.ndarray) -> list:
            found: list[dict[tuple, list[float]]] = [{} for _ in x]
            for t in trees:
                row, leaf = t.neighbours(x, percentile / 100)
                score = math.log2(1 + t.total) / (t.depth[leaf] + 1.0)
                distance = np.abs(t.low[leaf] - x[row]).sum(axis=1)
                for r, n, s, d in zip(row, leaf, score, distance):
                    own = found[r].setdefault(tuple(t.low[n]), [0.0, d])
                    own[0] += s
                    own[1] = min(own[1], d)
            n = max(1, len(trees))
            rank = lambda e: (math.isnan(e[1][1]), e[1][1], e[0])
            return [[[{"score": float(s / n), "point": [float(v) for v in p], "distance": float(d)} for p, (s, d) in sorted(own.items(), key=rank)[:top_k]] for own in found]]

        return self._ask(queries, vector, f"{name} array<struct<score: double, point: array<double>, distance: double>>", answer)

    def impute(self, queries: DataFrame, vector: str = "vec", name: str = "imputed") -> DataFrame:
        """Nulls of each vector filled by the median over trees of their nearest leaf."""
        if not self.trees:
            raise NotReadyError("the forest has no tree")
        return self._ask(queries, vector, f"{name} array<double>", lambda trees, x: [[r.tolist() for r in fill(trees, x)]])

    def extrapolate(self, look_ahead: int) -> list[float]:
        """From the buffer as it stands: the newest place from the others, then the one before it, and so on."""
        p = self.params
        if not p.internal_shingling or p.shingle_size <= 1:
            raise ValueError("extrapolation needs internal shingling and a shingle_size above 1")
        if not 0 <= look_ahead <= p.shingle_size:
            raise ValueError("look_ahead must be from 0 to shingle_size")
        if not self.trees or self.buffer is None:
            raise NotReadyError("the forest has no tree or no buffer")
        now, out = np.array(self.buffer, np.float64), []
        for step in range(look_ahead):
            a = p.dim - (step + 1) * p.input_dim
            asked = now.copy()
            asked[a : a + p.input_dim] = np.nan
            now = fill(list(self.trees.values()), asked[None])[0]
            out += now[a : a + p.input_dim].tolist()
        return out

    def save(self, spark: SparkSession, nodes: DataFrame, path: str) -> None:
        nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        head = {"params": self.params.to_dict(), "buffer": None if self.buffer is None else list(map(float, self.buffer))}
        spark.createDataFrame([(json.dumps(head),)], "head string").coalesce(1).write.mode("overwrite").json(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FrozenForest:
        head = json.loads(spark.read.schema("head string").json(f"{path}/head").first()[0])
        buffer = None if head["buffer"] is None else np.array(head["buffer"])
        return cls.collect(spark.read.parquet(f"{path}/nodes"), ForestParams.from_dict(head["params"]), buffer)


def matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    """Points as rows; NaN where a number is null."""
    try:
        return np.array(np.stack(vectors.to_list()), np.float64).reshape(-1, dim)
    except (TypeError, ValueError):
        return np.array([[np.nan if v is None else v for v in p] for p in vectors], np.float64).reshape(-1, dim)


def _mean(values: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.mean(values, axis=0) if values else np.zeros(len(x))


def fill(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    leaves = np.array([t.low[t.closest(x)] for t in trees])
    return np.where(np.isnan(x), np.median(leaves, axis=0), x)


def fit(rows: DataFrame, params: ForestParams, seq: str = "seq", vector: str = "vec", fast: bool = False) -> tuple[FrozenForest, DataFrame]:
    """The forest over the samples of rows, and its nodes. rows: seq from 1 and whole points."""
    nodes = build(reservoir.sample(rows.select(seq, vector), params, seq, fast), params, vector)
    return FrozenForest.collect(nodes, params), nodes
