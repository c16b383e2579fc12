"""Time-biased samples of a stream, one for each tree.

At capacity the sample is the rows with the smallest random weights, where later rows
draw smaller ones; so it is a top-k for each tree. The portable form weighs rows with MD5 in
Spark, which cuts them to k a tree in every task before any are shuffled. The fast form
weighs them in numpy with a 64-bit mix and lets a task hand on no more than its own k best
of each tree. Only row numbers are ranked; points are fetched for the rows that stay, at
most num_trees * capacity of them, which bounds the broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, scoring
from ..params import ForestParams


def weighed(rows: DataFrame, params: ForestParams, seq: str = "seq") -> DataFrame:
    """rows for each tree with weight. seq counts rows from 1."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(params.num_trees - 1)))
    out = rows.withColumn("tree", trees)
    u = hashing.uniform(params.seed or 0, "reservoir", F.col("tree"), F.col(seq))
    return out.withColumn("weight", scoring.reservoir_weight(u, params.decay, F.col(seq) - 1))


def draws(seed: int, tree: int, seq: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each row of a tree."""
    with np.errstate(over="ignore"):
        x = seq.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1B54A32D192ED03 + tree * 0x8CB92BA72F3D8DD7) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def _weighed_fast(rows: DataFrame, params: ForestParams, seq: str) -> DataFrame:
    """seq, tree, weight: of each task's rows the ones that can be in a sample."""
    k, seed, decay = params.capacity, params.seed or 0, params.decay

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {t: (np.zeros(0, np.int64), np.zeros(0)) for t in range(params.num_trees)}
        limit = dict.fromkeys(held, np.inf)
        for batch in batches:
            n = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for t in held:
                w = np.log(-np.log(draws(seed, t, n))) - decay * (n - 1)
                near = w <= limit[t]
                if not near.any():
                    continue
                own, weight = np.r_[held[t][0], n[near]], np.r_[held[t][1], w[near]]
                if len(own) > k:
                    best = np.lexsort((own, weight))[:k]
                    own, weight = own[best], weight[best]
                    limit[t] = weight[-1]
                held[t] = own, weight
        for t, (own, weight) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), t, np.int32)), pa.array(weight)], ["seq", "tree", "weight"])

    return rows.select(F.col(seq).cast("long").alias("seq")).mapInArrow(run, "seq long, tree int, weight double")


def sample(rows: DataFrame, params: ForestParams, seq: str = "seq", fast: bool = False) -> DataFrame:
    """The rows in each tree's sample, with tree, weight and rank (1 for the smallest weight)."""
    own = _weighed_fast(rows, params, seq) if fast else weighed(rows.select(F.col(seq).alias("seq")), params)
    smallest = Window.partitionBy("tree").orderBy("weight", "seq")
    best = own.withColumn("rank", F.row_number().over(smallest)).filter(F.col("rank") <= params.capacity)
    best = best.select(F.col("seq").alias(seq), "tree", "weight", "rank")
    return rows.join(F.broadcast(best), seq)


def sample_as_of(rows: DataFrame, params: ForestParams, tick: str, as_of: int, seq: str = "seq", fast: bool = False) -> DataFrame:
    """The samples as they were after all rows up to a tick."""
    return sample(rows.filter(F.col(tick) <= as_of), params, seq, fast)
