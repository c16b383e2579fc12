"""Exact replays of an ordered stream, all trees at once.

Trees don't share anything but the rows, so each is a stream of its own: rows are dealt by
tree, sorted inside their partition and replayed a batch at a time, and the trees' answers
are averaged by row. A task holds one batch and one tree, never the stream. A row costs what
it costs in the sequential engine, so the forms in the other modules are the ones for
large tables; with a key, streams of many entities run side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import ForestParams, IsolationParams
from .replay import ForestEngine, IsolationEngine


def _by_tree(rows: DataFrame, trees: int, seq: str, vector: str, key: tuple[str, ...]) -> DataFrame:
    own = rows.select(*key, F.col(seq).alias("seq"), F.col(vector).alias("vec"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    return own.repartition(*key, "tree").sortWithinPartitions(*key, "tree", "seq")


def _replayed(rows: DataFrame, engine, column: str, key: tuple[str, ...]) -> DataFrame:
    names = [*key, "tree"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, now = None, None
        for pdf in batches:
            out = np.empty(len(pdf))
            for i, (group, x) in enumerate(zip(zip(*(pdf[c] for c in names)), pdf["vec"])):
                if group != at:
                    at, now = group, engine(int(group[-1]))
                out[i] = now(np.asarray(x, np.float64))
            yield pdf[[*names, "seq"]].assign(**{column: out})

    own = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInPandas(run, f"{own}, seq long, {column} double")


def forest_scores(rows: DataFrame, params: ForestParams, seq: str = "seq", vector: str = "vec", key: tuple[str, ...] = ()) -> DataFrame:
    """key, seq and score: each row before it goes in, warm-up and evictions as in the engine."""
    params = params.seeded()

    def engine(tree: int):
        own = ForestEngine(params, [tree])
        return own.update_and_score

    found = _replayed(_by_tree(rows, params.num_trees, seq, vector, key), engine, "score", key)
    return found.groupBy(*key, "seq").agg(F.avg("score").alias("score"))


def isolation_scores(rows: DataFrame, params: IsolationParams, seq: str = "seq", vector: str = "vec", key: tuple[str, ...] = ()) -> DataFrame:
    """key, seq and score: each row after it went in and the oldest went out."""
    params = params.seeded()

    def engine(tree: int):
        own = IsolationEngine(params, [tree])

        def step(x: np.ndarray) -> float:
            own.update(x)
            return own.mean_depth(x)

        return step

    found = _replayed(_by_tree(rows, params.num_trees, seq, vector, key), engine, "depth", key)
    return found.groupBy(*key, "seq").agg(F.pow(F.lit(2.0), -F.avg("depth") / F.lit(params.normaliser)).alias("score"))


def isolation_model(rows: DataFrame, params: IsolationParams, seq: str = "seq", vector: str = "vec") -> IsolationEngine:
    """An engine fitted to the last window of rows: at most window_size rows come to the driver."""
    own = IsolationEngine(params)
    last = rows.select(seq, vector).orderBy(F.desc(seq)).limit(own.params.window_size)
    for r in sorted(last.collect(), key=lambda r: r[0]):
        own.update(r[1])
    return own


def isolation_answers(queries: DataFrame, engine: IsolationEngine, vector: str = "vec", name: str = "score") -> DataFrame:
    """queries with the score of each point under the engine as it is; the engine's size is bounded by its parameters."""
    spec = queries.sparkSession.sparkContext.broadcast(engine.state())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = IsolationEngine.restored(spec.value)
        for pdf in batches:
            yield pdf.assign(**{name: [own.score(x) for x in pdf[vector]]})

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
    return queries.mapInPandas(run, f"{kept}, {name} double")
