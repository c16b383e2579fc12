"""The four detectors as handles: a row at a time in the driver, or whole DataFrames.

Row methods have the usual names (``update``, ``score``, ``update_and_score`` and so on)
and keep a model in the driver. DataFrame methods (``fit``, ``fit_score``, ``score_rows``)
run on the cluster. Handles copy, pickle and go through JSON, and an engine that
comes back goes on where it was.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path
from typing import Any, Self

from pyspark.sql import DataFrame

from .operators import cut_forest, mixed_stream, replays, sparse_sketch
from .operators.replay import ForestEngine, IsolationEngine, MixedEngine, SketchEngine
from .params import ForestParams, IsolationParams, MixedParams, SketchParams


class _Handle:
    _kind: type
    engine: Any

    @property
    def config(self):
        return self.engine.params

    @property
    def is_ready(self) -> bool:
        return self.engine.is_ready

    @property
    def entries_seen(self) -> int:
        return self.engine.entries_seen

    def to_json(self) -> str:
        return json.dumps(self.engine.state())

    @classmethod
    def from_json(cls, data: str | bytes) -> Self:
        out = cls.__new__(cls)
        try:
            out.engine = cls._kind.restored(json.loads(data))
        except (KeyError, TypeError, json.JSONDecodeError) as e:
            raise ValueError(f"not a saved model: {e}") from e
        return out

    def save_json(self, path: str | Path) -> None:
        Path(path).write_text(self.to_json())

    @classmethod
    def load_json(cls, path: str | Path) -> Self:
        return cls.from_json(Path(path).read_text())

    def copy(self) -> Self:
        return type(self).from_json(self.to_json())

    __copy__ = copy

    def __deepcopy__(self, memo: dict) -> Self:
        return self.copy()

    def __reduce__(self):
        return type(self).from_json, (self.to_json(),)

    def __repr__(self) -> str:
        own = ", ".join(f"{k}={v!r}" for k, v in self.config.to_dict().items())
        return f"{type(self).__name__}({own}, entries_seen={self.entries_seen})"


class Forest(_Handle):
    """Random cut forest."""

    _kind = ForestEngine

    def __init__(self, input_dim: int, **params: Any) -> None:
        self.engine = ForestEngine(ForestParams(input_dim, **params))

    num_trees = property(lambda self: self.config.num_trees)

    def update(self, point: Iterable[float]) -> None:
        self.engine.update(point)

    def update_and_score(self, point: Iterable[float]) -> float:
        return self.engine.update_and_score(point)

    def score(self, point: Iterable[float]) -> float:
        return self.engine.score(point)

    def displacement_score(self, point: Iterable[float]) -> float:
        return self.engine.displacement_score(point)

    def attribution(self, point: Iterable[float]) -> list[dict[str, float]]:
        return self.engine.attribution(point)

    def density(self, point: Iterable[float]) -> float:
        return self.engine.density(point)

    def near_neighbors(self, point: Iterable[float], top_k: int = 10, percentile: int = 50) -> list[dict[str, Any]]:
        return self.engine.near_neighbors(point, top_k, percentile)

    def impute(self, point: Iterable[float], missing: Iterable[int], centrality: float = 1.0) -> list[float]:
        return self.engine.impute(point, missing, centrality)

    def extrapolate(self, look_ahead: int) -> list[float]:
        return self.engine.extrapolate(look_ahead)

    def fit(self, df: DataFrame, seq: str = "seq", vector: str = "vec", fast: bool = True) -> tuple[cut_forest.FrozenForest, DataFrame]:
        """A frozen forest over the table's samples, and its nodes."""
        return cut_forest.fit(df, self.config, seq, vector, fast)

    def fit_score(self, df: DataFrame, seq: str = "seq", vector: str = "vec", key: tuple[str, ...] = ()) -> DataFrame:
        return replays.forest_scores(df, self.config, seq, vector, key)


class OnlineIForest(_Handle):
    """Online isolation forest."""

    _kind = IsolationEngine

    def __init__(self, input_dim: int, **params: Any) -> None:
        self.engine = IsolationEngine(IsolationParams(input_dim, **params))

    num_trees = property(lambda self: self.config.num_trees)

    def update(self, point: Iterable[float]) -> None:
        self.engine.update(point)

    def update_and_score(self, point: Iterable[float]) -> float:
        return self.engine.update_and_score(point)

    def score(self, point: Iterable[float]) -> float:
        return self.engine.score(point)

    def fit_score(self, df: DataFrame, seq: str = "seq", vector: str = "vec", key: tuple[str, ...] = ()) -> DataFrame:
        return replays.isolation_scores(df, self.config, seq, vector, key)


class MStream(_Handle):
    """Mixed numeric and categorical stream."""

    _kind = MixedEngine

    def __init__(self, numeric_dim: int, categorical_dim: int, **params: Any) -> None:
        self.engine = MixedEngine(MixedParams(numeric_dim, categorical_dim, **params))

    @property
    def current_time(self) -> int:
        return self.engine.current_time

    def update(self, numeric: Sequence[float], categorical: Sequence[int], timestamp: int) -> None:
        self.engine.update(numeric, categorical, timestamp)

    def update_and_score(self, numeric: Sequence[float], categorical: Sequence[int], timestamp: int) -> float:
        return self.engine.update_and_score(numeric, categorical, timestamp)

    def update_and_score_detailed(self, numeric: Sequence[float], categorical: Sequence[int], timestamp: int) -> dict[str, Any]:
        return self.engine.update_and_score_detailed(numeric, categorical, timestamp).to_dict()

    def score(self, numeric: Sequence[float], categorical: Sequence[int], timestamp: int) -> float:
        return self.engine.score(numeric, categorical, timestamp)

    def score_detailed(self, numeric: Sequence[float], categorical: Sequence[int], timestamp: int) -> dict[str, Any]:
        return self.engine.score_detailed(numeric, categorical, timestamp).to_dict()

    def fit(self, df: DataFrame, spec: mixed_stream.MixedSpec, fast: bool = True) -> mixed_stream.MixedModel:
        return mixed_stream.fit(df, spec, self.config, fast)

    def fit_score(self, df: DataFrame, spec: mixed_stream.MixedSpec, fast: bool = True) -> DataFrame:
        return mixed_stream.fit_score(df, spec, self.config, fast=fast)


class FeatureSketch(_Handle):
    """Sketch of sparse events with open names."""

    _kind = SketchEngine

    def __init__(self, **params: Any) -> None:
        self.engine = SketchEngine(SketchParams(**params))

    def update(self, features: Mapping[str, float] | Iterable[tuple[str, float]]) -> None:
        self.engine.update(features)

    def update_and_score(self, features: Mapping[str, float] | Iterable[tuple[str, float]]) -> float:
        return self.engine.update_and_score(features)

    def score(self, features: Mapping[str, float] | Iterable[tuple[str, float]]) -> float:
        return self.engine.score(features)

    def fit(self, df: DataFrame, order: list[str], features: str = "features", fast: bool = True) -> sparse_sketch.SketchModel:
        return sparse_sketch.fit(df, order, features, self.config, fast)

    def fit_score(self, df: DataFrame, order: list[str], features: str = "features", key: tuple[str, ...] = (), fast: bool = True) -> DataFrame:
        return sparse_sketch.fit_score(df, order, features, self.config, key, fast)
