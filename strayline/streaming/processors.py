"""Detectors as Structured Streaming operators with one engine for each entity.

The state of a key is its engine, one compressed JSON value. Rows of a micro-batch are
sorted by their order column before they go in, so arrival inside a batch doesn't matter.
A row that is late or invalid is not counted: it comes out with ``reject`` and no score.
The engine's size is bounded by its parameters, whatever the stream's length; idle keys can
be dropped after ``ttl_ms``.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.replay import ENGINES
from ..params import Params

#: The state store that keeps large states out of the JVM's heap.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class DetectorProcessor(StatefulProcessor):
    """kind: a name in ENGINES. inputs: the columns an engine's row is made of."""

    def __init__(self, kind: str, params: Params, key: str, order: str, inputs: dict[str, Any], ttl_ms: int | None = None) -> None:
        self.kind, self.params, self.key, self.order, self.inputs, self.ttl_ms = kind, params, key, order, inputs, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("engine", "data binary, last string", **({"ttlDurationMs": self.ttl_ms} if self.ttl_ms else {}))

    def _engine(self) -> tuple[Any, Any]:
        if not self.state.exists():
            return ENGINES[self.kind](self.params), None
        data, last = self.state.get()
        return ENGINES[self.kind].restored(json.loads(zlib.decompress(bytes(data)))), json.loads(last)

    def _score(self, engine: Any, row: dict) -> float:
        if self.kind == "mixed":
            return engine.update_and_score([float(row[c]) for c in self.inputs["numeric"]], [row[c] for c in self.inputs["categorical"]], int(row[self.inputs["tick"]]))
        if self.kind == "sketch":
            value = row[self.inputs["features"]]
            return engine.update_and_score(dict(value) if value is not None else {})
        return engine.update_and_score([float(row[c]) for c in self.inputs["point"]])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        engine, last = self._engine()
        out = []
        for row in batch.to_dict("records"):
            at, score, reject = _plain(row[self.order]), None, None
            if last is not None and at < last:
                reject = "late"
            else:
                try:
                    score = self._score(engine, row)
                    last = at
                except (ValueError, TypeError) as e:
                    reject = f"invalid: {e}"
            out.append((key[0], row[self.order], score, reject))
        self.state.update((zlib.compress(json.dumps(engine.state()).encode(), 1), json.dumps(last)))
        yield pd.DataFrame(out, columns=[self.key, self.order, "score", "reject"])

    def close(self) -> None:
        pass


def _plain(x: Any) -> Any:
    """Something JSON keeps and that compares as x does."""
    return x.isoformat() if isinstance(x, pd.Timestamp) else x.item() if hasattr(x, "item") else x


def scored(stream: DataFrame, kind: str, params: Params, key: str, order: str, inputs: dict[str, Any], ttl_ms: int | None = None) -> DataFrame:
    """key, order, score and reject for each row of a stream; score is null where reject says why."""
    params = params.seeded()
    spark = stream.sparkSession
    spark.conf.set(*STORE)
    schema = f"`{key}` {stream.schema[key].dataType.simpleString()}, `{order}` {stream.schema[order].dataType.simpleString()}, score double, reject string"
    return stream.groupBy(key).transformWithStateInPandas(DetectorProcessor(kind, params, key, order, inputs, ttl_ms), schema, "append", "none")
