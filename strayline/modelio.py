"""Models as files: JSON for handles, Parquet for the tables of fitted ones."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from .operators.mixed_stream import MixedModel, MixedSpec
from .operators.sparse_sketch import SketchModel
from .params import MixedParams, SketchParams

FORMAT = 1


def _write_head(spark: SparkSession, path: str, head: dict) -> None:
    spark.createDataFrame([(json.dumps(head | {"format_version": FORMAT}),)], "head string").coalesce(1).write.mode("overwrite").json(f"{path}/head")


def _read_head(spark: SparkSession, path: str) -> dict:
    head = json.loads(spark.read.schema("head string").json(f"{path}/head").first()[0])
    if head.get("format_version") != FORMAT:
        raise ValueError(f"format version {head.get('format_version')!r} isn't {FORMAT}")
    return head


def save_mixed(spark: SparkSession, model: MixedModel, path: str) -> None:
    model.cells.write.mode("overwrite").parquet(f"{path}/cells")
    model.ranges.write.mode("overwrite").parquet(f"{path}/ranges")
    _write_head(spark, path, {"params": model.params.to_dict(), "spec": vars(model.spec)})


def load_mixed(spark: SparkSession, path: str) -> MixedModel:
    head = _read_head(spark, path)
    spec = MixedSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in head["spec"].items()})
    return MixedModel(spec, MixedParams.from_dict(head["params"]), spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/ranges"))


def save_sketch(spark: SparkSession, model: SketchModel, path: str) -> None:
    model.cells.write.mode("overwrite").parquet(f"{path}/cells")
    _write_head(spark, path, {"params": model.params.to_dict(), "entries_seen": model.entries_seen})


def load_sketch(spark: SparkSession, path: str) -> SketchModel:
    head = _read_head(spark, path)
    return SketchModel(SketchParams.from_dict(head["params"]), spark.read.parquet(f"{path}/cells"), head["entries_seen"])
