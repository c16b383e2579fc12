"""The detectors as streaming queries: one engine for each user, run until the input is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import ForestParams, IsolationParams, Params, SketchParams
from ..storage import shared_dir
from ..streaming.processors import scored
from . import mixed
from .common import SEED, r, rounded


def drain(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """What a stream gives until its input is used up, as a table in the shared folder."""
    path = f"{shared_dir(spark)}/strayline-stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern, as the table may be one file or a folder of them.
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parque[t]")
    return rows.withColumns({"tick": F.unix_date(F.to_date("ts")).cast("long"), "k": F.get_json_object("props", "$.k").cast("double")})


def _by_user(spark: SparkSession, rows: DataFrame, kind: str, params: Params, inputs: dict) -> DataFrame:
    found = drain(scored(rows, kind, params, "user_id", "event_id", inputs), spark)
    return found.select("event_id", rounded("score"))


def mstream_stream_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = {"numeric": ["value"], "categorical": ["event_type"], "tick": "tick"}
    return _by_user(spark, source(spark, sf_dir), "mixed", mixed.params(mixed.BY_USER), inputs)


def rcf_stream_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_user(spark, source(spark, sf_dir), "forest", ForestParams(2, num_trees=4, capacity=32, seed=SEED), {"point": ["value", "k"]})


def oif_stream_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_user(spark, source(spark, sf_dir), "isolation", IsolationParams(2, num_trees=4, window_size=64, max_leaf_samples=8, seed=SEED), {"point": ["value", "k"]})


def fs_stream_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source(spark, sf_dir)
    features = F.map_concat(F.create_map(F.concat(F.lit("type:"), "event_type"), F.lit(1.0)), F.create_map(F.lit("value"), F.col("value")))
    params = SketchParams(value_projection_dims=4, presence_projection_dims=4, chains_per_ensemble=2, chain_depth=3, sketch_buckets=64, decay_half_life=256, seed=SEED)
    return _by_user(spark, rows.withColumn("features", features), "sketch", params, {"features": "features"})


_total = mixed.score_sql(mixed.BY_USER)
QUERIES = {
    "mstream_stream_by_user": (mstream_stream_by_user, f"SELECT event_id, {r('total')} AS score FROM ({_total})"),
    "rcf_stream_by_user": (rcf_stream_by_user, None),
    "oif_stream_by_user": (oif_stream_by_user, None),
    "fs_stream_by_user": (fs_stream_by_user, None),
}
