"""

Table forms run on local[$BENCH_CPUS]; row forms are one handle in one Python process.
"""

from __future__ import annotations

import json
import os
import random
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strayline.detectors import FeatureSketch, Forest, MStream, OnlineIForest
from strayline.operators import cut_forest, mixed_stream, sparse_sketch
from strayline.operators.mixed_stream import MixedSpec
from strayline.params import ForestParams, MixedParams, SketchParams

out: dict[str, dict[str, float]] = {}


def timed(name: str, rows: int, run) -> None:
    start = time.perf_counter()
    run()
    s = time.perf_counter() - start
    out[name] = {"seconds": round(s, 3), "rows_a_second": round(rows / s)}


def vectors(spark: SparkSession, n: int, dim: int):
    return spark.range(n).select((F.col("id") + 1).alias("seq"), F.array(*[F.rand(d) for d in range(dim)]).alias("vec")).cache()


def forests(spark: SparkSession) -> None:
    for trees, capacity, dim in ((50, 256, 8), (100, 512, 8), (100, 512, 16)):
        rows, params = vectors(spark, 20_000, dim), ForestParams(dim, num_trees=trees, capacity=capacity, seed=42)
        rows.count()
        own = {}
        timed(f"forest fit, 20,000 rows, dim {dim}, {trees} trees, capacity {capacity}", 20_000, lambda: own.update(f=cut_forest.fit(rows, params, fast=True)[0]))
        for name in ("score", "attribution", "near_neighbors"):
            n = 20_000 if name == "score" else 2_000
            timed(f"forest {name}, {n:,} rows, dim {dim}, {trees} trees, capacity {capacity}", n, lambda: getattr(own["f"], name)(rows.limit(n)).write.format("noop").mode("overwrite").save())
        holes = rows.limit(500).withColumn("vec", F.transform("vec", lambda v, i: F.when(i > 1, v)))
        timed(f"forest impute 2 of {dim}, 500 rows, {trees} trees, capacity {capacity}", 500, lambda: own["f"].impute(holes).write.format("noop").mode("overwrite").save())
    r = random.Random(1)
    forest = Forest(8, num_trees=50, capacity=256, seed=42)
    timed("row form: forest update, 5,000 rows, dim 8, 50 trees, capacity 256", 5_000, lambda: [forest.update([r.random() for _ in range(8)]) for _ in range(5_000)])
    timed("row form: forest score, 200 rows, same", 200, lambda: [forest.score([r.random() for _ in range(8)]) for _ in range(200)])


def streams(spark: SparkSession) -> None:
    for numeric, categorical, rows_, buckets, n in ((8, 4, 2, 256, 20_000), (16, 8, 4, 512, 10_000), (32, 0, 4, 512, 10_000)):
        columns = [F.rand(d).alias(f"n{d}") for d in range(numeric)] + [(F.rand(100 + j) * 50).cast("long").alias(f"c{j}") for j in range(categorical)]
        df = spark.range(n).select("id", (F.col("id") / 500).cast("long").alias("tick") + 1, *columns).toDF("id", "tick", *[f"n{d}" for d in range(numeric)], *[f"c{j}" for j in range(categorical)]).cache()
        df.count()
        spec = MixedSpec(tuple(f"n{d}" for d in range(numeric)), tuple(f"c{j}" for j in range(categorical)), "tick", ("id",))
        params = MixedParams(numeric, categorical, num_rows=rows_, num_buckets=buckets, seed=1)
        timed(f"mixed update and score, n{numeric} c{categorical} r{rows_} b{buckets}, {n:,} rows", n, lambda: mixed_stream.fit_score(df, spec, params, fast=True).write.format("noop").mode("overwrite").save())
    m = MStream(8, 4, num_rows=2, num_buckets=256, seed=1)
    r = random.Random(1)
    timed("row form: mixed update and score, n8 c4 r2 b256, 2,000 rows", 2_000, lambda: [m.update_and_score([r.random() for _ in range(8)], [r.randrange(50) for _ in range(4)], 1) for _ in range(2_000)])


def sketches(spark: SparkSession) -> None:
    for features, n in ((8, 2_000), (16, 1_000)):
        df = spark.range(n).select("id", F.map_from_entries(F.array(*[F.struct(F.lit(f"f{d}"), F.rand(d)) for d in range(features)])).alias("features")).cache()
        df.count()
        timed(f"sketch update and score, {features} features, {n:,} events, defaults", n, lambda: sparse_sketch.fit_score(df, ["id"], "features", SketchParams(seed=1), fast=True).write.format("noop").mode("overwrite").save())
    s = FeatureSketch(seed=1)
    r = random.Random(1)
    timed("row form: sketch update and score, 8 features, 200 events, defaults", 200, lambda: [s.update_and_score({f"f{d}": r.random() for d in range(8)}) for _ in range(200)])


def isolation() -> None:
    r = random.Random(1)
    for trees, window, leaf in ((16, 512, 8), (32, 2048, 32)):
        forest = OnlineIForest(8, num_trees=trees, window_size=window, max_leaf_samples=leaf, seed=1)
        timed(f"row form: isolation update and score, dim 8, t{trees} w{window} l{leaf}, 1,000 rows", 1_000, lambda: [forest.update_and_score([r.random() for _ in range(8)]) for _ in range(1_000)])


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    forests(spark)
    streams(spark)
    sketches(spark)
    isolation()
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
