import json

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strayline import modelio
from strayline.detectors import Forest
from strayline.operators import cut_forest, mixed_stream, prefix, replays, sparse_sketch
from strayline.operators.replay import ForestEngine, IsolationEngine, MixedEngine, SketchEngine
from strayline.operators.sequence import numbered
from strayline.params import ForestParams, IsolationParams, MixedParams
from strayline.queries import forest as forest_queries
from strayline.queries import mixed as mixed_queries
from strayline.queries import sparse as sparse_queries
from strayline.queries.common import events
from strayline.streaming.processors import scored


def test_numbers_in_many_ranges(spark, sf_dir):
    rows = events(spark, sf_dir)
    found = numbered(rows, ["ts", "event_id"], ranges=7).toPandas().set_index("event_id")["seq"]
    plain = rows.toPandas().sort_values(["ts", "event_id"])["event_id"].tolist()
    assert [found[i] for i in plain] == list(range(1, len(plain) + 1))
    own = numbered(rows, ["ts", "event_id"], by=("user_id",), ranges=5).toPandas()
    for _, g in own.groupby("user_id"):
        assert sorted(g["seq"]) == list(range(1, len(g) + 1))
        assert g.sort_values(["ts", "event_id"])["seq"].is_monotonic_increasing


def test_null_times_come_first(spark):
    rows = spark.createDataFrame([(None, 1), (3.0, 2), (1.0, 3), (None, 0)], "t double, i int")
    found = {r.i: r.seq for r in numbered(rows, ["t", "i"], ranges=3).collect()}
    assert found == {0: 1, 1: 2, 3: 3, 2: 4}
    assert numbered(rows.limit(0), ["t", "i"]).count() == 0


def test_running_values_by_tick(spark, sf_dir):
    rows = events(spark, sf_dir)
    found = prefix.running(rows, ["ts", "event_id"], {"s": ("sum", F.col("value")), "n": ("count", F.lit(1)), "m": ("max", F.col("value"))}, by=("user_id",), range_by="tick")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    plain = found.withColumns({"s2": F.sum("value").over(w), "n2": F.count("*").over(w), "m2": F.max("value").over(w)})
    assert plain.filter("abs(s - s2) > 1e-6 or n <> n2 or m <> m2").count() == 0


@pytest.mark.parametrize("alpha", [0.8, 0.1])
def test_decay_over_blocks(spark, alpha):
    # Ticks far apart, so that a plain power would overflow.
    ticks = [1, 2, 3, 1200, 1201, 2500, 9000]
    rows = spark.createDataFrame([("a", t, 2) for t in ticks], "cell string, tick long, n int")
    found = {r.tick: r.current_before for r in mixed_stream.decayed_before(rows, ["cell"], "tick", "n", alpha).collect()}
    now, last = 0.0, None
    for t in ticks:
        now *= alpha ** (t - last) if last else 1
        assert found[t] == pytest.approx(now, abs=1e-9)
        now, last = now + 2, t


def test_half_life_over_blocks(spark):
    seqs = [1, 2, 5, 700, 701, 5000]
    rows = spark.createDataFrame([("a", s) for s in seqs], "cell string, seq long")
    found = {r.seq: r["count"] for r in sparse_sketch.decayed_counts(rows, ["cell"], 2).collect()}
    for s in seqs:
        assert found[s] == pytest.approx(sum(0.5 ** ((s - 1 - i) / 2) for i in seqs if i < s), abs=1e-9)


def test_mixed_windows_are_the_sequential_engine(spark, sf_dir):
    spec, params = mixed_queries.TWO, mixed_queries.params(mixed_queries.TWO)
    found = mixed_stream.fit_score(events(spark, sf_dir), spec, params).toPandas().set_index("event_id")
    engine = MixedEngine(params)
    for r in events(spark, sf_dir).toPandas().sort_values(["ts", "event_id"]).to_dict("records"):
        s = engine.update_and_score_detailed([r["value"], r["k"]], [r["event_type"], r["user_id"]], r["tick"])
        own = found.loc[r["event_id"]]
        assert own["total"] == pytest.approx(s.total, abs=1e-6)
        assert [own["numeric_0"], own["numeric_1"]] == pytest.approx(s.numeric_features, abs=1e-6)
        assert own["record"] == pytest.approx(s.record, abs=1e-6)


def test_sparse_windows_are_the_sequential_engine(spark, sf_dir):
    rows = sparse_queries.featured(spark, sf_dir)
    found = sparse_sketch.fit_score(rows, ["ts", "event_id"], "features", sparse_queries.PARAMS).toPandas().set_index("event_id")["score"]
    engine = SketchEngine(sparse_queries.PARAMS)
    for r in rows.toPandas().sort_values(["ts", "event_id"]).to_dict("records"):
        assert found[r["event_id"]] == pytest.approx(engine.update_and_score([(f["name"], f["value"]) for f in r["features"]]), abs=1e-6)


def test_an_event_without_names_is_scored(spark):
    rows = spark.createDataFrame([(1, {"a": 1.0}), (2, {}), (3, None)], "i int, features map<string,double>")
    found = sparse_sketch.fit_score(rows, ["i"], "features", sparse_queries.PARAMS).collect()
    assert len(found) == 3


def test_replays_are_the_engines(spark, sf_dir):
    rows = forest_queries.points(spark, sf_dir).filter("seq <= 300")
    points = [r.vec for r in rows.orderBy("seq").collect()]
    for found, engine in (
        (replays.forest_scores(rows, forest_queries.REPLAYED), ForestEngine(forest_queries.REPLAYED)),
        (replays.isolation_scores(rows, forest_queries.WINDOWED), IsolationEngine(forest_queries.WINDOWED)),
    ):
        assert [r.score for r in found.orderBy("seq").collect()] == pytest.approx([engine.update_and_score(x) for x in points])


def test_keyed_replays_are_streams_of_their_own(spark, sf_dir):
    rows = numbered(forest_queries.points(spark, sf_dir).drop("seq"), ["ts", "event_id"], by=("event_type",)).filter("seq <= 60")
    params = ForestParams(3, num_trees=3, capacity=16, seed=1)
    found = replays.forest_scores(rows, params, key=("event_type",)).toPandas()
    for kind, own in rows.toPandas().groupby("event_type"):
        engine = ForestEngine(params)
        expected = [engine.update_and_score(x) for x in own.sort_values("seq")["vec"]]
        assert found[found.event_type == kind].sort_values("seq")["score"].tolist() == pytest.approx(expected)


def test_isolation_model_answers(spark):
    rows = spark.createDataFrame([(i, [float(i % 9), float(i % 7)]) for i in range(200)], "seq long, vec array<double>")
    params = IsolationParams(2, num_trees=5, window_size=64, max_leaf_samples=8, seed=2)
    engine = replays.isolation_model(rows, params)
    found = replays.isolation_answers(rows.limit(5), engine).collect()
    assert [r.score for r in found] == [engine.score(r.vec) for r in found]


def test_models_come_back_from_files(spark, sf_dir, tmp_path):
    rows = events(spark, sf_dir)
    spec, params = mixed_queries.TWO, mixed_queries.params(mixed_queries.TWO)
    model = mixed_stream.fit(rows.filter("tick <= 20"), spec, params)
    modelio.save_mixed(spark, model, f"{tmp_path}/m")
    a = model.score(rows.filter("tick > 20")).toPandas().sort_values("event_id")["total"].to_numpy()
    b = modelio.load_mixed(spark, f"{tmp_path}/m").score(rows.filter("tick > 20")).toPandas().sort_values("event_id")["total"].to_numpy()
    assert np.allclose(a, b)
    events_ = sparse_queries.featured(spark, sf_dir)
    sketch = sparse_sketch.fit(events_.filter("tick <= 20"), ["ts", "event_id"], "features", sparse_queries.PARAMS)
    modelio.save_sketch(spark, sketch, f"{tmp_path}/s")
    again = modelio.load_sketch(spark, f"{tmp_path}/s")
    assert again.entries_seen == sketch.entries_seen
    spark.createDataFrame([(json.dumps({"format_version": 2}),)], "head string").coalesce(1).write.mode("overwrite").json(f"{tmp_path}/s/head")
    with pytest.raises(ValueError):
        modelio.load_sketch(spark, f"{tmp_path}/s")
    frozen, nodes = cut_forest.fit(forest_queries.points(spark, sf_dir), forest_queries.PARAMS)
    frozen.save(spark, nodes, f"{tmp_path}/f")
    back = cut_forest.FrozenForest.load(spark, f"{tmp_path}/f")
    asked = forest_queries.points(spark, sf_dir).limit(20).select("event_id", "vec")
    assert back.score(asked).orderBy("event_id").toPandas()["score"].tolist() == pytest.approx(frozen.score(asked).orderBy("event_id").toPandas()["score"].tolist())


def test_too_large_a_forest_is_not_broadcast(spark):
    nodes = spark.createDataFrame([], cut_forest.NODES)
    with pytest.raises(ValueError):
        cut_forest.FrozenForest.collect(nodes, ForestParams(1000, capacity=100_000, num_trees=1000))
    empty = cut_forest.FrozenForest.collect(nodes, ForestParams(2))
    asked = spark.createDataFrame([([1.0, 2.0],)], "vec array<double>")
    assert empty.score(asked).first()["score"] == 0.0
    with pytest.raises(RuntimeError):
        empty.impute(asked)


def test_scored_by_handles(spark, sf_dir):
    forest = Forest(3, num_trees=4, capacity=32, seed=1)
    frozen, _ = forest.fit(forest_queries.points(spark, sf_dir))
    assert frozen.score(forest_queries.points(spark, sf_dir).select("vec")).filter("score > 0").count() > 0


def test_streams_in_many_batches_and_late_rows(spark, sf_dir, tmp_path):
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "value", "tick")
    for part in range(3):
        rows.filter((F.col("tick") > part * 10) & (F.col("tick") <= part * 10 + 10)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        # One file after another.
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        params = MixedParams(1, 1, num_rows=2, num_buckets=256, seed=7)
        out = scored(stream, "mixed", params, "user_id", "event_id", {"numeric": ["value"], "categorical": ["event_type"], "tick": "tick"})
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").toPandas()
    assert found["reject"].isna().all()
    expected = mixed_stream.fit_score(events(spark, sf_dir), mixed_queries.BY_USER, mixed_queries.params(mixed_queries.BY_USER)).toPandas()
    both = found.merge(expected, on="event_id")
    assert len(both) == len(found) == rows.count()
    assert np.allclose(both["score"], both["total"], atol=1e-6)
    late = rows.limit(3).withColumns({"tick": F.lit(1).cast("long"), "event_id": F.lit(-1).cast("long") - F.col("event_id")})
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    out = scored(stream, "mixed", params, "user_id", "event_id", {"numeric": ["value"], "categorical": ["event_type"], "tick": "tick"})
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    again = spark.read.parquet(f"{tmp_path}/out").filter("event_id < 0").toPandas()
    assert len(again) == 3 and again["score"].isna().all() and (again["reject"] == "late").all()
