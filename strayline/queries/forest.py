"""Random cut forest queries. The SQL builds the same trees by recursion over the samples.

Points are an event's value, k and hour. Questions to the forest are put for all events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, vectors
from ..operators import cut_forest, reservoir, replays
from ..operators.sequence import numbered
from ..params import ForestParams, IsolationParams
from .common import EVENTS, SEED, events, r, rounded, table

PARAMS = ForestParams(3, num_trees=8, capacity=64, seed=SEED)
DIMS = 3
AS_OF = 15


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(events(spark, sf_dir), ["ts", "event_id"]).withColumn("hour", F.hour("ts"))
    return rows.withColumn("vec", vectors.point("value", "k", "hour"))


POINTS = f"{EVENTS}, pt AS (SELECT event_id, seq, tick, value AS x0, k AS x1, hour(ts)::DOUBLE AS x2 FROM ev)"


def sample_sql(where: str = "") -> str:
    u = hashing.uniform_sql(f"'{SEED}|reservoir|' || tree || '|' || seq")
    eps = "2.220446049250313e-16::DOUBLE"
    return f"""{POINTS}, wt AS (SELECT pt.*, tree, ln(-ln(greatest({eps}, least(1 - {eps}, {u})))) - {PARAMS.decay!r}::DOUBLE * (seq - 1) AS weight FROM pt, range({PARAMS.num_trees}) t(tree) {where}),
  sm AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY weight, seq) AS rank FROM wt QUALIFY rank <= {PARAMS.capacity})"""


def tree_sql() -> str:
    """CTEs lv (rows of the samples at every level, with their node) and nd (nodes)."""
    xs = ", ".join(f"x{d}" for d in range(DIMS))
    boxes = ", ".join(f"min(x{d}) OVER n AS l{d}, max(x{d}) OVER n AS h{d}" for d in range(DIMS))
    u = hashing.uniform_sql(f"'{SEED}|cut|' || tree || '|' || path")
    s0, s1, s2 = ("(h0 - l0)", "((h0 - l0) + (h1 - l1))", "((h0 - l0) + (h1 - l1) + (h2 - l2))")
    step = f"""SELECT *, {boxes}, count(*) OVER n AS mass FROM lv WINDOW n AS (PARTITION BY tree, path)"""
    # Cumulative sides give the dimension; a value is held below the box's high side.
    cut = f"""SELECT *, CASE WHEN {s2} <= 0 THEN -1 WHEN pos < {s0} THEN 0 WHEN pos < {s1} THEN 1 ELSE 2 END AS dim FROM (SELECT *, {u} * {s2} AS pos FROM ({step}))"""
    value = f"CASE dim WHEN 0 THEN least(greatest(l0 + pos, l0), nextafter(h0, '-infinity'::DOUBLE)) WHEN 1 THEN least(greatest(l1 + (pos - {s0}), l1), nextafter(h1, '-infinity'::DOUBLE)) WHEN 2 THEN least(greatest(l2 + (pos - {s1}), l2), nextafter(h2, '-infinity'::DOUBLE)) ELSE 0.0 END"
    return f"""lv AS (
    SELECT tree, '' AS path, 0 AS depth, seq, {xs} FROM sm
    UNION ALL
    SELECT tree, path || CASE WHEN CASE dim WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END <= {value} THEN '0' ELSE '1' END, depth + 1, seq, {xs} FROM ({cut}) WHERE dim >= 0
  ), nd AS MATERIALIZED (
    SELECT DISTINCT tree, path, depth, dim AS cut_dim, {value} AS cut_val, {', '.join(f'l{d}, h{d}' for d in range(DIMS))}, mass, dim < 0 AS is_leaf FROM ({cut})
  ), tm AS (SELECT tree, mass AS total FROM nd WHERE path = '')"""


BUILT = f"WITH RECURSIVE {sample_sql()}, {tree_sql()}"
_excess = " + ".join(f"greatest(0, l{d} - x{d}) + greatest(0, x{d} - h{d})" for d in range(DIMS))
_width = " + ".join(f"(h{d} - l{d})" for d in range(DIMS))
_p = f"CASE WHEN is_leaf OR ({_excess}) <= 0 THEN 0.0 WHEN ({_width}) <= 0 THEN 1.0 ELSE ({_excess}) / (({_width}) + ({_excess})) END"
_side = "CASE WHEN CASE cut_dim WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END <= cut_val THEN '0' ELSE '1' END"
_same = " AND ".join(f"l{d} = x{d}" for d in range(DIMS))
#: qn: each event at each node on its way down, with the weight it comes with and its cut probability.
DESCENT = f"""{BUILT}, qs AS (
    SELECT event_id, x0, x1, x2, tree, '' AS path, 1.0::DOUBLE AS w FROM pt, range({PARAMS.num_trees}) t(tree)
    UNION ALL
    SELECT event_id, x0, x1, x2, tree, path || {_side}, w * (1 - {_p}) FROM qs JOIN nd USING (tree, path) WHERE NOT is_leaf
  ), qn AS (SELECT qs.*, nd.* EXCLUDE (tree, path), total, {_p} AS p, {_same} AS same FROM qs JOIN nd USING (tree, path) JOIN tm USING (tree))"""


def reservoir_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reservoir.weighed(points(spark, sf_dir), PARAMS).select("event_id", "tree", rounded("weight"))


def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reservoir.sample(points(spark, sf_dir), PARAMS).select("event_id", "tree", "rank")


def reservoir_as_of_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reservoir.sample_as_of(points(spark, sf_dir), PARAMS, "tick", AS_OF).select("event_id", "tree", "rank")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_forest.build(reservoir.sample(points(spark, sf_dir).select("seq", "vec"), PARAMS), PARAMS)


def rcf_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("tree", "path", "depth", "cut_dim", rounded("cut_val"), "is_leaf")


def rcf_node_mass_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("tree", "path", "mass", *[rounded(F.col(c)[d], f"{c[0]}{d}") for d in range(DIMS) for c in ("low", "high")])


def _asked(spark: SparkSession, sf_dir: str) -> tuple[cut_forest.FrozenForest, DataFrame]:
    rows = points(spark, sf_dir)
    forest, _ = cut_forest.fit(rows, PARAMS)
    return forest, rows.select("event_id", "vec")


def rcf_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest, asked = _asked(spark, sf_dir)
    return forest.score(asked).select("event_id", rounded("score"))


SCORE_SQL = f"""{DESCENT} SELECT event_id, {r('avg(s)')} AS score FROM (
  SELECT event_id, tree, total, sum(CASE WHEN NOT is_leaf THEN w * p / (depth + 1) WHEN same THEN w * (1 - mass / (2 * total)) / (depth + log2(1 + mass)) ELSE w / (depth + 1) END) * log2(1 + total) AS s FROM qn GROUP BY event_id, tree, total) GROUP BY event_id"""


def rcf_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest, asked = _asked(spark, sf_dir)
    return forest.displacement_score(asked).select("event_id", rounded("displacement"))


DISPLACEMENT_SQL = f"""{DESCENT} SELECT event_id, {r('avg(s)')} AS displacement FROM (
  SELECT event_id, tree, total, sum(CASE WHEN NOT is_leaf THEN w * p * mass WHEN same THEN w * (1 - mass / (2 * total)) / (1 + mass) ELSE w * mass END) / (1 + total) AS s FROM qn GROUP BY event_id, tree, total) GROUP BY event_id"""


def rcf_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest, asked = _asked(spark, sf_dir)
    return forest.density(asked).select("event_id", rounded("density"))


DENSITY_SQL = f"""{DESCENT} SELECT event_id, {r('avg(s)')} AS density FROM (
  SELECT event_id, tree, sum(CASE WHEN NOT is_leaf THEN w * p * mass WHEN same THEN w * mass ELSE 0 END) AS s FROM qn GROUP BY event_id, tree) GROUP BY event_id"""


def rcf_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest, asked = _asked(spark, sf_dir)
    own = [rounded(F.col("attribution")[d][side], f"{side}_{d}") for d in range(DIMS) for side in ("below", "above")]
    return forest.attribution(asked).select("event_id", *own)


_part = lambda d, above: f"coalesce(sum(w * p / (depth + 1) * log2(1 + total)) FILTER (NOT is_leaf AND cut_dim = {d} AND (x{d} <= cut_val) = {above}), 0) / {PARAMS.num_trees}"
ATTRIBUTION_SQL = f"{DESCENT} SELECT event_id, {', '.join(f'{r(_part(d, a))} AS {n}_{d}' for d in range(DIMS) for n, a in (('below', 'false'), ('above', 'true')))} FROM qn GROUP BY event_id"


def rcf_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest, asked = _asked(spark, sf_dir)
    far = asked.withColumn("vec", F.transform("vec", lambda v: v * 1.5 + 1))
    rows = forest.near_neighbors(far, top_k=3, percentile=20).select("event_id", F.posexplode("neighbors").alias("rank", "n"))
    return rows.select("event_id", (F.col("rank") + 1).alias("rank"), *[rounded(F.col("n.point")[d], f"x{d}") for d in range(DIMS)], rounded("n.distance", "distance"), rounded("n.score", "score"))


NEIGHBORS_SQL = f"""{BUILT}, qs AS (
    SELECT event_id, x0 * 1.5 + 1 AS x0, x1 * 1.5 + 1 AS x1, x2 * 1.5 + 1 AS x2, tree, '' AS path FROM pt, range({PARAMS.num_trees}) t(tree)
    UNION ALL
    SELECT event_id, x0, x1, x2, tree, path || CASE WHEN far THEN CASE side WHEN '0' THEN '1' ELSE '0' END ELSE side END
    FROM (SELECT qs.*, {_side} AS side, {_p} AS p, depth FROM qs JOIN nd USING (tree, path) WHERE NOT is_leaf), (VALUES (false), (true)) f(far)
    WHERE (p > 0.2 OR depth = 0) AND (NOT far OR p > 0.5)
  ), hit AS (SELECT event_id, l0, l1, l2, {' + '.join(f'abs(l{d} - x{d})' for d in range(DIMS))} AS distance, log2(1 + total) / (depth + 1) AS s FROM qs JOIN nd USING (tree, path) JOIN tm USING (tree) WHERE is_leaf),
  own AS (SELECT event_id, l0, l1, l2, min(distance) AS distance, sum(s) / {PARAMS.num_trees} AS score FROM hit GROUP BY event_id, l0, l1, l2)
SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY distance, l0, l1, l2)::INT AS rank, {', '.join(f'{r(f"l{d}")} AS x{d}' for d in range(DIMS))}, {r('distance')} AS distance, {r('score')} AS score FROM own QUALIFY rank <= 3"""


def _holes(v, i):
    return F.when((F.col("event_id") + i) % 3 != 0, v)


def rcf_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the three dimensions of each event is missing."""
    forest, asked = _asked(spark, sf_dir)
    found = forest.impute(asked.withColumn("vec", F.transform("vec", _holes)))
    return found.select("event_id", *[rounded(F.col("imputed")[d], f"x{d}") for d in range(DIMS)])


_gone = lambda d: f"(event_id + {d}) % 3 = 0"
_missing_cut = f"CASE cut_dim WHEN 0 THEN {_gone(0)} WHEN 1 THEN {_gone(1)} ELSE {_gone(2)} END"
_distance = " + ".join(f"CASE WHEN {_gone(d)} THEN 0 ELSE abs(l{d} - x{d}) END" for d in range(DIMS))
IMPUTE_SQL = f"""{BUILT}, qs AS (
    SELECT event_id, x0, x1, x2, tree, '' AS path FROM pt, range({PARAMS.num_trees}) t(tree)
    UNION ALL
    SELECT event_id, x0, x1, x2, tree, path || side FROM (SELECT qs.*, cut_dim, cut_val FROM qs JOIN nd USING (tree, path) WHERE NOT is_leaf), (VALUES ('0'), ('1')) f(side)
    WHERE {_missing_cut} OR side = {_side}
  ), best AS (SELECT event_id, tree, x0, x1, x2, l0, l1, l2 FROM qs JOIN nd USING (tree, path) WHERE is_leaf QUALIFY row_number() OVER (PARTITION BY event_id, tree ORDER BY {_distance}, path) = 1)
SELECT event_id, {', '.join(f'{r(f"CASE WHEN {_gone(d)} THEN median(l{d}) ELSE max(x{d}) END")} AS x{d}' for d in range(DIMS))} FROM best GROUP BY event_id"""

SHINGLED = ForestParams(1, shingle_size=3, num_trees=8, capacity=64, seed=SEED)


def _shingled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value stream as whole shingles; the first ones, not full yet, stay out."""
    rows = points(spark, sf_dir)
    lagged = rows.select("event_id", "seq", F.col("value"))
    ahead = lagged.select((F.col("seq") + 1).alias("seq"), F.col("value").alias("v1"))
    further = lagged.select((F.col("seq") + 2).alias("seq"), F.col("value").alias("v2"))
    return lagged.join(ahead, "seq").join(further, "seq").select("event_id", "seq", F.array("v2", "v1", "value").alias("vec"))


def rcf_extrapolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shingled(spark, sf_dir)
    forest, _ = cut_forest.fit(rows, SHINGLED)
    forest.buffer = rows.orderBy(F.desc("seq")).select("vec").first()[0]
    found = forest.extrapolate(3)
    return spark.createDataFrame([(i, v) for i, v in enumerate(found)], "step int, value double").select("step", rounded("value"))


def _extrapolate_sql() -> str:
    built = BUILT.replace("pt AS (SELECT event_id, seq, tick, value AS x0, k AS x1, hour(ts)::DOUBLE AS x2 FROM ev)", "pt AS (SELECT event_id, seq, tick, lag(value, 2) OVER (ORDER BY seq) AS x0, lag(value, 1) OVER (ORDER BY seq) AS x1, value AS x2 FROM ev QUALIFY seq > 2)")
    steps, last = [], "SELECT x0, x1, x2 FROM pt ORDER BY seq DESC LIMIT 1"
    for i in range(3):
        d = 2 - i
        distance = " + ".join(f"abs(l{j} - x{j})" for j in range(3) if j != d)
        new = ", ".join(f"median(l{j}) AS x{j}" if j == d else f"max(x{j}) AS x{j}" for j in range(3))
        steps.append(f"""b{i} AS MATERIALIZED ({last}), q{i} AS (
    SELECT x0, x1, x2, tree, '' AS path FROM b{i}, range({SHINGLED.num_trees}) t(tree)
    UNION ALL SELECT x0, x1, x2, tree, path || side FROM (SELECT q{i}.*, cut_dim, cut_val FROM q{i} JOIN nd USING (tree, path) WHERE NOT is_leaf), (VALUES ('0'), ('1')) f(side) WHERE cut_dim = {d} OR side = {_side}
  ), m{i} AS (SELECT {new} FROM (SELECT * FROM q{i} JOIN nd USING (tree, path) WHERE is_leaf QUALIFY row_number() OVER (PARTITION BY tree ORDER BY {distance}, path) = 1))""")
        last = f"SELECT * FROM m{i}"
    out = " UNION ALL ".join(f"SELECT {i}::INT AS step, {r(f'x{2 - i}')} AS value FROM m{i}" for i in range(3))
    return f"{built}, {', '.join(steps)} {out}"


#: Ticks after which a new forest is frozen; the last one is asked about all that comes.
FROZEN = (0, 10, 20)


def rcf_frozen_prequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows scored by the forest as it was when their epoch began; the first score 0, and the last epoch ends with the table."""
    rows, out = points(spark, sf_dir), None
    for begin, end in zip(FROZEN, (*FROZEN[1:], None)):
        asked = rows.filter((F.col("tick") > begin) & (F.lit(True) if end is None else F.col("tick") <= end)).select("event_id", "vec")
        nodes = cut_forest.build(reservoir.sample_as_of(rows.select("seq", "vec", "tick"), PARAMS, "tick", begin), PARAMS)
        found = cut_forest.FrozenForest.collect(nodes, PARAMS).score(asked).select("event_id", rounded("score"))
        out = found if out is None else out.unionByName(found)
    return out


def _prequential_sql() -> str:
    parts = []
    for begin, end in zip(FROZEN, (*FROZEN[1:], None)):
        asked = f"tick > {begin}" + (f" AND tick <= {end}" if end else "")
        own = SCORE_SQL.replace(f"range({PARAMS.num_trees}) t(tree) )", f"range({PARAMS.num_trees}) t(tree) WHERE tick <= {begin})").replace(
            f"'' AS path, 1.0::DOUBLE AS w FROM pt, range({PARAMS.num_trees}) t(tree)", f"'' AS path, 1.0::DOUBLE AS w FROM pt, range({PARAMS.num_trees}) t(tree) WHERE {asked}"
        )
        parts.append(f"SELECT * FROM ({own})" if begin else f"SELECT event_id, 0.0::DOUBLE AS score FROM (WITH {EVENTS} SELECT * FROM ev WHERE {asked})")
    return " UNION ALL ".join(parts)


REPLAYED = ForestParams(3, num_trees=4, capacity=32, seed=SEED)
WINDOWED = IsolationParams(3, num_trees=4, window_size=256, max_leaf_samples=16, seed=SEED)


def rcf_replay_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event scored before it goes in, warm-up and evictions included."""
    rows = points(spark, sf_dir)
    found = replays.forest_scores(rows, REPLAYED)
    return rows.select("event_id", "seq").join(found, "seq").select("event_id", rounded("score"))


def oif_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event after it went into the window."""
    rows = points(spark, sf_dir)
    found = replays.isolation_scores(rows, WINDOWED)
    return rows.select("event_id", "seq").join(found, "seq").select("event_id", rounded("score"))


def oif_model_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The isolation forest of the last window, asked about all events."""
    rows = points(spark, sf_dir)
    return replays.isolation_answers(rows.select("event_id", "vec"), replays.isolation_model(rows, WINDOWED)).select("event_id", rounded("score"))


def rcf_lineitem_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default forest (50 trees of 256 rows) over all line items of four numbers, each scored."""
    rows = table(spark, sf_dir, "lineitem").withColumn("vec", vectors.point("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    rows = rows.withColumn("seq", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    params = ForestParams(4, seed=SEED, time_decay=1e-9)
    forest, _ = cut_forest.fit(rows, params, fast=True)
    asked = cut_forest.spread(rows.select("l_orderkey", "l_linenumber", "vec"))
    return forest.score(asked).select("l_orderkey", "l_linenumber", rounded("score"))


QUERIES = {
    "reservoir_weights": (reservoir_weights, f"WITH {sample_sql()} SELECT event_id, tree::INT AS tree, {r('weight')} AS weight FROM wt"),
    "reservoir_sample": (reservoir_sample, f"WITH {sample_sql()} SELECT event_id, tree::INT AS tree, rank FROM sm"),
    "reservoir_as_of_tick": (reservoir_as_of_tick, f"WITH {sample_sql(f'WHERE tick <= {AS_OF}')} SELECT event_id, tree::INT AS tree, rank FROM sm"),
    "rcf_nodes": (rcf_nodes, f"{BUILT} SELECT tree::INT AS tree, path, depth, cut_dim, {r('cut_val')} AS cut_val, is_leaf FROM nd"),
    "rcf_node_mass_bbox": (rcf_node_mass_bbox, f"{BUILT} SELECT tree::INT AS tree, path, mass::INT AS mass, {', '.join(f'{r(f"l{d}")} AS l{d}, {r(f"h{d}")} AS h{d}' for d in range(DIMS))} FROM nd"),
    "rcf_score": (rcf_score, SCORE_SQL),
    "rcf_displacement": (rcf_displacement, DISPLACEMENT_SQL),
    "rcf_density": (rcf_density, DENSITY_SQL),
    "rcf_attribution": (rcf_attribution, ATTRIBUTION_SQL),
    "rcf_neighbors": (rcf_neighbors, NEIGHBORS_SQL),
    "rcf_impute": (rcf_impute, IMPUTE_SQL),
    "rcf_extrapolate": (rcf_extrapolate, _extrapolate_sql()),
    "rcf_frozen_prequential": (rcf_frozen_prequential, _prequential_sql()),
    "rcf_replay_score": (rcf_replay_score, None),
    "oif_score": (oif_score, None),
    "oif_model_score": (oif_model_score, None),
    "rcf_lineitem_score": (rcf_lineitem_score, None),
}
