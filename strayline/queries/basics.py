"""Feature transforms, scalar formulas, clocks and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, scoring, vectors
from ..operators import mixed_stream, prefix
from ..operators.nearest import l1_nearest
from ..operators.sequence import numbered
from .common import EVENTS, SEED, events, r, rounded, table

SIZE = 4
ORDER = ["ts", "event_id"]


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(events(spark, sf_dir), ORDER)


def _shingles(spark: SparkSession, sf_dir: str, query: bool) -> DataFrame:
    # lag over one ordered stream; keyed streams partition it by entity.
    rows = _stream(spark, sf_dir).withColumn("x", vectors.point("value"))
    order = vectors.in_order("seq", by=("user_id",))
    made = (vectors.shingle_query if query else vectors.shingle)(F.col("x"), SIZE, 1, order)
    rows = rows.withColumn("s", made)
    return rows.select("event_id", *[F.col("s")[i].alias(f"s{i}") for i in range(SIZE)])


def shingle_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shingles(spark, sf_dir, False)


def shingle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shingles(spark, sf_dir, True)


_lag = lambda j: f"coalesce(lag(value, {j}) OVER w, 0.0)" if j else "value"
SHINGLE_SQL = f"WITH {EVENTS} SELECT event_id, {', '.join(f'{_lag(SIZE - 1 - i)} AS s{i}' for i in range(SIZE))} FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY seq)"
SHINGLE_QUERY_SQL = f"WITH {EVENTS} SELECT event_id, {', '.join(f'{_lag(SIZE - i if i < SIZE - 1 else 0)} AS s{i}' for i in range(SIZE))} FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY seq)"


def external_shingle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("p", vectors.point("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return rows.select("l_orderkey", "l_linenumber", *[F.col("p")[i].alias(f"p{i}") for i in range(4)])


EXTERNAL_SQL = "SELECT l_orderkey, l_linenumber, l_quantity AS p0, l_extendedprice AS p1, l_discount AS p2, l_tax AS p3 FROM lineitem"


def shingle_primed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir).filter(vectors.primed(F.col("seq"), SIZE)).select("event_id", "seq")


PRIMED_SQL = f"WITH {EVENTS} SELECT event_id, seq FROM ev WHERE seq > {SIZE - 1}"


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir).select("event_id", F.col("seq").alias("entries_seen"), vectors.ready(F.col("seq"), 65, SIZE).alias("ready"))


READY_SQL = f"WITH {EVENTS} SELECT event_id, seq AS entries_seen, seq > 65 + {SIZE - 1} AS ready FROM ev"


def epoch_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir).select("event_id", F.col("seq").alias("epoch"))


EPOCH_SQL = f"WITH {EVENTS} SELECT event_id, seq AS epoch FROM ev"


def logical_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("hour", F.floor(F.unix_timestamp("ts") / 3600))
    return prefix.clock(rows, "hour", by=("user_id",)).select("event_id", "tick")


CLOCK_SQL = "SELECT event_id, (epoch(ts)::BIGINT // 3600) - min(epoch(ts)::BIGINT // 3600) OVER (PARTITION BY user_id) + 1 AS tick FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)"


def late_data_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix.late(events(spark, sf_dir), ["user_id", "event_id"], "tick").select("event_id", "late")


LATE_SQL = f"WITH {EVENTS} SELECT event_id, coalesce(tick < max(tick) OVER (ORDER BY user_id, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM ev"


def sliding_window_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix.window_members(_stream(spark, sf_dir), "seq", 256).select("event_id", "window_first", "window_rows", "forgotten")


MEMBERS_SQL = f"WITH {EVENTS} SELECT event_id, min(seq) OVER w AS window_first, count(*) OVER w AS window_rows, CASE WHEN seq > 256 THEN seq - 256 END AS forgotten FROM ev WINDOW w AS (ORDER BY seq ROWS BETWEEN 255 PRECEDING AND CURRENT ROW)"

_spec = mixed_stream.MixedSpec(("value", "k"), (), "tick", ("ts", "event_id"))


def range_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_stream.normalised(events(spark, sf_dir), _spec).select("event_id", rounded("norm_0"), rounded("norm_1"))


_ranges = f"""WITH {EVENTS}, a AS (SELECT event_id, seq, asinh(value) AS a0, asinh(k) AS a1 FROM ev),
  b AS (SELECT *, min(a0) OVER w AS l0, max(a0) OVER w AS h0, min(a1) OVER w AS l1, max(a1) OVER w AS h1 FROM a WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)),
  n AS (SELECT event_id, CASE WHEN h0 - l0 <= 2.220446049250313e-16 THEN 0.0 ELSE (a0 - l0) / (h0 - l0) END AS n0, CASE WHEN h1 - l1 <= 2.220446049250313e-16 THEN 0.0 ELSE (a1 - l1) / (h1 - l1) END AS n1 FROM b)"""
RANGE_SQL = f"{_ranges} SELECT event_id, {r('n0')} AS norm_0, {r('n1')} AS norm_1 FROM n"


def numeric_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed_stream.normalised(events(spark, sf_dir), _spec)
    return rows.select("event_id", mixed_stream.numeric_bucket(F.round("norm_0", 9), 64).alias("bucket"))


BUCKET_SQL = f"{_ranges} SELECT event_id, least(greatest(floor(round(n0, 9) * 64), 0), 63)::INT AS bucket FROM n"


def _partly_null() -> list:
    return [F.when(F.col("value") < 50, F.col("value")), F.col("k"), F.when(F.col("k") >= 30, F.col("k"))]


def missing_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("x", F.array(*_partly_null()))
    gone = vectors.missing(F.col("x"))
    return rows.select("event_id", F.size(gone).alias("n_missing"), F.array_join(gone.cast("array<string>"), ",").alias("missing"))


MISSING_SQL = f"""WITH {EVENTS} SELECT event_id, (NOT coalesce(value < 50, false))::INT + (NOT coalesce(k >= 30, false))::INT AS n_missing,
  concat_ws(',', CASE WHEN NOT value < 50 THEN '0' END, CASE WHEN NOT k >= 30 THEN '2' END) AS missing FROM ev"""


def record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumns({"bad": F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")), "when": F.col("tick") - 3})
    spec = mixed_stream.MixedSpec(("bad", "k"), ("event_type",), "when", ("ts", "event_id"))
    return rows.select("event_id", mixed_stream.valid(rows, spec).alias("valid"), vectors.finite(F.array("bad", "k")).alias("finite"))


VALID_SQL = f"WITH {EVENTS} SELECT event_id, event_id % 7 <> 0 AND tick - 3 > 0 AS valid, event_id % 7 <> 0 AS finite FROM ev"


def tree_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    depth, mass, total = F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.lit(64)
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        rounded(scoring.seen(depth, mass), "seen"),
        rounded(scoring.unseen(depth), "unseen"),
        rounded(scoring.normalised(scoring.unseen(depth), total), "normalised"),
        rounded(scoring.damp(mass, total), "damp"),
        rounded(scoring.displacement_seen(mass), "displacement_seen"),
        rounded(scoring.displacement_unseen(mass), "displacement_unseen"),
        rounded(scoring.displacement_normalised(scoring.displacement_unseen(mass), total), "displacement_normalised"),
        rounded(scoring.blend(F.col("l_discount"), scoring.unseen(depth), F.lit(1.0)), "blend"),
    )


TREE_SQL = f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_discount, l_linenumber AS d, l_quantity::INT AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, {r('1 / (d + log2(1 + m))')} AS seen, {r('1 / (d + 1.0)')} AS unseen, {r('1 / (d + 1.0) * log2(65)')} AS normalised,
  {r('1 - m / (2 * 64)')} AS damp, {r('1 / (1.0 + m)')} AS displacement_seen, {r('m::DOUBLE')} AS displacement_unseen, {r('m / 65.0')} AS displacement_normalised,
  {r('(1 - l_discount) * (1 / (d + 1.0)) + l_discount')} AS blend FROM t"""


def isolation_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    depth, height = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        rounded(scoring.split_threshold(8, depth.cast("double")), "split_threshold"),
        rounded(scoring.residual_depth(height, 8), "residual"),
        rounded(scoring.isolation_score(depth + scoring.residual_depth(height, 8), 5.0), "score"),
    )


ISOLATION_SQL = f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_linenumber AS d, CASE WHEN l_quantity::INT < 8 THEN 0.0 ELSE log2(l_quantity::INT / 8) END AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, {r('8 * pow(2.0, d)')} AS split_threshold, {r('r')} AS residual, {r('pow(2.0, -(d + r) / 5.0)')} AS score FROM t"""

_dims = ("l_quantity", "l_discount", "l_tax")


def cut_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    inner = rows.filter((F.col("l_linenumber") == 1) & (F.col("l_quantity") < 30) & (F.col("l_discount") < 0.05))
    boxes = inner.groupBy("l_returnflag").agg(F.array(*[F.min(c) for c in _dims]).alias("low"), F.array(*[F.max(c) for c in _dims]).alias("high"))
    both = rows.join(boxes, "l_returnflag")
    return both.select("l_orderkey", "l_linenumber", rounded(scoring.cut_probability(F.col("low"), F.col("high"), vectors.point(*_dims)), "probability"))


_excess = " + ".join(f"greatest(0, l{i} - {c}) + greatest(0, {c} - h{i})" for i, c in enumerate(_dims))
_width = " + ".join(f"(h{i} - l{i})" for i in range(3))
CUT_SQL = f"""WITH b AS (SELECT l_returnflag, {', '.join(f'min({c}) AS l{i}, max({c}) AS h{i}' for i, c in enumerate(_dims))} FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 30 AND l_discount < 0.05 GROUP BY l_returnflag),
  e AS (SELECT l_orderkey, l_linenumber, {_excess} AS excess, {_width} AS width FROM lineitem JOIN b USING (l_returnflag))
SELECT l_orderkey, l_linenumber, {r('CASE WHEN excess <= 0 THEN 0.0 WHEN width <= 0 THEN 1.0 ELSE excess / (width + excess) END')} AS probability FROM e"""


def l1_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    # Places where the first is negative are taken as missing.
    known = F.transform("e", lambda v: F.when(v >= 0, v))
    return rows.join(other, "vec_id").select("vec_id", rounded(scoring.l1(F.col("e"), F.col("f")), "distance"), rounded(scoring.l1_where_known(known, F.col("f")), "known_distance"))


L1_SQL = f"""WITH p AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, {r('sum(abs(x - y))')} AS distance, {r('coalesce(sum(abs(x - y)) FILTER (x >= 0), 0)')} AS known_distance FROM p GROUP BY vec_id"""


def l1_knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors for each id divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    found = l1_nearest(rows.filter("vec_id % 50 = 0"), rows, 5, "vec_id", "embedding")
    return found.select("query_id", F.col("id").alias("vec_id"), rounded("distance"), "rank")


KNN_SQL = f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
  d AS (SELECT query_id, vec_id, {r('sum(abs(x - y))')} AS distance FROM p GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 5"""


def attribution_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    a = F.struct(F.col("l_discount").alias("below"), F.col("l_tax").alias("above"))
    b = F.struct(F.col("l_tax").alias("below"), F.lit(0.5).alias("above"))
    s = scoring.attribution_scaled(scoring.attribution_sum(a, b), F.col("l_quantity"))
    return rows.select("l_orderkey", "l_linenumber", rounded(scoring.attribution_total(a), "total"), rounded(s["below"], "below"), rounded(s["above"], "above"))


ATTRIBUTION_SQL = f"SELECT l_orderkey, l_linenumber, {r('l_discount + l_tax')} AS total, {r('(l_discount + l_tax) * l_quantity')} AS below, {r('(l_tax + 0.5) * l_quantity')} AS above FROM lineitem"


def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value") + 1
    return table(spark, sf_dir, "events").select("event_id", rounded(F.ln(v), "ln"), rounded(F.log2(v), "log2"), rounded(F.log1p(v), "ln_1p"), rounded(F.pow(v, F.lit(0.25)), "power"), F.floor(v).alias("floor"), rounded(F.asinh(v), "asinh"))


MATH_SQL = f"SELECT event_id, {r('ln(v)')} AS ln, {r('log2(v)')} AS log2, {r('ln(1 + v)')} AS ln_1p, {r('pow(v, 0.25)')} AS power, floor(v)::BIGINT AS floor, {r('asinh(v)')} AS asinh FROM (SELECT event_id, value + 1 AS v FROM events)"


def seeded_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", hashing.bucket(1024, SEED, "u", F.col("user_id"), F.col("event_id")).alias("bucket"), hashing.uniform(SEED, F.col("event_id")).alias("uniform"))


_key = f"'{SEED}|u|' || user_id || '|' || event_id"
HASH_SQL = f"SELECT event_id, {hashing.bucket_sql(1024, _key)} AS bucket, {hashing.uniform_sql(f'{chr(39)}{SEED}|{chr(39)} || event_id')} AS uniform FROM events"


def chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's events of the last day against all days."""
    rows = events(spark, sf_dir)
    last = rows.agg(F.max("tick")).first()[0]
    own = rows.groupBy("user_id").agg(F.count("*").cast("double").alias("total"), F.count_if(F.col("tick") == last).cast("double").alias("current"))
    tick = F.lit(float(last))
    return own.select("user_id", rounded(scoring.chi_square(F.col("current"), F.col("total"), tick), "score"), rounded(scoring.chi_square_preview(F.col("current"), F.col("total"), F.lit(0.8), tick), "preview"))


CHI_SQL = f"""WITH {EVENTS}, m AS (SELECT max(tick)::DOUBLE AS t FROM ev), o AS (SELECT user_id, count(*)::DOUBLE AS n, (count(*) FILTER (tick = t))::DOUBLE AS c, t FROM ev, m GROUP BY user_id, t),
  s AS (SELECT user_id, t, n / t AS m1, c - n / t AS e1, (n + 1) / t AS m2, c * 0.8 + 1 - (n + 1) / t AS e2 FROM o)
SELECT user_id, {r('e1 * e1 / m1 + e1 * e1 / (m1 * greatest(t - 1, 1))')} AS score, {r('e2 * e2 / m2 + e2 * e2 / (m2 * greatest(t - 1, 1))')} AS preview FROM s"""


def median_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(rounded(F.median("value"), "median"), rounded(F.avg("value"), "mean"))


MEDIAN_SQL = f"SELECT user_id, {r('median(value)')} AS median, {r('avg(value)')} AS mean FROM events GROUP BY user_id"

QUERIES = {
    "shingle_insert": (shingle_insert, SHINGLE_SQL),
    "shingle_query": (shingle_query, SHINGLE_QUERY_SQL),
    "external_shingle": (external_shingle, EXTERNAL_SQL),
    "shingle_primed": (shingle_primed, PRIMED_SQL),
    "readiness": (readiness, READY_SQL),
    "epoch_counter": (epoch_counter, EPOCH_SQL),
    "logical_clock": (logical_clock, CLOCK_SQL),
    "late_data_rejects": (late_data_rejects, LATE_SQL),
    "sliding_window_members": (sliding_window_members, MEMBERS_SQL),
    "range_normalize": (range_normalize, RANGE_SQL),
    "numeric_bucket": (numeric_bucket, BUCKET_SQL),
    "missing_mask": (missing_mask, MISSING_SQL),
    "record_validation": (record_validation, VALID_SQL),
    "tree_formulas": (tree_formulas, TREE_SQL),
    "isolation_formulas": (isolation_formulas, ISOLATION_SQL),
    "cut_probability": (cut_probability, CUT_SQL),
    "l1_distance": (l1_distance, L1_SQL),
    "l1_knn_exact": (l1_knn_exact, KNN_SQL),
    "attribution_algebra": (attribution_algebra, ATTRIBUTION_SQL),
    "math_functions": (math_functions, MATH_SQL),
    "seeded_hash": (seeded_hash, HASH_SQL),
    "chi_square": (chi_square, CHI_SQL),
    "median_by_group": (median_by_group, MEDIAN_SQL),
}
