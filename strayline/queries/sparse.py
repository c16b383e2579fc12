"""Sparse-sketch queries: an event's features are its type, its user, its value and its k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import sparse_sketch
from ..params import SketchParams
from .common import EVENTS, SEED, events, r, rounded

PARAMS = SketchParams(value_projection_dims=4, presence_projection_dims=4, chains_per_ensemble=3, chain_depth=3, sketch_rows=2, sketch_buckets=64, decay_half_life=256, seed=SEED)
ORDER = ["ts", "event_id"]


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda name, value: F.struct(name.alias("name"), value.cast("double").alias("value"))
    # k comes twice, and both are summed.
    own = F.array(
        pair(F.concat(F.lit("type:"), "event_type"), F.lit(1.0)),
        pair(F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.lit(1.0)),
        pair(F.lit("value"), F.col("value")),
        pair(F.lit("k"), F.col("k")),
        pair(F.lit("k"), F.lit(1.0)),
    )
    return events(spark, sf_dir).withColumn("features", own)


NAMED = f"""{EVENTS}, f AS (SELECT event_id, seq, 'type:' || event_type AS name, asinh(1.0) AS value FROM ev UNION ALL SELECT event_id, seq, 'user:' || user_id, asinh(1.0) FROM ev
  UNION ALL SELECT event_id, seq, 'value', asinh(value) FROM ev UNION ALL SELECT event_id, seq, 'k', asinh(k + 1) FROM ev)"""


def _coefficient(channel: str, d: int) -> str:
    pick = hashing.bucket_sql(6, f"'{SEED}|{channel}|{d}|' || name")
    return f"CASE {pick} WHEN 0 THEN sqrt(3.0::DOUBLE) WHEN 1 THEN -sqrt(3.0::DOUBLE) ELSE 0.0 END"


PROJECTED = f"""{NAMED}, v AS (SELECT event_id, seq, {', '.join(f'sum(value * {_coefficient("value", d)}) AS v{d}' for d in range(4))}, {', '.join(f'sum({_coefficient("presence", d)}) AS p{d}' for d in range(4))}, ln(1 + count(*)) AS p4 FROM f GROUP BY event_id, seq)"""

_levels = sparse_sketch.layout(PARAMS)
_prefix = {"value": "v", "presence": "p"}
BINNED = f"""{PROJECTED}, b AS ({' UNION ALL '.join(f"SELECT event_id, seq, '{x.ensemble}' AS ensemble, {x.chain} AS chain, {x.level} AS level, {x.ratio}::DOUBLE AS ratio, floor(round(({_prefix[x.ensemble]}{x.dim} + {x.offset!r}::DOUBLE) / {x.width}::DOUBLE, 9))::BIGINT AS bin FROM v" for x in _levels)})"""
_bucket = hashing.bucket_sql(PARAMS.sketch_buckets, f"'{SEED}|cell|' || ensemble || '|' || chain || '|' || level || '|' || hash_row || '|' || bin")
_half = f"{PARAMS.decay_half_life}.0::DOUBLE"
COUNTED = f"""{BINNED}, c AS (SELECT b.*, hash_row, {_bucket} AS bucket FROM b, (VALUES (0), (1)) h(hash_row)),
  d AS (SELECT *, coalesce(sum(pow(2.0::DOUBLE, seq / {_half})) OVER (PARTITION BY ensemble, chain, level, hash_row, bucket ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * pow(2.0::DOUBLE, -(seq - 1) / {_half}) AS count FROM c),
  m AS (SELECT seq, coalesce(sum(pow(2.0::DOUBLE, seq / {_half})) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * pow(2.0::DOUBLE, -(seq - 1) / {_half}) AS mass FROM ev),
  s AS (SELECT event_id, ensemble, chain, level, -ln(least(1.0, greatest(1e-12, min(count) / greatest(mass, 1e-12) / ratio))) AS surprise FROM d JOIN m USING (seq) GROUP BY event_id, ensemble, chain, level, ratio, mass)"""


def sparse_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_sketch.normalised(featured(spark, sf_dir), ["event_id"], "features").select("event_id", "name", rounded("value"))


def feature_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sparse_sketch.projected(featured(spark, sf_dir), ["event_id"], "features", PARAMS)
    return found.select("event_id", rounded(F.element_at("presence", -1), "signal"))


def sparse_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sparse_sketch.projected(featured(spark, sf_dir), ["event_id"], "features", PARAMS)
    return found.select("event_id", *[rounded(F.col("value")[d], f"v{d}") for d in range(4)], *[rounded(F.col("presence")[d], f"p{d}") for d in range(5)])


def chain_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sparse_sketch.bins(sparse_sketch.projected(featured(spark, sf_dir), ["event_id"], "features", PARAMS), ["event_id"], PARAMS)
    return found.select("event_id", "ensemble", "chain", "level", "bin")


def decayed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each event type: its earlier events, halved every half-life of events."""
    from ..operators.sequence import numbered

    rows = numbered(events(spark, sf_dir), ORDER)
    return sparse_sketch.decayed_counts(rows, ["event_type"], PARAMS.decay_half_life).select("event_id", rounded("count"))


DECAYED_SQL = f"""WITH {EVENTS} SELECT event_id, {r(f'coalesce(sum(pow(2.0::DOUBLE, seq / {_half})) OVER (PARTITION BY event_type ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * pow(2.0::DOUBLE, -(seq - 1) / {_half})')} AS count FROM ev"""


def reference_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sequence import numbered

    rows = numbered(events(spark, sf_dir), ORDER)
    return rows.select("event_id", rounded(sparse_sketch.reference_mass(F.col("seq"), PARAMS.decay_half_life), "mass"))


def fs_level_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sparse_sketch.level_surprises(featured(spark, sf_dir), ORDER, "features", PARAMS)
    return found.select("event_id", "ensemble", "chain", "level", rounded("surprise"))


def fs_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_sketch.fit_score(featured(spark, sf_dir), ORDER, "features", PARAMS).select("event_id", rounded("score"))



def fs_model_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of all but the last tenth of the days, asked about the rest; nothing is counted."""
    rows = featured(spark, sf_dir)
    model = sparse_sketch.fit(rows.filter("tick <= 27"), ORDER, "features", PARAMS)
    return model.score(rows.filter("tick > 27"), ["event_id"], "features").select("event_id", rounded("score"))


MODEL_SQL = f"""WITH {BINNED}, c AS (SELECT b.*, hash_row, {_bucket} AS bucket FROM b, (VALUES (0), (1)) h(hash_row)),
  n AS (SELECT count(*) AS n FROM ev WHERE tick <= 27),
  held AS (SELECT ensemble, chain, level, hash_row, bucket, sum(pow(2.0::DOUBLE, (seq - n) / {_half})) AS count FROM c, n WHERE seq <= n GROUP BY ALL),
  m AS (SELECT sum(pow(2.0::DOUBLE, (seq - n) / {_half})) AS mass FROM ev, n WHERE seq <= n),
  s AS (SELECT event_id, ensemble, chain, level, -ln(least(1.0, greatest(1e-12, min(coalesce(count, 0)) / greatest(mass, 1e-12) / ratio))) AS surprise
    FROM c LEFT JOIN held USING (ensemble, chain, level, hash_row, bucket), m, n WHERE seq > n GROUP BY event_id, ensemble, chain, level, ratio, mass)
SELECT event_id, {r('avg(s)')} AS score FROM (SELECT event_id, ensemble, chain, max(surprise) AS s FROM s GROUP BY ALL) GROUP BY event_id"""

QUERIES = {
    "sparse_normalize": (sparse_normalize, f"WITH {NAMED} SELECT event_id, name, {r('value')} AS value FROM f"),
    "feature_count": (feature_count, f"WITH {PROJECTED} SELECT event_id, {r('p4')} AS signal FROM v"),
    "sparse_projection": (sparse_projection, f"WITH {PROJECTED} SELECT event_id, {', '.join(f'{r(c)} AS {c}' for c in ('v0', 'v1', 'v2', 'v3', 'p0', 'p1', 'p2', 'p3', 'p4'))} FROM v"),
    "chain_bins": (chain_bins, f"WITH {BINNED} SELECT event_id, ensemble, chain, level, bin FROM b"),
    "decayed_count": (decayed_count, DECAYED_SQL),
    "reference_mass": (reference_mass, f"WITH {COUNTED} SELECT event_id, {r('mass')} AS mass FROM m JOIN ev USING (seq)"),
    "fs_level_surprise": (fs_level_surprise, f"WITH {COUNTED} SELECT event_id, ensemble, chain, level, {r('surprise')} AS surprise FROM s"),
    "fs_score": (fs_score, f"WITH {COUNTED} SELECT event_id, {r('avg(s)')} AS score FROM (SELECT event_id, ensemble, chain, max(surprise) AS s FROM s GROUP BY ALL) GROUP BY event_id"),
    "fs_model_score": (fs_model_score, MODEL_SQL),
}
