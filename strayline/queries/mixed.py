"""Mixed-stream queries. The SQL is one plain window over the whole stream for each cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import mixed_stream
from ..operators.mixed_stream import MixedSpec
from ..params import MixedParams
from .common import EVENTS, SEED, events, r, rounded

ONE = MixedSpec(("value",), ("event_type",), "tick", ("ts", "event_id"))
TWO = MixedSpec(("value", "k"), ("event_type", "user_id"), "tick", ("ts", "event_id"))
BY_USER = MixedSpec(("value",), ("event_type",), "tick", ("ts", "event_id"), ("user_id",))


def params(spec: MixedSpec) -> MixedParams:
    return spec.params(num_rows=2, num_buckets=256, seed=SEED)


def score_names(spec: MixedSpec) -> list[str]:
    return ["record", *[f"numeric_{i}" for i in range(len(spec.numeric))], *[f"categorical_{j}" for j in range(len(spec.categorical))], "total"]


def _scored(spark: SparkSession, sf_dir: str, spec: MixedSpec) -> DataFrame:
    found = mixed_stream.fit_score(events(spark, sf_dir), spec, params(spec), first_tick=None if spec.key else 1)
    return found.select("event_id", *[rounded(n) for n in score_names(spec)])


def record_sql(spec: MixedSpec, p: MixedParams, row: int) -> str:
    signs = "0"
    for k, plane in enumerate(mixed_stream.planes(p, row)):
        dot = " + ".join(f"{c} * {w!r}::DOUBLE" for c, w in zip(spec.numeric, plane))
        signs += f" + CASE WHEN {dot} > 0 THEN {1 << k} ELSE 0 END"
    own = "0"
    for j, c in enumerate(spec.categorical):
        own += " + " + hashing.bucket_sql(p.num_buckets, f"'{SEED}|rec|{j}|{row}|' || {c}")
    return f"((({signs}) % {p.num_buckets}) + (({own}) % {p.num_buckets})) % {p.num_buckets}"


def cells_sql(spec: MixedSpec, p: MixedParams) -> str:
    """CTEs ev, n (with norms) and cells (seq, event_id, tick, key, feature, hash_row, bucket)."""
    by = f"PARTITION BY {', '.join(spec.key)} " if spec.key else ""
    key = "".join(f", {c}" for c in spec.key)
    a = ", ".join(f"min(asinh({c})) OVER w AS l{i}, max(asinh({c})) OVER w AS h{i}" for i, c in enumerate(spec.numeric))
    norms = ", ".join(f"CASE WHEN h{i} - l{i} <= 2.220446049250313e-16 THEN 0.0 ELSE (asinh({c}) - l{i}) / (h{i} - l{i}) END AS n{i}" for i, c in enumerate(spec.numeric))
    parts = [f"SELECT seq, event_id, tick{key}, 'n{i}' AS feature, 0 AS hash_row, least(greatest(floor(n{i} * {p.num_buckets}), 0), {p.num_buckets - 1})::INT AS bucket FROM n" for i in range(len(spec.numeric))]
    for row in range(p.num_rows):
        parts.append(f"SELECT seq, event_id, tick{key}, 'r', {row}, {record_sql(spec, p, row)} FROM n")
        parts += [f"SELECT seq, event_id, tick{key}, 'c{j}', {row}, {hashing.bucket_sql(p.num_buckets, f'{chr(39)}{SEED}|cat|{j}|{row}|{chr(39)} || {c}')} FROM n" for j, c in enumerate(spec.categorical)]
    return f"{EVENTS}, w AS (SELECT *, {a} FROM ev WINDOW w AS ({by}ORDER BY seq ROWS UNBOUNDED PRECEDING)), n AS (SELECT *, {norms} FROM w), cells AS ({' UNION ALL '.join(parts)})"


def score_sql(spec: MixedSpec, only: str = "") -> str:
    p = params(spec)
    key = ", ".join([*spec.key, "feature", "hash_row", "bucket"])
    first = f"min(tick) OVER (PARTITION BY {', '.join(spec.key)})" if spec.key else "1"
    names = {"r": "record"} | {f"n{i}": f"numeric_{i}" for i in range(len(spec.numeric))} | {f"c{j}": f"categorical_{j}" for j in range(len(spec.categorical))}
    scores = ", ".join(f"max(score) FILTER (feature = '{f}') AS {n}" for f, n in names.items())
    out = ", ".join(f"{r(n)} AS {n}" for n in names.values()) + f", {r(' + '.join(names.values()))} AS total"
    return f"""WITH {cells_sql(spec, p)},
  counted AS (SELECT *, count(*) OVER w AS total, sum(pow({p.alpha}::DOUBLE, -tick)) OVER w * pow({p.alpha}::DOUBLE, tick) AS current FROM cells WINDOW w AS (PARTITION BY {key} ORDER BY seq ROWS UNBOUNDED PRECEDING)),
  timed AS (SELECT *, (tick - {first} + 1)::DOUBLE AS t FROM counted),
  low AS (SELECT event_id, feature, t, min(total) / t AS m, min(current) - min(total) / t AS e FROM timed GROUP BY event_id, feature, t),
  scored AS (SELECT event_id, feature, e * e / m + e * e / (m * greatest(t - 1, 1)) AS score FROM low),
  wide AS (SELECT event_id, {scores} FROM scored GROUP BY event_id)
SELECT event_id, {out} FROM wide {only}"""


def mstream_event_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, ONE)


def mstream_detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, TWO)


def mstream_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, BY_USER)


def record_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = params(TWO)
    return events(spark, sf_dir).select("event_id", *[mixed_stream.record_bucket(TWO, p, i).alias(f"bucket_{i}") for i in range(p.num_rows)])


RECORD_SQL = f"WITH {EVENTS} SELECT event_id, {', '.join(f'({record_sql(TWO, params(TWO), i)})::INT AS bucket_{i}' for i in range(2))} FROM ev"


def mstream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = mixed_stream.fit(events(spark, sf_dir), ONE, params(ONE))
    return model.cells.select("feature", "hash_row", "bucket", "total", rounded("current"))


STATE_SQL = f"WITH {cells_sql(ONE, params(ONE))} SELECT feature, hash_row, bucket, count(*) AS total, {r(f'sum(pow({params(ONE).alpha}::DOUBLE, (SELECT max(tick) FROM ev) - tick))')} AS current FROM cells GROUP BY feature, hash_row, bucket"

#: Previews: the model of all days up to this one, asked about the first event of each user afterwards.
LAST = 20


def mstream_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    model = mixed_stream.fit(rows.filter(F.col("tick") <= LAST), TWO, params(TWO))
    found = model.score(rows.filter(F.col("tick") > LAST))
    return found.select("event_id", *[rounded(n) for n in score_names(TWO)])


def preview_sql() -> str:
    spec, p = TWO, params(TWO)
    norm = lambda i, c: f"CASE WHEN greatest(h{i}, asinh({c})) - least(l{i}, asinh({c})) <= 2.220446049250313e-16 THEN 0.0 ELSE (asinh({c}) - least(l{i}, asinh({c}))) / (greatest(h{i}, asinh({c})) - least(l{i}, asinh({c}))) END AS n{i}"
    past = cells_sql(spec, p).replace("FROM ev WINDOW", f"FROM ev WHERE tick <= {LAST} WINDOW")
    asked = cells_sql(spec, p)
    asked = asked[asked.index("cells AS (") + len("cells AS (") : -1].replace("FROM n", "FROM q")
    names = {"r": "record"} | {f"n{i}": f"numeric_{i}" for i in range(2)} | {f"c{j}": f"categorical_{j}" for j in range(2)}
    scores = ", ".join(f"max(score) FILTER (feature = '{f}') AS {n}" for f, n in names.items())
    out = ", ".join(f"{r(n)} AS {n}" for n in names.values()) + f", {r(' + '.join(names.values()))} AS total"
    ranges = ", ".join(f"min(asinh({c})) AS l{i}, max(asinh({c})) AS h{i}" for i, c in enumerate(spec.numeric))
    return f"""WITH {past}, g AS (SELECT {ranges}, max(tick) AS last FROM ev WHERE tick <= {LAST}),
  held AS (SELECT feature, hash_row, bucket, count(*) AS total, sum(pow({p.alpha}::DOUBLE, last - tick)) AS current FROM cells, g GROUP BY feature, hash_row, bucket),
  q AS (SELECT ev.*, last, {', '.join(norm(i, c) for i, c in enumerate(spec.numeric))} FROM ev, g WHERE tick > {LAST}),
  asked AS ({asked}),
  low AS (SELECT event_id, feature, tick::DOUBLE AS t, min(coalesce(total, 0)) + 1 AS n, min(coalesce(current, 0)) * pow({p.alpha}::DOUBLE, tick - last) + 1 AS c FROM asked LEFT JOIN held USING (feature, hash_row, bucket), g GROUP BY event_id, feature, tick, last),
  scored AS (SELECT event_id, feature, (c - n / t) * (c - n / t) / (n / t) * (1 + 1 / greatest(t - 1, 1)) AS score FROM low),
  wide AS (SELECT event_id, {scores} FROM scored GROUP BY event_id)
SELECT event_id, {out} FROM wide"""


QUERIES = {
    "mstream_event_score": (mstream_event_score, score_sql(ONE)),
    "mstream_detailed": (mstream_detailed, score_sql(TWO)),
    "mstream_by_user": (mstream_by_user, score_sql(BY_USER)),
    "record_hash": (record_hash, RECORD_SQL),
    "mstream_state": (mstream_state, STATE_SQL),
    "mstream_preview": (mstream_preview, preview_sql()),
}
