"""What the queries share: the event stream, and SQL for the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 7
DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with tick, the day from 1 on, and k from their properties."""
    rows = table(spark, sf_dir, "events")
    first = rows.agg(F.min(F.to_date("ts"))).first()[0]
    rows = rows.withColumn("tick", (F.datediff(F.to_date("ts"), F.lit(first)) + 1).cast("long"))
    return rows.withColumn("k", F.get_json_object("props", "$.k").cast("double"))


EVENTS = """ev AS (
  SELECT *, date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) + 1 AS tick,
    json_extract_string(props, '$.k')::DOUBLE AS k,
    row_number() OVER (ORDER BY ts, event_id) AS seq
  FROM events
)"""


def rounded(column: Column | str, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    out = F.round(c, DIGITS)
    # No negative zeros.
    return (out + F.lit(0.0)).alias(name or column)


def r(sql: str) -> str:
    return f"(round({sql}, {DIGITS}) + 0.0)"
