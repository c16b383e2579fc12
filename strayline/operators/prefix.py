"""Running aggregates over long streams in two steps.

A stream is cut into ranges of its order. Each range is summed up; the sums of all
ranges before a row's own and the running aggregate inside its range give the result,
so no task holds more than one range. The range is a column that grows with the order,
such as a tick, or is made from quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import as_number, edges, range_of

#: For each aggregate: the function, and how a range's value joins what came before.
KINDS = {
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}
AGAIN = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def running(df: DataFrame, order: list[str], values: dict[str, tuple[str, Column]], by: tuple[str, ...] = (), inclusive: bool = True, range_by: str | None = None) -> DataFrame:
    """df with a column for each of values: name -> (kind, expression), over the rows up to this one (or before it)."""
    rows = df.withColumn("__range", F.col(range_by) if range_by else range_of(as_number(df, order[0]), edges(df, order[0])))
    for name, (_, e) in values.items():
        rows = rows.withColumn(f"__v_{name}", e)
    inner = [*by, "__range"]
    sums = rows.groupBy(*inner).agg(*[KINDS[k][0](f"__v_{n}").alias(f"__p_{n}") for n, (k, _) in values.items()])
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*inner, *[AGAIN[k](f"__p_{n}").over(earlier).alias(f"__b_{n}") for n, (k, _) in values.items()])
    own = Window.partitionBy(*inner).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    rows = rows.select("*", *[KINDS[k][0](f"__v_{n}").over(own).alias(f"__i_{n}") for n, (k, _) in values.items()])
    a, b = rows.alias("a"), sums.alias("b")
    same = F.col("a.__range").eqNullSafe(F.col("b.__range"))
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    out = [KINDS[k][1](F.col(f"b.__b_{n}"), F.col(f"a.__i_{n}")).alias(n) for n, (k, _) in values.items()]
    return a.join(b, same).select(*[F.col(f"a.{c}") for c in df.columns], *out)


def late(df: DataFrame, arrival: list[str], tick: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with ``late``: whether a row's tick is null, not above 0, or below one that arrived before it."""
    seen = running(df, arrival, {"__latest": ("max", F.when(F.col(tick) > 0, F.col(tick)))}, by=by, inclusive=False)
    bad = F.col(tick).isNull() | (F.col(tick) <= 0) | (F.coalesce(F.col(tick) < F.col("__latest"), F.lit(False)))
    return seen.withColumn("late", bad).drop("__latest")


def clock(df: DataFrame, time: str, name: str = "tick", by: tuple[str, ...] = ()) -> DataFrame:
    """df with the logical tick of each row: 1 at the smallest time, and one more for each unit after it."""
    if not by:
        first = df.agg(F.min(time)).first()[0]
        return df.withColumn(name, (F.col(time) - F.lit(first) + 1).cast("long"))
    return df.withColumn(name, (F.col(time) - F.min(time).over(Window.partitionBy(*by)) + 1).cast("long"))


def window_members(df: DataFrame, seq: str, size: int) -> DataFrame:
    """df with the first and last row number of the sliding window that ends at each row, and what leaves it."""
    first = F.greatest(F.lit(1), F.col(seq) - (size - 1))
    return df.withColumns({"window_first": first.cast("long"), "window_rows": (F.col(seq) - first + 1).cast("long"), "forgotten": F.when(F.col(seq) > size, F.col(seq) - size).cast("long")})
