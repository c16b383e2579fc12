"""Row numbers over a whole table without one task for all rows.

Ranges of the first order column split the rows; a row's number is its place in
its range plus the rows of all ranges before. Only the sizes of ranges, at most
``RANGES`` of them, meet in one task. A null order value comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 512
#: Rows of a range, about.
ROWS = 200_000


def as_number(df: DataFrame, column: str) -> Column:
    """A column of numbers or times as a double that keeps its order."""
    kind = df.schema[column].dataType.typeName()
    value = F.col(column)
    return (value.cast("timestamp") if kind in ("timestamp_ntz", "date") else value).cast("double")


def edges(df: DataFrame, column: str, ranges: int | None = None) -> list[float]:
    """Quantiles of a column that cut it into ranges of about ROWS rows."""
    value = as_number(df, column)
    if ranges is None:
        ranges = min(RANGES, df.count() // ROWS + 1)
    if ranges < 2:
        return []
    found = df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    return sorted(set(found))


def range_of(value: Column, cuts: list[float]) -> Column:
    # A balanced tree of comparisons.
    def pick(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(value <= F.lit(cuts[m]), pick(a, m)).otherwise(pick(m + 1, b))

    return F.when(value.isNull(), F.lit(-1)).otherwise(pick(0, len(cuts)))


def numbered(df: DataFrame, order: list[str], name: str = "seq", by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """df with the place of each row from 1 in the order of columns, for each value of by."""
    if name in df.columns:
        raise ValueError(f"df has a column {name}")
    cuts = edges(df, order[0], ranges)
    inner = [*by, "__range"]
    rows = df.withColumn("__range", range_of(as_number(df, order[0]), cuts))
    if not cuts:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*inner).orderBy(*order)).cast("long")).drop("__range") if by else _single(rows, order, name)
    sizes = rows.groupBy(*inner).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy(*inner).orderBy(*order)))
    a, b = rows.alias("a"), sizes.alias("b")
    same = F.col("a.__range") == F.col("b.__range")
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = a.join(b, same)
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a.__place") + F.col("b.__before")).cast("long").alias(name))


def _single(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    # One range: the whole table has no more rows than one range of a large one. A null first value is a range of its own.
    return rows.withColumn("__one", F.lit(0)).withColumn(name, F.row_number().over(Window.partitionBy("__one").orderBy(*order)).cast("long")).drop("__one", "__range")
