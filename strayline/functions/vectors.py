"""Points and shingles as array columns."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def point(*columns: str) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def _flat(rows: list[Column]) -> Column:
    return F.flatten(F.array(*rows)) if len(rows) > 1 else rows[0]


def _at(x: Column, back: int, dim: int, order: WindowSpec) -> Column:
    return F.coalesce(F.lag(x, back).over(order) if back else x, F.array_repeat(F.lit(0.0), dim))


def shingle(x: Column, size: int, dim: int, order: WindowSpec) -> Column:
    """What is put into the trees: the last ``size`` points, the oldest first, zeros where there are none yet."""
    return _flat([_at(x, j, dim, order) for j in range(size - 1, -1, -1)])


def shingle_query(x: Column, size: int, dim: int, order: WindowSpec) -> Column:
    """What is scored before the row goes in: the buffer with its newest place overwritten, so the row before is not in it."""
    return x if size == 1 else _flat([*[_at(x, j, dim, order) for j in range(size, 1, -1)], x])


def primed(seq: Column, size: int) -> Column:
    """Rows whose shingle is full."""
    return seq > size - 1


def ready(seq: Column, output_after: int, size: int) -> Column:
    return seq > output_after + size - 1


def missing(x: Column) -> Column:
    """The places of nulls in a point, from 0."""
    return F.filter(F.transform(x, lambda v, i: F.when(v.isNull(), i)), lambda i: i.isNotNull())


def dot(x: Column, weights: list[float]) -> Column:
    return sum((F.element_at(x, i + 1) * F.lit(w) for i, w in enumerate(weights)), F.lit(0.0))


def finite(x: Column) -> Column:
    """Whether no number of a point is null, NaN or infinite."""
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def in_order(*columns: str, by: tuple[str, ...] = ()) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*columns) if by else Window.orderBy(*columns)
