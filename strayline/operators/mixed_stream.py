"""Scores of mixed records by how their counts differ from past ticks.

Each number falls into a bin of its running range, each category into the buckets of a
count sketch, and the whole record into buckets by the signs of its numbers against random
planes and the hashes of its categories. A cell counts its rows twice: in total, and with
what it had decaying by ``alpha`` a tick. A row is counted and then scored by its
own counts, so every score is a closed form: all of earlier ticks, plus the rows of the
same tick and cell up to this one. Cells are summed by tick first, so that a cell that
most rows share is still cut by tick, and no global order is sorted.

``tick`` is a logical time above 0 that doesn't fall; ``order`` orders rows inside a tick
and names them, so its values must be unique for each key. Invalid rows (``valid``) must
be filtered first. With ``key`` every key has a stream of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, scoring
from ..params import MixedParams
from .prefix import running


@dataclass(frozen=True)
class MixedSpec:
    """Which columns are what."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    tick: str
    order: tuple[str, ...]
    key: tuple[str, ...] = ()

    def params(self, **more) -> MixedParams:
        return MixedParams(len(self.numeric), len(self.categorical), **more)


def valid(df: DataFrame, spec: MixedSpec) -> Column:
    """Rows with finite numbers, all categories, and a tick above 0."""
    ok = F.col(spec.tick).isNotNull() & (F.col(spec.tick) > 0)
    for c in spec.numeric:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < F.lit(float("inf")))
    for c in spec.categorical:
        ok = ok & F.col(c).isNotNull()
    return ok


def normalised(df: DataFrame, spec: MixedSpec) -> DataFrame:
    """df with norm_i for each number: asinh in the range of all rows so far, this one too; 0 while the range is empty."""
    if not spec.numeric:
        return df
    scaled = {f"__a{i}": F.asinh(F.col(c).cast("double")) for i, c in enumerate(spec.numeric)}
    df = df.withColumns(scaled)
    values = {}
    for a in scaled:
        values[f"{a}_low"], values[f"{a}_high"] = ("min", F.col(a)), ("max", F.col(a))
    df = running(df, list(spec.order), values, by=spec.key, range_by=spec.tick)
    for i in range(len(spec.numeric)):
        low, high = F.col(f"__a{i}_low"), F.col(f"__a{i}_high")
        df = df.withColumn(f"norm_{i}", F.when(high - low <= scoring.EPSILON, F.lit(0.0)).otherwise((F.col(f"__a{i}") - low) / (high - low)))
    return df.drop(*scaled, *values)


def numeric_bucket(norm: Column, buckets: int) -> Column:
    return F.least(F.greatest(F.floor(norm * F.lit(buckets)), F.lit(0)), F.lit(buckets - 1)).cast("int")


def category_bucket(value: Column, params: MixedParams, column: int, row: int, fast: bool = False) -> Column:
    return hashing.bucket(params.num_buckets, params.seed or 0, "cat", column, row, value, fast=fast)


def planes(params: MixedParams, row: int) -> list[list[float]]:
    """The random planes of a hash row: a small driver-side table, the same for every run with the seed."""
    return [[hashing.gaussian_of(params.seed or 0, "plane", row, k, d) for d in range(params.numeric_dim)] for k in range(params.planes)]


def record_bucket(spec: MixedSpec, params: MixedParams, row: int, fast: bool = False) -> Column:
    """Sign bits of the raw numbers plus the hashes of the categories, modulo the buckets."""
    signs: Column = F.lit(0)
    if spec.numeric:
        for k, plane in enumerate(planes(params, row)):
            total: Column = F.lit(0.0)
            for c, w in zip(spec.numeric, plane):
                total = total + F.col(c).cast("double") * F.lit(w)
            signs = signs + F.when(total > 0, F.lit(1 << k)).otherwise(F.lit(0))
    own: Column = F.lit(0)
    for j, c in enumerate(spec.categorical):
        own = own + hashing.bucket(params.num_buckets, params.seed or 0, "rec", j, row, F.col(c), fast=fast)
    return F.pmod(F.pmod(signs, F.lit(params.num_buckets)) + F.pmod(own, F.lit(params.num_buckets)), F.lit(params.num_buckets)).cast("int")


def cells(df: DataFrame, spec: MixedSpec, params: MixedParams, fast: bool = False) -> DataFrame:
    """One row for each record and cell it falls into: key, tick, order, feature, hash_row, bucket. df has norm_i."""
    out = [F.struct(F.lit(f"n{i}").alias("feature"), F.lit(0).alias("hash_row"), numeric_bucket(F.col(f"norm_{i}"), params.num_buckets).alias("bucket")) for i in range(len(spec.numeric))]
    for r in range(params.num_rows):
        out.append(F.struct(F.lit("r").alias("feature"), F.lit(r).alias("hash_row"), record_bucket(spec, params, r, fast).alias("bucket")))
        out += [F.struct(F.lit(f"c{j}").alias("feature"), F.lit(r).alias("hash_row"), category_bucket(F.col(c), params, j, r, fast).alias("bucket")) for j, c in enumerate(spec.categorical)]
    keep = [*spec.key, spec.tick, *spec.order]
    return df.select(*keep, F.explode(F.array(*out)).alias("__cell")).select(*keep, "__cell.*")


def block_length(decay_per_step: float) -> int:
    """Steps over which powers of the decay stay within 1e100."""
    return max(1, int(230 / -math.log(decay_per_step)))


def decayed_before(counts: DataFrame, cell: list[str], step: str, n: str, decay: float, name: str = "current_before") -> DataFrame:
    """counts: one row for each cell and step. Adds what the cell held before the step, decayed to it.

    Sums of powers run inside blocks of steps; a block also gets what the block before it
    held at its end. What is older has decayed below 1e-100 of it.
    """
    length = block_length(decay)
    block = F.floor(F.col(step) / F.lit(length)).cast("long")
    rows = counts.withColumn("__block", block)
    at = (F.col(step) - F.col("__block") * length).cast("double")
    inside = Window.partitionBy(*cell, "__block").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    power = lambda e: F.pow(F.lit(decay), e)
    rows = rows.withColumn("__inside", F.coalesce(F.sum(F.col(n) * power(-at)).over(inside), F.lit(0.0)) * power(at))
    ends = rows.groupBy(*cell, "__block").agg(F.sum(F.col(n) * power(F.lit(length - 1.0) - at)).alias("__held"))
    before = Window.partitionBy(*cell).orderBy("__block")
    ends = ends.select(*cell, "__block", F.lag("__held").over(before).alias("__held"), ((F.lag("__block").over(before) + 1) * length - 1).alias("__end"))
    a, b = rows.alias("a"), ends.alias("b")
    same = F.col("a.__block") == F.col("b.__block")
    for c in cell:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    carried = F.coalesce(F.col("b.__held") * power((F.col(f"a.{step}") - F.col("b.__end")).cast("double")), F.lit(0.0))
    return a.join(b, same).select(*[F.col(f"a.{c}") for c in counts.columns], (F.col("a.__inside") + carried).alias(name))


def cell_counts(long: DataFrame, spec: MixedSpec, params: MixedParams) -> DataFrame:
    """long with total and current, both with this row."""
    cell = [*spec.key, "feature", "hash_row", "bucket"]
    ticks = long.groupBy(*cell, spec.tick).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*cell).orderBy(spec.tick).rowsBetween(Window.unboundedPreceding, -1)
    ticks = ticks.withColumn("__total", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    ticks = decayed_before(ticks, cell, spec.tick, "__n", params.alpha, "__current")
    here = Window.partitionBy(*cell, spec.tick).orderBy(*spec.order)
    rows = long.withColumn("__place", F.row_number().over(here))
    a, b = rows.alias("a"), ticks.alias("b")
    same = F.col(f"a.{spec.tick}") == F.col(f"b.{spec.tick}")
    for c in cell:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    total = (F.col("b.__total") + F.col("a.__place")).cast("long").alias("total")
    return a.join(b, same).select(*[F.col(f"a.{c}") for c in long.columns], total, (F.col("b.__current") + F.col("a.__place")).alias("current"))


def fit_score(df: DataFrame, spec: MixedSpec, params: MixedParams, first_tick: int | None = None, fast: bool = False) -> DataFrame:
    """One row for each record: key, tick, order, record, numeric_i, categorical_j and total, its scores.

    Ticks count from the first one, for each key, unless first_tick gives it.
    """
    if first_tick is None and not spec.key:
        first_tick = df.agg(F.min(spec.tick)).first()[0] or 1
    long = cell_counts(cells(normalised(df, spec), spec, params, fast), spec, params)
    names = [*spec.key, spec.tick, *spec.order]
    first = F.lit(first_tick) if first_tick is not None else F.min(spec.tick).over(Window.partitionBy(*spec.key))
    # The smaller of a sketch's rows, for each feature; then all features of a record side by side.
    features = ["r", *[f"n{i}" for i in range(len(spec.numeric))], *[f"c{j}" for j in range(len(spec.categorical))]]
    low = []
    for f in features:
        own = F.col("feature") == f
        low += [F.min(F.when(own, F.col("total"))).alias(f"__t_{f}"), F.min(F.when(own, F.col("current"))).alias(f"__c_{f}")]
    rows = long.groupBy(*names).agg(*low)
    rows = rows.withColumn("__tick", (F.col(spec.tick) - first + 1).cast("double"))
    score = lambda f: scoring.chi_square(F.col(f"__c_{f}"), F.col(f"__t_{f}").cast("double"), F.col("__tick"))
    named = {"r": "record"} | {f"n{i}": f"numeric_{i}" for i in range(len(spec.numeric))} | {f"c{j}": f"categorical_{j}" for j in range(len(spec.categorical))}
    rows = rows.select(*names, *[score(f).alias(n) for f, n in named.items()])
    return rows.withColumn("total", sum((F.col(n) for n in named.values()), F.lit(0.0)))


def beside(rows: DataFrame, facts: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """rows with the columns of facts: of their key, or, without one, of the only row there is, as literals."""
    if key:
        return rows.join(facts, list(key), "left")
    row = facts.first()
    return rows.withColumns({f.name: F.lit(row[f.name] if row else None).cast(f.dataType) for f in facts.schema.fields})


@dataclass
class MixedModel:
    """What a stream has left behind: counts by cell as of the last tick, and the numbers' ranges.

    ``cells`` and ``ranges`` are DataFrames, with a row for each key's cell and each key.
    """

    spec: MixedSpec
    params: MixedParams
    cells: DataFrame
    ranges: DataFrame

    def score(self, queries: DataFrame, fast: bool = False) -> DataFrame:
        """Previews: the score each row would get as the next one, at its own tick. Nothing is counted."""
        spec, params = self.spec, self.params
        names = [*spec.key, spec.tick, *spec.order]
        q = beside(queries, self.ranges, spec.key)
        for i, c in enumerate(spec.numeric):
            a = F.asinh(F.col(c).cast("double"))
            low, high = F.least(F.col(f"low_{i}"), a), F.greatest(F.col(f"high_{i}"), a)
            q = q.withColumn(f"norm_{i}", F.when(high - low <= scoring.EPSILON, F.lit(0.0)).otherwise((a - low) / (high - low)))
        long = cells(q, spec, params, fast)
        cell = [*spec.key, "feature", "hash_row", "bucket"]
        long = long.join(self.cells, cell, "left").fillna(0, ["total", "current"])
        ranges = self.ranges.select(*spec.key, "first_tick", "last_tick")
        long = beside(long, ranges, spec.key)
        features = ["r", *[f"n{i}" for i in range(len(spec.numeric))], *[f"c{j}" for j in range(len(spec.categorical))]]
        low = [F.min(F.when(F.col("feature") == f, F.col(v))).alias(f"__{v[0]}_{f}") for f in features for v in ("total", "current")]
        rows = long.groupBy(*names).agg(*low, F.min("first_tick").alias("__first"), F.min("last_tick").alias("__last"))
        rows = rows.withColumn("__tick", F.coalesce(F.col(spec.tick) - F.col("__first") + 1, F.lit(1)).cast("double"))
        decay = F.pow(F.lit(params.alpha), F.coalesce((F.col(spec.tick) - F.col("__last")), F.lit(0)).cast("double"))
        score = lambda f: scoring.chi_square_preview(F.col(f"__c_{f}"), F.col(f"__t_{f}").cast("double"), decay, F.col("__tick"))
        named = {"r": "record"} | {f"n{i}": f"numeric_{i}" for i in range(len(spec.numeric))} | {f"c{j}": f"categorical_{j}" for j in range(len(spec.categorical))}
        rows = rows.select(*names, *[score(f).alias(n) for f, n in named.items()])
        return rows.withColumn("total", sum((F.col(n) for n in named.values()), F.lit(0.0)))


def fit(df: DataFrame, spec: MixedSpec, params: MixedParams, fast: bool = False) -> MixedModel:
    """The model after all rows of df."""
    cell = [*spec.key, "feature", "hash_row", "bucket"]
    asinh = [F.asinh(F.col(c).cast("double")) for c in spec.numeric]
    sums = [f(a).alias(f"{n}_{i}") for i, a in enumerate(asinh) for f, n in ((F.min, "low"), (F.max, "high"))]
    ranges = df.groupBy(*spec.key).agg(F.min(spec.tick).alias("first_tick"), F.max(spec.tick).alias("last_tick"), F.count("*").alias("entries_seen"), *sums)
    long = cells(normalised(df, spec), spec, params, fast)
    ticks = long.groupBy(*cell, spec.tick).agg(F.count("*").alias("n"))
    last = ranges.select(*spec.key, "last_tick")
    ticks = beside(ticks, last, spec.key)
    decayed = F.col("n") * F.pow(F.lit(params.alpha), (F.col("last_tick") - F.col(spec.tick)).cast("double"))
    held = ticks.groupBy(*cell).agg(F.sum("n").alias("total"), F.sum(decayed).alias("current"))
    return MixedModel(spec, params, held, ranges)
