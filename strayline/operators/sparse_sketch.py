"""Surprise of sparse events whose feature names come and go.

An event is a map of names to numbers. Duplicate names are summed and asinh is taken;
random sparse projections of the values and of the names alone give two short vectors,
the latter with the number of names at its end. Chains of histograms of halving width
count the events in each bin with a half-life, in count sketches; an event's surprise at
a level is how empty its bin is against the bin's share of the volume. The largest of a
chain, the mean of the chains and the mean of both vectors is the score.

Events are scored before they are counted, at the epoch of the event before: a
closed form over the ordered stream. Cells are cut into blocks of epochs, so that the cell
most events fall into is still many partitions. Names are opaque; there is no registry
of them. Coefficients are made once for each name, not for each event.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, scoring
from ..params import SketchParams
from .sequence import numbered

PROJECTION_WIDTH = 4.0
COUNT_WIDTH = 2.0
#: Half-lives in a block: what is older than a block has decayed below 1e-240, and powers of two stay numbers.
BLOCK = 800


@dataclass(frozen=True)
class Level:
    ensemble: str
    chain: int
    level: int
    dim: int
    width: float
    offset: float
    ratio: float


def layout(params: SketchParams) -> list[Level]:
    """The levels of all chains: at most 2 * chains * depth rows, on the driver."""
    out, seed = [], params.seed or 0
    for ensemble, dims in (("value", params.value_projection_dims), ("presence", params.presence_projection_dims + 1)):
        for chain in range(params.chains_per_ensemble):
            for level in range(params.chain_depth):
                dim = hashing.bucket_of(dims, seed, "dim", ensemble, chain, level)
                base = COUNT_WIDTH if ensemble == "presence" and dim == dims - 1 else PROJECTION_WIDTH
                width = base / 2**level
                out.append(Level(ensemble, chain, level, dim, width, width * hashing.uniform_of(seed, "offset", ensemble, chain, level), width / base))
    return out


def normalised(events: DataFrame, id: list[str], features: str) -> DataFrame:
    """id, name, value: one row for each distinct name of an event whose map or array of (name, value) is in features.

    A name of which all values are 0 is present with value 0; an event without names has no row. NaN and
    infinite values are invalid and raise.
    """
    kind = events.schema[features].dataType.typeName()
    entries = F.map_entries(features) if kind == "map" else F.col(features)
    rows = events.select(*id, F.explode(entries).alias("__e")).select(*id, F.col("__e")[_part(events, features, 0)].alias("name"), F.col("__e")[_part(events, features, 1)].cast("double").alias("value"))
    bad = F.isnan("value") | (F.abs(F.col("value")) == F.lit(float("inf"))) | F.col("value").isNull() | F.col("name").isNull()
    rows = rows.withColumn("value", F.when(bad, F.raise_error(F.lit("a feature's value must be finite"))).otherwise(F.col("value")))
    return rows.groupBy(*id, "name").agg(F.asinh(F.sum("value")).alias("value"))


def _part(events: DataFrame, features: str, i: int) -> str:
    kind = events.schema[features].dataType
    return ("key", "value")[i] if kind.typeName() == "map" else kind.elementType.fieldNames()[i]


def coefficient(seed: int, channel: str, name: Column, dim: int, fast: bool = False) -> Column:
    pick = hashing.bucket(6, seed, channel, dim, name, fast=fast)
    return F.when(pick == 0, F.lit(math.sqrt(3))).when(pick == 1, F.lit(-math.sqrt(3))).otherwise(F.lit(0.0))


def coefficients(names: DataFrame, params: SketchParams, fast: bool = False) -> DataFrame:
    """name with arrays value_coef and presence_coef, once for each distinct name."""
    seed = params.seed or 0
    return names.select("name").distinct().select(
        "name",
        F.array(*[coefficient(seed, "value", F.col("name"), d, fast) for d in range(params.value_projection_dims)]).alias("value_coef"),
        F.array(*[coefficient(seed, "presence", F.col("name"), d, fast) for d in range(params.presence_projection_dims)]).alias("presence_coef"),
    )


def projected(events: DataFrame, id: list[str], features: str, params: SketchParams, fast: bool = False) -> DataFrame:
    """id, value (array) and presence (array, its last place ln(1 + names)). Events without names are zeros."""
    rows = normalised(events, id, features)
    rows = rows.join(coefficients(rows, params, fast), "name")
    sums = [F.sum(F.col("value") * F.col("value_coef")[d]).alias(f"__v{d}") for d in range(params.value_projection_dims)]
    sums += [F.sum(F.col("presence_coef")[d]).alias(f"__p{d}") for d in range(params.presence_projection_dims)]
    found = rows.groupBy(*id).agg(F.count("*").alias("__n"), *sums)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    value = F.array(*[zero(f"__v{d}") for d in range(params.value_projection_dims)])
    presence = F.array(*[zero(f"__p{d}") for d in range(params.presence_projection_dims)], F.log1p(F.coalesce(F.col("__n"), F.lit(0)).cast("double")))
    return events.select(*id).join(found, id, "left").select(*id, value.alias("value"), presence.alias("presence"))


def bin_of(vector: Column, level: Level) -> Column:
    # Sums of a vector's parts may differ in their last bits by the order of adding; bins must not.
    return F.floor(F.round((vector[level.dim] + F.lit(level.offset)) / F.lit(level.width), 9)).cast("long")


def bins(vectors: DataFrame, id: list[str], params: SketchParams) -> DataFrame:
    """id, ensemble, chain, level, ratio, bin: a row for each level of all chains."""
    own = [
        F.struct(F.lit(x.ensemble).alias("ensemble"), F.lit(x.chain).alias("chain"), F.lit(x.level).alias("level"), F.lit(x.ratio).alias("ratio"), bin_of(F.col(x.ensemble), x).alias("bin"))
        for x in layout(params)
    ]
    return vectors.select(*id, F.explode(F.array(*own)).alias("__b")).select(*id, "__b.*")


def sketch_cells(long: DataFrame, params: SketchParams, fast: bool = False) -> DataFrame:
    """long for each row of the sketch, with hash_row and bucket."""
    rows = long.withColumn("hash_row", F.explode(F.array(*[F.lit(r) for r in range(params.sketch_rows)])))
    return rows.withColumn("bucket", hashing.bucket(params.sketch_buckets, params.seed or 0, "cell", F.col("ensemble"), F.col("chain"), F.col("level"), F.col("hash_row"), F.col("bin"), fast=fast))


def reference_mass(seq: Column, half_life: int) -> Column:
    """Decayed number of the events before the one at seq, at the epoch of the last of them."""
    r = 0.5 ** (1 / half_life)
    return (F.lit(1.0) - F.pow(F.lit(r), (seq - 1).cast("double"))) / F.lit(1.0 - r)


def decayed_counts(cells: DataFrame, cell: list[str], half_life: int, seq: str = "seq", last: int | None = None) -> DataFrame:
    """cells with count: the cell's earlier rows, each halved every half_life epochs up to the epoch before seq. last: the largest seq, if it is known."""
    length = BLOCK * half_life
    rows = cells.withColumn("__block", F.floor((F.col(seq) - 1) / F.lit(length)).cast("long"))
    at = F.col(seq) - F.col("__block") * length
    power = lambda e: F.pow(F.lit(2.0), e.cast("double") / F.lit(float(half_life)))
    inside = Window.partitionBy(*cell, "__block").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum(power(at)).over(inside), F.lit(0.0)) * power(F.lit(1) - at))
    if last is not None and last <= length:
        return rows.select(*cells.columns, F.col("__inside").alias("count"))
    ends = rows.groupBy(*cell, "__block").agg(F.sum(power(at - length)).alias("__held"))
    before = Window.partitionBy(*cell).orderBy("__block")
    ends = ends.select(*cell, "__block", F.lag("__held").over(before).alias("__held"), ((F.lag("__block").over(before) + 1) * length).alias("__end"))
    a, b = rows.alias("a"), ends.alias("b")
    same = F.col("a.__block") == F.col("b.__block")
    for c in cell:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    carried = F.coalesce(F.col("b.__held") * power(F.col("b.__end") - (F.col(f"a.{seq}") - 1)), F.lit(0.0))
    return a.join(b, same).select(*[F.col(f"a.{c}") for c in cells.columns], (F.col("a.__inside") + carried).alias("count"))


def slots(vectors: DataFrame, id: list[str], params: SketchParams, fast: bool = False) -> DataFrame:
    """id, slot and bucket: a row for each level (its place in the layout) and row of the sketch, as slot = level * rows + row."""
    levels, rows = layout(params), params.sketch_rows
    found = vectors.select(*id, F.array(*[bin_of(F.col(x.ensemble), x) for x in levels]).alias("__bins"))
    own = []
    for i, x in enumerate(levels):
        for r in range(rows):
            bucket = hashing.bucket(params.sketch_buckets, params.seed or 0, "cell", F.lit(x.ensemble), F.lit(x.chain), F.lit(x.level), F.lit(r), F.col("__bins")[i], fast=fast)
            own.append(F.struct(F.lit(i * rows + r).alias("slot"), bucket.alias("bucket")))
    return found.select(*id, F.explode(F.array(*own)).alias("__s")).select(*id, "__s.*")


def _surprises(events: DataFrame, order: list[str], features: str, params: SketchParams, key: tuple[str, ...] = (), fast: bool = False) -> DataFrame:
    """id, level (its place in the layout) and surprise of each event before it is counted, dealt out by event."""
    id = [*key, *order, "seq"]
    rows = numbered(events.select(*dict.fromkeys([*key, *order, features])), order, "seq", by=key)
    # Each event becomes many rows: they are made where events are spread, and come back to them once for all that is summed up by event.
    by_event = [F.col(c) for c in (*key, "seq")]
    vectors = projected(rows, id, features, params, fast).repartition(*by_event)
    counted = decayed_counts(slots(vectors, id, params, fast), [*key, "slot", "bucket"], params.decay_half_life, last=events.count()).repartition(*by_event)
    low = counted.groupBy(*id, F.floor(F.col("slot") / params.sketch_rows).cast("int").alias("__level")).agg(F.min("count").alias("count"))
    ratio = F.element_at(F.array(*[F.lit(x.ratio) for x in layout(params)]), F.col("__level") + 1)
    return low.select(*id, "__level", scoring.surprise(F.col("count"), reference_mass(F.col("seq"), params.decay_half_life), ratio).alias("surprise"))


def level_surprises(events: DataFrame, order: list[str], features: str, params: SketchParams, key: tuple[str, ...] = (), fast: bool = False) -> DataFrame:
    """order, key, seq, ensemble, chain, level, surprise of each event before it is counted."""
    found = _surprises(events, order, features, params, key, fast)
    names = F.array(*[F.struct(F.lit(x.ensemble).alias("ensemble"), F.lit(x.chain).alias("chain"), F.lit(x.level).alias("level")) for x in layout(params)])
    return found.withColumn("__name", F.element_at(names, F.col("__level") + 1)).select(*key, *order, "seq", "__name.*", "surprise")


def fit_score(events: DataFrame, order: list[str], features: str, params: SketchParams, key: tuple[str, ...] = (), fast: bool = False) -> DataFrame:
    """key, order, seq and score of each event of the ordered stream. order must be unique for each key."""
    id = [*key, *order, "seq"]
    levels = _surprises(events, order, features, params, key, fast)
    # The layout has a chain's levels one after another.
    chains = levels.groupBy(*id, F.floor(F.col("__level") / params.chain_depth).alias("__chain")).agg(F.max("surprise").alias("surprise"))
    # Both ensembles have as many chains, so the mean of the means is the mean of all.
    return chains.groupBy(*id).agg(F.avg("surprise").alias("score"))


@dataclass
class SketchModel:
    """Decayed counts of all cells as of the last event, and how many events there were."""

    params: SketchParams
    cells: DataFrame
    entries_seen: int

    def score(self, queries: DataFrame, id: list[str], features: str, fast: bool = False) -> DataFrame:
        """id and score: surprise of each row against the model as it is."""
        vectors = projected(queries, id, features, self.params, fast).repartition(*[F.col(c) for c in id])
        long = sketch_cells(bins(vectors, id, self.params), self.params, fast)
        cell = ["ensemble", "chain", "level", "hash_row", "bucket"]
        low = long.join(self.cells, cell, "left").fillna(0.0, ["count"]).groupBy(*id, "ensemble", "chain", "level", "ratio").agg(F.min("count").alias("count"))
        mass = reference_mass(F.lit(self.entries_seen + 1), self.params.decay_half_life)
        low = low.withColumn("surprise", scoring.surprise(F.col("count"), mass, F.col("ratio")))
        return low.groupBy(*id, "ensemble", "chain").agg(F.max("surprise").alias("s")).groupBy(*id).agg(F.avg("s").alias("score"))


def fit(events: DataFrame, order: list[str], features: str, params: SketchParams, fast: bool = False) -> SketchModel:
    rows = numbered(events.select(*dict.fromkeys([*order, features])), order, "seq")
    id = [*order, "seq"]
    n = events.count()
    long = sketch_cells(bins(projected(rows, id, features, params, fast).repartition("seq"), id, params), params, fast)
    decayed = F.pow(F.lit(2.0), (F.col("seq") - n).cast("double") / F.lit(float(params.decay_half_life)))
    cells = long.groupBy("ensemble", "chain", "level", "hash_row", "bucket").agg(F.sum(decayed).alias("count"))
    return SketchModel(params, cells, n)
