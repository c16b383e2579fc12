"""Mix sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. A source is range-sorted by that key: the
key's first bits name a bin, the sums of the bins give distributed prefix sums,
and only the one bin that holds a source's cut is sorted by row. What comes out
is one cut for each source, so that no text and no whole source is shuffled: a
row compares its own key with its source's cut. A source with a budget above its
size is taken whole for each full epoch, and its cut lies in the next one. The
document at the cut gives just the words that are missing, so that a source's
words equal its budget.

Sizes are numbers of words; null texts have none. Sources sort by code point
with null last, and weigh as ``WEIGHTS`` repeats. All targets share ``SHARE`` of
all sizes; a target stops at ``CAP`` times its source's size and what it leaves
goes to the others by weight. Rows order by key, then id, then size; rows that
repeat all three at a cut share its words evenly, rounded down. An empty table
gives an empty result; a source without words has target 0. What grows with the
number of sources, not of rows, is sorted in one task: a row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_RUN, WORD, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = 17
#: Rows of a bin, about: what one task sorts to find a cut, were all rows of one source.
BIN_ROWS = 512


def n_words(text: Column) -> Column:
    spaced = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " "))
    return F.when(spaced == "", F.lit(0)).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1).cast("long")


def random_key(id: Column, size: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")), F.lit(":"), size.cast("string")).cast("binary"))


def key_bin(key: Column, bits: int) -> Column:
    """The first bits of a key written in hexadecimal."""
    return F.shiftright(F.conv(F.substring(key, 1, 10), 16, 10).cast("long"), 40 - bits)


def targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Adds weight and target to rows of source and source_size.

    Sources fill up in the order of size by weight. At each one the level is what
    the rest of the budget gives for each unit of the weights not yet full; the
    first source that this level doesn't fill has the level of all after it.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sums.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.lit(cap) * F.col("source_size")
    left = F.lit(share) * F.sum("source_size").over(everything) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    steps = ranked.withColumn("level", left / weight)
    steps = steps.withColumn("level", F.first(F.when(F.col("level") * F.col("weight") < full, F.col("level")), ignorenulls=True).over(everything))
    share_of = F.col("level") * F.col("weight")
    target = F.when(F.col("level").isNull() | (share_of >= full), full.cast("double")).otherwise(share_of)
    return steps.select("source", "source_size", "weight", target.alias("target"))


def cuts(rows: DataFrame) -> DataFrame:
    """One row per source from rows of doc_id, source, size, key: source_size, target, epochs, and the cut of the epoch after those."""
    total = rows.count()
    bits = max(1, min(36, (total // BIN_ROWS).bit_length()))
    rows = rows.withColumn("bin", key_bin(F.col("key"), bits))
    bins = stored(rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    goal = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")))
    budget = F.round("target").cast("long")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    goal = stored(goal.withColumn("rest", budget - F.col("source_size") * F.col("epochs")), "targets")

    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    up_to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("start", F.sum("bin_size").over(up_to) - F.col("bin_size"))
    split = bins.alias("b").join(goal.alias("g"), same("b", "g") & (F.col("start") < F.col("rest")) & (F.col("start") + F.col("bin_size") > F.col("rest")))
    split = split.select("b.source", "b.bin", "start", "rest")
    near = rows.alias("r").join(split.alias("s"), same("r", "s") & (F.col("r.bin") == F.col("s.bin")))
    near = near.groupBy("r.source", "start", "rest", "r.key", "r.doc_id", "r.size").agg(F.count("*").alias("times"))
    ahead = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("begin", F.col("start") + F.coalesce(F.sum(F.col("size") * F.col("times")).over(ahead), F.lit(0)))
    near = near.filter((F.col("begin") < F.col("rest")) & (F.col("begin") + F.col("size") * F.col("times") >= F.col("rest")))
    near = near.select("source", F.struct("key", F.col("doc_id").isNull().alias("no_id"), "doc_id", "size").alias("cut"), F.floor((F.col("rest") - F.col("begin")) / F.col("times")).cast("long").alias("part"))

    # A cut on the border of two bins is in neither: the first bin that starts at it gives the key.
    border = bins.alias("b").join(goal.alias("g"), same("b", "g") & (F.col("start") >= F.col("rest"))).groupBy("b.source").agg(F.min("b.bin").alias("bin_from"))
    goal = goal.alias("g").join(near.alias("n"), same("g", "n"), "left").select("g.*", "n.cut", "n.part")
    goal = goal.alias("g").join(border.alias("b"), same("g", "b"), "left").select("g.*", "b.bin_from")
    return stored(goal.withColumn("bits", F.lit(bits)), "cuts")


def taken(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """rows with source_size, target and taken; rows has doc_id, source, size, key and any other columns."""
    bits = goal.agg(F.max("bits")).first()[0] or 1
    both = rows.alias("r").join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
    own = F.struct("r.key", F.col("r.doc_id").isNull().alias("no_id"), "r.doc_id", "r.size")
    ahead = F.when(F.col("g.cut").isNotNull(), own < F.col("g.cut")).when(F.col("g.rest") == 0, F.lit(False))
    ahead = ahead.otherwise(F.col("g.bin_from").isNull() | (key_bin(F.col("r.key"), bits) < F.col("g.bin_from")))
    extra = F.when(F.col("g.cut").isNotNull() & own.eqNullSafe(F.col("g.cut")), F.col("g.part")).when(ahead, F.col("r.size")).otherwise(0)
    return both.select("r.*", "g.source_size", "g.target", (F.col("r.size") * F.col("g.epochs") + extra).cast("long").alias("taken"))


def plan(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, source, size, key, source_size, target, taken."""
    rows = docs.select(F.col(id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    rows = stored(rows.withColumn("key", random_key(F.col("doc_id"), F.col("size"), seed)), "sizes")
    return taken(rows, cuts(rows))


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """The mix's rows with the columns of docs: a document once for each epoch that takes it whole, and the one at a cut with its first words."""
    names = docs.columns
    of = {c: f"c{i}" for i, c in enumerate(names)}
    rows = docs.toDF(*of.values()).withColumns({"doc_id": F.col(of[id]), "source": F.col(of[source]), "size": n_words(F.col(of[text]))})
    rows = rows.withColumn("key", random_key(F.col("doc_id"), F.col("size"), seed))
    goal = cuts(stored(rows.select("doc_id", "source", "size", "key"), "sizes"))
    rows = taken(rows, goal).filter("taken > 0")
    copies = rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    keep = F.least(F.col("size"), F.col("taken") - F.col("size") * (F.col("nth") - 1)).cast("int")
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(of[text]), F.lit(WORD), F.lit(0)), 1, keep), " ")
    copies = copies.withColumn(of[text], F.when(keep == F.col("size"), F.col(of[text])).otherwise(first))
    return copies.select(*[F.col(of[c]).alias(c) for c in names])
