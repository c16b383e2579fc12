"""Exact duplicates by an extendible-hash index, in DataFrame operations only.

A text's key is the 64-bit XXH64 of its normalised bytes. The directory has one
slot for each value of the key's first ``depth`` bits; the depth doubles the
directory until every bucket holds at most ``capacity`` distinct keys, and a
bucket that fits sooner keeps a smaller local depth and several slots. Each
owner task gets a contiguous range of slots, sorts it by key and then by the
bytes of the text: equal keys with different bytes become a chain, equal bytes
become one entry.

A key that many rows share is summed before the shuffle instead. Such keys are
those with at least ``max(HOT_ROWS, rows / HOT_KEYS)`` rows, so there are at most
``HOT_KEYS`` of them, and that proves the bound of the broadcast.

Null texts count as empty. An empty table gives an empty result. Of rows that
repeat the same id and text, one is kept. A null id sorts after all others.
Columns the operator adds carry names in ``ADDED``; the caller's columns of the
same name must be renamed by the caller, and ``deduplicate`` does so itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_RUN, parts, stored

CAPACITY = 2048
HOT_ROWS = 64
HOT_KEYS = 65536
MAX_DEPTH = 40
ADDED = ("keep_id", "group_size", "kept", "text_sha256", "slot", "chain")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def slot_of(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth)


def key_counts(docs: DataFrame, text: str = "text", form=normalised) -> DataFrame:
    """Distinct keys with their rows."""
    return docs.groupBy(F.xxhash64(form(F.col(text))).alias("key")).agg(F.count("*").alias("rows"))


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slots, depth). slots, one row each: slot, bucket (the bucket's first slot), local_depth.

    The directory doubles until no bucket is overfull. A bucket is the shortest
    prefix that fits: one with room whose parent is overfull, or the whole range.
    """
    depth = max(1, (keys.count() // capacity).bit_length())
    while True:
        level = keys.groupBy(slot_of(F.col("key"), depth).alias("slot")).agg(F.count("*").alias("n"))
        level = stored(level, "slots")
        if (level.agg(F.max("n")).first()[0] or 0) <= capacity or depth >= MAX_DEPTH:
            break
        depth += 1
    up = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    counts = level.select("n", "slot", up.alias("d")).groupBy("d", F.expr(f"shiftright(slot, {depth} - d)").alias("prefix")).agg(F.sum("n").alias("n"))
    counts = stored(counts, "prefixes")
    overfull = counts.filter((F.col("n") > capacity) & (F.col("d") < depth))
    # Both children of an overfull prefix exist, if only as an empty bucket.
    children = overfull.select((F.col("d") + 1).alias("d"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    root = keys.sparkSession.range(1).select(F.lit(0).alias("d"), F.col("id").alias("prefix"))
    leaves = root.unionByName(children).join(overfull.select("d", "prefix"), ["d", "prefix"], "left_anti")
    width = F.expr(f"shiftleft(1L, {depth} - d)")
    leaves = leaves.select((F.col("prefix") * width).alias("bucket"), F.col("d").alias("local_depth"), width.alias("width"))
    slots = leaves.withColumn("slot", F.explode(F.sequence(F.col("bucket"), F.col("bucket") + F.col("width") - 1)))
    return stored(slots.select("slot", "bucket", "local_depth"), "directory"), depth


def annotate(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, form=normalised) -> tuple[DataFrame, DataFrame]:
    """Every row of docs with the columns in ADDED, and the directory. form: makes equal texts the same string."""
    spark = docs.sparkSession
    if set(ADDED) & set(docs.columns):
        raise ValueError(f"docs has columns named as those added: {sorted(set(ADDED) & set(docs.columns))}")
    keys = stored(key_counts(docs, text, form), "keys")
    total = keys.agg(F.sum("rows")).first()[0] or 0
    slots, depth = directory(keys, capacity)
    n = max(1, min(parts(spark), 1 << depth))
    hot = keys.filter(F.col("rows") >= max(HOT_ROWS, -(-total // HOT_KEYS))).select("key", F.lit(True).alias("__hot"))
    owner = F.shiftright(slot_of(F.col("key"), depth) * n, depth).cast("int")
    marked = docs.withColumn("key", F.xxhash64(form(F.col(text)))).join(F.broadcast(hot), "key", "left")

    cold = marked.filter(F.col("__hot").isNull()).withColumn("__owner", owner).repartitionById(n, F.col("__owner"))
    cold = cold.withColumn("__bytes", form(F.col(text)))
    chain = Window.partitionBy("__owner", "key")
    group = Window.partitionBy("__owner", "key", "__bytes")
    first = F.col(id).asc_nulls_last()
    cold = (
        cold.withColumn("chain", F.dense_rank().over(chain.orderBy("__bytes")))
        .withColumn("__nth", F.row_number().over(group.orderBy(first)))
        .withColumn("keep_id", F.min(id).over(group))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
        .withColumn("kept", F.col("__nth") == 1)
        .withColumn("text_sha256", F.sha2(F.col("__bytes").cast("binary"), 256))
    )

    some = marked.filter(F.col("__hot"))
    entries = some.groupBy("key", form(F.col(text)).alias("__bytes")).agg(F.min(id).alias("keep_id"), F.count("*").alias("group_size"))
    entries = entries.select("key", F.sha2(F.col("__bytes").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    entries = entries.withColumn("chain", F.row_number().over(Window.partitionBy("key").orderBy("text_sha256")))
    warm = some.withColumn("text_sha256", F.sha2(form(F.col(text)).cast("binary"), 256)).join(F.broadcast(entries), ["key", "text_sha256"])
    heads = warm.filter(F.col(id).eqNullSafe(F.col("keep_id")))
    heads = heads.withColumn("kept", F.row_number().over(Window.partitionBy("key", "text_sha256").orderBy(F.lit(1))) == 1)
    rest = warm.filter(~F.col(id).eqNullSafe(F.col("keep_id"))).withColumn("kept", F.lit(False))

    out = [F.col(c) for c in docs.columns]
    added = [F.col("keep_id"), F.col("group_size").cast("long"), F.col("kept"), F.col("text_sha256"), slot_of(F.col("key"), depth).alias("slot"), F.col("chain").cast("int")]
    return cold.select(*out, *added).unionByName(heads.select(*out, *added)).unionByName(rest.select(*out, *added)), slots


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The index's entries, one per row, as files in the shared folder: id, ADDED, and the bucket with its local depth."""
    # Only the normal form goes on, so that it is made once for each row and not again behind the shuffle.
    plain = docs.select(id, normalised(F.col(text)).alias(text))
    entries, slots = annotate(plain, id, text, capacity, form=lambda c: c)
    return stored(entries.drop(text), "index").join(slots, "slot")


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    of = {c: f"c{i}" for i, c in enumerate(names)}
    return annotate(plain, of[id], of[text], capacity)[0].filter("kept").select(*[F.col(of[c]).alias(c) for c in names])
