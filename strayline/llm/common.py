"""What the text operators share: storage, batches and word tables.

Words are maximal runs of characters outside ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

import ctypes
import sys
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir

SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch: what a Python worker holds at once.
BATCH_ROWS = 1000
BATCH_BYTES = "8m"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut, a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strayline-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """As stored, and rows with the same key lie in the same of n buckets: grouped or joined by the key, the table isn't shuffled.

    The catalog has the table just until its files and buckets are known.
    """
    spark, unique = df.sparkSession, uuid.uuid4().hex
    table, n = f"spark_catalog.default.strayline_{unique}", min(n, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    df.write.format("parquet").bucketBy(n, key).option("path", f"{shared_dir(spark)}/strayline-{unique}/{name}").saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return found


def give_back() -> None:
    """Hand the memory that a worker no longer uses back to the system: workers live on between tasks, beside others."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers, so that long texts don't pile up in one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves the remainder: the held-out rows."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def early(id: str, most: int, total: Column | int) -> Column:
    """True for few more than the rows with the smallest hashes of their id, most of total: what is ranked then doesn't grow with the table."""
    return F.xxhash64(id).cast("double") / 2.0**64 + 0.5 < F.lit(4.0 * most) / total


def sampled(df: DataFrame, id: str, most: int) -> DataFrame:
    """At most so many rows, those with the smallest hash of their id; distinct ids."""
    return df.filter(early(id, most, max(1, df.count()))).orderBy(F.xxhash64(id), id).limit(most)


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[str] | pa.Array]:
    """(codes, offsets, dictionary): the words of text i are dictionary[codes[offsets[i]:offsets[i+1]]]. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.string()), "")
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts) if lower else texts)
    lists = pc.ascii_split_whitespace(texts)
    empty = np.asarray(pc.equal(texts, ""))
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    if empty.any():
        flat = flat.filter(pa.array(np.repeat(~empty, sizes)))
        sizes = np.where(empty, 0, sizes)
    coded = flat.dictionary_encode()
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets, coded.dictionary


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each word the position of its text."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a value per word, by text."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
