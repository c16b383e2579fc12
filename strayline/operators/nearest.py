"""Exact nearest neighbours of a stated query set among all rows.

Queries go out in blocks of at most about ``BLOCK`` vectors, so that what is broadcast
has a bound however many there are. Each batch of rows keeps its own k best for every
query of a block; only those are shuffled and ranked again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048


def l1_nearest(queries: DataFrame, rows: DataFrame, k: int, id: str = "id", vector: str = "vec") -> DataFrame:
    """query_id, id, distance and rank of the k nearest rows with another id; ties go to the smaller id. Null vectors are left out."""
    queries, rows = (d.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vec")).filter("id is not null and vec is not null") for d in (queries, rows))
    n = queries.count() // BLOCK + 1
    kind = rows.schema["id"].dataType.simpleString()
    out = None
    for block in range(n):
        asked = queries.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == block).toPandas()
        if not len(asked):
            continue
        spec = queries.sparkSession.sparkContext.broadcast((asked["id"].to_numpy(), np.array(asked["vec"].tolist(), np.float64)))

        def run(batches: Iterator[pd.DataFrame], spec=spec) -> Iterator[pd.DataFrame]:
            ids, q = spec.value
            for pdf in batches:
                x, own = np.array(pdf["vec"].tolist(), np.float64), pdf["id"].to_numpy()
                if not len(own):
                    continue
                for i, v in zip(ids, q):
                    d = np.abs(x - v).sum(axis=1)
                    d[own == i] = np.inf
                    best = np.lexsort((own, d))[:k]
                    best = best[np.isfinite(d[best])]
                    yield pd.DataFrame({"query_id": i, "id": own[best], "distance": d[best]})

        found = rows.mapInPandas(run, f"query_id {kind}, id {kind}, distance double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("distance")).limit(0)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)
