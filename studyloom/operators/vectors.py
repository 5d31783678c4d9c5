"""Exact nearest vectors by squared Euclidean distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Neighbours, and the vectors of a block: of stored ones and of queries.
K, ROWS, QUERIES = 5, 4096, 1024


def blocks(df: DataFrame, id_col: str, vector_col: str, size: int, name: str) -> DataFrame:
    """A row for each ``size`` vectors of a partition, or fewer: their ids and their values in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(ids: list, values: list) -> pa.RecordBatch:
            flat = np.concatenate([np.asarray(v, np.float64) for v in values]).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([flat], pa.binary())], names=[f"{name}_ids", f"{name}_values"])

        ids, values = [], []
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(key)
                values.append(value.values.to_numpy(zero_copy_only=False))
                if len(ids) == size:
                    yield made(ids, values)
                    ids, values = [], []
        if ids:
            yield made(ids, values)

    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return own.mapInArrow(run, f"{name}_ids array<bigint>, {name}_values binary")


def nearest(ids: np.ndarray, stored: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and distances of its k nearest, ties by id; the matrix product only chooses whom to measure."""
    rough = (stored * stored).sum(axis=1)[:, None] - 2.0 * (stored @ queries.T)
    spread = 1e-9 * (np.abs(rough).max(axis=0, initial=0.0) + 1.0)
    for j, query in enumerate(queries):
        if len(ids) > k:
            near = np.flatnonzero(rough[:, j] <= np.partition(rough[:, j], k - 1)[k - 1] + spread[j])
        else:
            near = np.arange(len(ids))
        exact = ((stored[near] - query) ** 2).sum(axis=1)
        best = np.lexsort((ids[near], exact))[:k]
        yield ids[near][best], exact[best]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, vec_id, distance and rank, ties by id; fewer than ``k`` rows where there are fewer vectors.

    ``queries`` (query_id, query) is a stated set.  Both sides are put into blocks, and every block of vectors meets every
    block of queries once, in a plan of the same size for any number of them; what a meeting gives is ``k`` rows for a query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, asked = (np.array(batch.column(c)[row].as_py(), np.int64) for c in (0, 2))
                stored, wanted = (np.frombuffer(batch.column(c)[row].as_py()).reshape(len(own), -1) for c, own in ((1, ids), (3, asked)))
                found = list(nearest(ids, stored, wanted, k))
                of = np.repeat(asked, [len(x) for x, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([d for _, d in found]))], names=["query_id", "vec_id", "distance"])

    met = blocks(vectors, id_col, vector_col, ROWS, "v").crossJoin(blocks(queries, "query_id", "query", QUERIES, "q"))
    near = met.mapInArrow(run, "query_id long, vec_id long, distance double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id")))
    return ranked.where(F.col("rank") <= k)
