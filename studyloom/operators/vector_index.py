"""Exact nearest vectors without meeting every block: pivots, distance intervals and the triangle inequality.

An index holds the vectors in blocks, sorted by nearest pivot and distance from it, so that a block lies close together; a
block's summary states the least and largest distance of its members from each pivot.  For a query q and a pivot p,
no member is nearer than d(q, p) minus the largest or the least minus d(q, p).  A search first meets, for each query, the
block with the least bound, which gives a k-th distance that the answer can't exceed; then only blocks whose bound is
within it.  Vectors far apart in all directions gain nothing and meet all blocks; results are the same in any case.

Pivots are a bounded sample: ``PIVOTS`` vectors, those of least hash.  Summaries are compared in packs, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studyloom.operators.vectors import K, nearest
from studyloom.sources.storage import dropped, written

#: Pivots, stored vectors and queries of a block, and summaries of a pack.
PIVOTS, ROWS, QUERIES, PACK = 64, 1024, 256, 4096
#: Bounds and distances are rounded; what is that near to a bound is met.
SLACK = 1e-9
_BLOCK = "block long, ids array<bigint>, vectors binary, least binary, most binary"


@dataclass(frozen=True)
class VectorIndex:
    """A written table of blocks, and the pivots (a row each)."""

    blocks: DataFrame
    pivots: np.ndarray


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, pivots), each difference squared and summed, so that equal vectors are at 0."""
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((x - p) ** 2).sum(axis=1))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _sorted(df: DataFrame, id_col: str, vector_col: str, pivots: np.ndarray) -> DataFrame:
    """id and v by nearest pivot, then distance, in ranges: equal vectors spread over several by their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(_matrix(batch.column(1)), pivots) if len(pivots) else np.zeros((batch.num_rows, 1))
            near = d.argmin(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32()), pa.array(d[np.arange(len(near)), near], pa.float64())], names=["id", "v", "near", "far"])

    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    placed = own.mapInArrow(run, "id long, v array<float>, near int, far double")
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["near", "far", "id"]
    return placed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "v")


def _blocks(rows: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    """A row for each ``size`` neighbours, or fewer, with the intervals of their distances from the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []

        def block(rows: pa.Table) -> pa.RecordBatch:
            x = _matrix(rows.column("v").combine_chunks())
            d = distances(x, pivots)
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), pa.array([rows.column("id").to_pylist()], pa.list_(pa.int64())), *[pa.array([a.tobytes()], pa.binary()) for a in (x, d.min(axis=0), d.max(axis=0))]], names=["block", "ids", "vectors", "least", "most"])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                rows = pa.Table.from_batches(held)
                yield block(rows.slice(0, size))
                made, held = made + 1, rows.slice(size).to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    return rows.mapInArrow(run, _BLOCK)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, rows: int = ROWS) -> VectorIndex:
    """An index of all vectors, which have one length."""
    own = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    chosen = own.orderBy(F.xxhash64(F.col(id_col)), id_col).limit(pivots).select(vector_col).collect()  # the bounded sample
    at = np.array([r[0] for r in chosen], np.float32).astype(np.float64)
    return VectorIndex(written(_blocks(_sorted(vectors, id_col, vector_col, at), at, rows), "vector-blocks"), at)


def bounds(asked: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """(queries, blocks): no member of a block is nearer to a query; from distances to pivots and intervals."""
    out = np.zeros((len(asked), len(least)))
    for j in range(asked.shape[1]):
        q = asked[:, j : j + 1]
        np.maximum(out, np.maximum(q - most[:, j], least[:, j] - q), out=out)
    return out


def _packs(blocks: DataFrame, pack: int) -> DataFrame:
    """Summaries of up to ``pack`` blocks of a partition in a row: their numbers and intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, pack):
                own = batch.slice(k, pack)
                yield pa.RecordBatch.from_arrays([pa.array([own.column(0).to_pylist()], pa.list_(pa.int64())), *[pa.array([b"".join(own.column(c).to_pylist())], pa.binary()) for c in (1, 2)]], names=["blocks", "leasts", "mosts"])

    return blocks.select("block", "least", "most").coalesce(max(1, blocks.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, "blocks array<bigint>, leasts binary, mosts binary")


def _compared(questions: DataFrame, packs: DataFrame, pivots: np.ndarray, best: bool) -> DataFrame:
    """asked and block, and with ``best`` each query's least bound; else pairs whose bound is within a query's limit."""
    p = len(pivots)
    schema = "asked long, query long, bound double, block long" if best else "asked long, block long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r].as_py() for name in batch.schema.names}
                x = np.frombuffer(row["vectors"]).reshape(len(row["ids"]), -1)
                found = bounds(distances(x, pivots), np.frombuffer(row["leasts"]).reshape(-1, p), np.frombuffer(row["mosts"]).reshape(-1, p))
                numbers = np.array(row["blocks"], np.int64)
                if best:
                    at = found.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["asked"])), pa.array(row["ids"], pa.int64()), pa.array(found[np.arange(len(at)), at]), pa.array(numbers[at])], names=["asked", "query", "bound", "block"])
                else:
                    limit = np.array(row["limits"])[:, None]
                    some = numbers[(found <= limit * (1 + SLACK) + SLACK).any(axis=0)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row["asked"])), pa.array(some)], names=["asked", "block"])

    return questions.crossJoin(packs).mapInArrow(run, schema)


def _met(pairs: DataFrame, questions: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id and distance: what each pair of a block of queries and a block of vectors gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r].as_py() for name in batch.schema.names}
                ids, asked = np.array(row["vec_ids"], np.int64), np.array(row["ids"], np.int64)
                stored, wanted = (np.frombuffer(row[c]).reshape(len(own), -1) for c, own in (("stored", ids), ("vectors", asked)))
                found = list(nearest(ids, stored, wanted, k))
                of = np.repeat(asked, [len(x) for x, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([d for _, d in found]))], names=["query_id", "vec_id", "distance"])

    stored = blocks.select("block", F.col("ids").alias("vec_ids"), F.col("vectors").alias("stored"))
    return pairs.join(stored, "block").join(questions.select("asked", "ids", "vectors"), "asked").select("vec_ids", "stored", "ids", "vectors").mapInArrow(run, "query_id long, vec_id long, distance double")


def _ranked(near: DataFrame, k: int) -> DataFrame:
    own = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id")))
    return own.where(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int = K, query_rows: int = QUERIES, pack: int = PACK) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, distance and rank, ties by id; a written table of the pairs asked and block that met).

    ``queries``: query_id and query, a stated set.
    """
    spark = queries.sparkSession
    questions = written(_blocks(_sorted(queries, "query_id", "query", index.pivots), index.pivots, query_rows).select(F.col("block").alias("asked"), "ids", "vectors"), "query-blocks")
    packs = written(_packs(index.blocks, pack), "block-packs")
    if not len(index.pivots):
        empty = "query_id long, vec_id long, distance double"
        return _ranked(spark.createDataFrame([], empty), k), written(spark.createDataFrame([], "asked long, block long"), "blocks-met")
    best = _compared(questions, packs, index.pivots, True).groupBy("asked", "query").agg(F.min(F.struct("bound", "block"))["block"].alias("block"))
    first = written(best.select("asked", "block").distinct(), "first-blocks")
    near = written(_met(first, questions, index.blocks, k), "first-neighbours")
    # the k-th distance so far; none yet where the first blocks held fewer
    kth = _ranked(near, k).groupBy(F.col("query_id").alias("_q")).agg(F.max("rank").alias("n"), F.max("distance").alias("far")).select("_q", F.when(F.col("n") == k, F.sqrt("far")).alias("limit"))
    each = questions.select("asked", F.posexplode("ids").alias("at", "query")).join(kth, F.col("query") == F.col("_q"), "left")
    limits = each.groupBy("asked").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("limit", F.lit(float("inf"))).alias("limit")))), lambda x: x["limit"]).alias("limits"))  # the queries of a block
    rest = _compared(questions.join(limits, "asked"), packs, index.pivots, False).join(first, ["asked", "block"], "left_anti")
    rest = written(rest, "further-blocks")
    met = written(first.unionByName(rest), "blocks-met")
    found = written(_ranked(near.unionByName(_met(rest, questions, index.blocks, k)), k), "neighbours")
    dropped(questions, packs, first, near, rest)
    return found, met


def pivot_top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """As ``vectors.top_k``, by an index that is built for this search."""
    index = build_index(vectors, id_col, vector_col)
    found, met = search(index, queries, k)
    dropped(index.blocks, met)
    return found
