"""Whitening of embeddings from an exact integer scatter matrix.

Entries are put on an integer grid, x = floor(64 c) + 1,000,000.  Each task subtracts the shift and sums vectors and cross
products without rounding: blocks go through floating-point products whose sums stay below 2^53, wide values cut into
limbs of 20 bits first, and add up in Python's arbitrary-precision integers.  Tasks emit these sums as signed 32-bit limbs,
which Spark adds up as longs; what reaches the driver depends on the dimensions alone.  There n X'X - S S' is formed in
whole numbers, which a shift doesn't change, and only then converted to floating point and decomposed by ``eigh``.  Rows
are centred as n x - S in whole numbers too, so nothing cancels.

Vectors are read four times (lengths, scatter, covariance of the result, result) and never shuffled.

Defined cases: vectors that are null or hold null, NaN or infinite entries are left out, as are empty ones and those of
another length than most have (of equally frequent lengths the greater counts); repeated rows and null ids are rows like
others; entries beyond +-2^62 on the grid are held there; ``deviation`` is null where it is beyond a long.  Components whose
variance can't be told from rounding (below dims * 2^-52 of the largest) can't be scaled to one and are left out, so equal
vectors or none give no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm.shared import col, freed

#: Grid cells to a unit, what is added to them, and components returned.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Vectors in a block, bits of a limb for products and of one that is emitted.
BLOCK, LIMB, PART = 4096, 20, 32
_HELD = 1 << 62


@dataclass(frozen=True)
class Scatter:
    """n vectors, their sums and cross products after the shift, exact."""

    n: int
    sums: list[int]
    products: list[list[int]]

    def covariance(self) -> np.ndarray:
        """V, each entry the floating-point number next to the exact one."""
        d, nn = len(self.sums), self.n * self.n
        return np.array([[(self.n * self.products[i][j] - self.sums[i] * self.sums[j]) / nn for j in range(d)] for i in range(d)]).reshape(d, d)


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def fit_list(df: DataFrame, vector_col: str = "embedding", id_col: str | None = None) -> tuple[DataFrame, int, int]:
    """The vectors that take part (v, and id), how many there are, and their length."""
    v = col(vector_col).cast("array<double>").alias("v")
    own = df.where(usable(col(vector_col)) & (F.size(col(vector_col)) > 0)).select(*([col(id_col).alias("id")] if id_col else []), v)
    most = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d, n = (most["d"], most["n"]) if most else (0, 0)
    return own.where(F.size("v") == d), n, d


def grid(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """x minus the shift, as 64-bit integers, a row for each vector."""
    values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.clip(np.floor(SCALE * values), -float(_HELD), float(_HELD)).astype(np.int64)


def exact_products(y: np.ndarray) -> np.ndarray:
    """y'y for one block of integers as an array of Python's integers; products of limbs stay below 2^53 in sum."""
    top = int(np.abs(y).max(initial=0))
    if top * top * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    limbs, rest = [], y
    while rest.any() and not (limbs and (rest == -1).all()):
        limbs.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = rest >> LIMB
        if len(limbs) * LIMB >= 64:
            break
    limbs.append(rest.astype(np.float64))  # the sign: -1 or 0, or what is left
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for a, p in enumerate(limbs):
        for b, q in enumerate(limbs):
            total = total + (p.T @ q).astype(np.int64).astype(object) * (1 << LIMB * (a + b))
    return total


def parts(value: int) -> list[int]:
    """Signed limbs of 32 bits: value = sum of part * 2^(32 k)."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << PART) - 1)))
        value >>= PART
    return out


def scatter(vectors: DataFrame, n: int, d: int) -> Scatter:
    """Sums and cross products of ``vectors`` (v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for batch in batches:
            y = grid(batch, d)
            for k in range(0, len(y), BLOCK):
                block = y[k : k + BLOCK]
                # halves, as a sum of whole values could leave 64 bits
                high, low = block >> PART, block & ((1 << PART) - 1)
                sums = sums + high.sum(axis=0).astype(object) * (1 << PART) + low.sum(axis=0).astype(object)
                products = products + exact_products(block)
        told = [(i, -1, int(sums[i])) for i in range(d)] + [(i, j, int(products[i, j])) for i in range(d) for j in range(i, d)]
        rows = [(i, j, k, part) for i, j, value in told for k, part in enumerate(parts(value))]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(list(zip(*rows, strict=True)) or [[]] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["i", "j", "k", "part"])

    found = vectors.select("v").mapInArrow(freed(run), "i int, j int, k int, part long").groupBy("i", "j", "k").agg(F.sum("part").alias("part"))
    sums, products = [0] * d, [[0] * d for _ in range(d)]
    for r in found.collect():  # some limbs for each pair of dimensions
        value = r["part"] << PART * r["k"]
        if r["j"] < 0:
            sums[r["i"]] += value
        else:
            products[r["i"]][r["j"]] += value
    return Scatter(n, sums, [[products[min(i, j)][max(i, j)] for j in range(d)] for i in range(d)])


@dataclass(frozen=True)
class Whitener:
    """Components by falling variance: unit vectors (columns), variances and their shares of the trace."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n y - S in whole numbers: 64-bit ones where they fit."""
        if len(y) and self.n * int(np.abs(y).max()) + max(map(abs, self.sums)) < _HELD:
            return y * self.n - np.array(self.sums, dtype=np.int64)
        return y.astype(object) * self.n - np.array(self.sums, dtype=object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        rows = centred / self.n if centred.dtype == object else centred.astype(np.float64) / self.n
        return (rows.astype(np.float64) @ self.components) / np.sqrt(self.variances)


def deviations(centred: np.ndarray) -> list[int | None]:
    """Sums of squares, exact; None beyond a long."""
    top = max((abs(int(x)) for x in (centred.min(initial=0), centred.max(initial=0))), default=0)
    if centred.dtype != object and top * top * centred.shape[1] < 1 << 63:
        return (centred * centred).sum(axis=1).tolist()
    exact = (centred.astype(object) ** 2).sum(axis=1)
    return [int(x) if x < 1 << 63 else None for x in exact]


def fit(found: Scatter, components: int = COMPONENTS) -> Whitener:
    v = found.covariance()
    if not len(v):
        return Whitener(found.n, (), v, np.zeros(0), np.zeros(0))
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = (values > max(values[0], 0) * len(values) * 2.0**-52)[:components].nonzero()[0]
    return Whitener(found.n, tuple(found.sums), vectors[:, keep], values[keep], values[keep] / np.trace(v) if len(keep) else values[keep])


def identity_error(vectors: DataFrame, w: Whitener, d: int) -> float:
    """Largest absolute entry of the covariance of all whitened vectors minus the identity."""
    c = len(w.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, about = 0, np.zeros(c), np.zeros((c, c))
        for batch in batches:
            rows = w.whitened(w.centred(grid(batch, d)))
            if not len(rows):
                continue
            own = rows.mean(axis=0)
            gap, rows = own - mean, rows - own
            about += rows.T @ rows + np.outer(gap, gap) * (n * len(rows) / (n + len(rows)))
            n, mean = n + len(rows), mean + gap * (len(rows) / (n + len(rows)))
        told = about + n * np.outer(mean, mean)
        i, j = np.triu_indices(c)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[i, np.arange(c)], pa.int32()), pa.array(np.r_[j, np.full(c, -1)], pa.int32()), pa.array(np.r_[told[i, j], n * mean], pa.float64())], names=["i", "j", "x"])

    cov, mean = np.zeros((c, c)), np.zeros(c)
    for r in vectors.select("v").mapInArrow(freed(run), "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():  # a row for each pair of components
        if r["j"] < 0:
            mean[r["i"]] = r["x"] / w.n
        else:
            cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["x"] / w.n
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(c)).max(initial=0))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error for each vector and component."""
    vectors, n, d = fit_list(df, vector_col, id_col)
    w = fit(scatter(vectors, n, d), components)
    error, c = identity_error(vectors, w, d), len(w.variances)
    schema = f"id {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(k, BLOCK)
                centred, rows = w.centred(grid(batch, d)), batch.num_rows
                of = np.repeat(np.arange(rows), c)
                columns = [
                    batch.column("id").take(pa.array(of)),
                    pa.array(np.tile(np.arange(1, c + 1), rows), pa.int32()),
                    pa.array(np.full(rows * c, n), pa.int64()),
                    pa.array(deviations(centred), pa.int64()).take(pa.array(of)),
                    pa.array(w.whitened(centred).ravel(), pa.float64()),
                    pa.array(np.tile(w.explained, rows), pa.float64()),
                    pa.array(np.full(rows * c, error), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(freed(run), schema)


def op13_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
