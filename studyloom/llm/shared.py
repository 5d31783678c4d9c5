"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.sources.storage import dropped, new_folder, written

__all__ = ["BROADCAST_ROWS", "ascii_lower", "barrier", "bounded", "col", "dropped", "freed", "new_folder", "row_key", "without", "written"]

#: Characters that end a word in the contracts that split on ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Rows of fixed size, hashes and numbers, up to which a table is broadcast: some tens of megabytes.
BROADCAST_ROWS = 1_000_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; whole-ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def barrier(df: DataFrame, **exprs: Column) -> DataFrame:
    """Adds columns whose values are computed once per row.

    A plain projection may be inlined into every later use, also inside lambdas, where it would be evaluated for each
    element.  A generator's output is an attribute and stays one.
    """
    made = F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))
    return df.select("*", F.inline(made))


def bounded(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, a written table with rows of fixed size, with a broadcast hint if they are within the bound."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if rows is None else rows) else df


def row_key(*columns: Column) -> list[Column]:
    """_k1 and _k2: 128 bits that tell rows apart by these columns."""
    return [F.xxhash64(F.lit(k), *columns).alias(f"_k{k}") for k in (1, 2)]


def without(docs: DataFrame, rejected: DataFrame, *columns: Column) -> DataFrame:
    """The rows of ``docs``, whole, whose key over ``columns`` is not in a written table of _k1 and _k2; its size decides how it is joined."""
    gone, (k1, k2) = bounded(rejected), row_key(*columns)
    return docs.join(gone, (k1 == gone["_k1"]) & (k2 == gone["_k2"]), "left_anti")


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; when it ends, the worker, which stays for other tasks, gives unused memory back."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return held
