"""Look-ups, pages and changes of tables, each as a new DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.functions.formats import trimmed, valid_color, valid_name
from studyloom.sources.storage import dropped, written


def by_id(df: DataFrame, value, id_col: str = "id") -> DataFrame:
    return df.where(F.col(id_col) == F.lit(value)).limit(1)


def of_instance(df: DataFrame, instance_id, col: str = "instance_id") -> DataFrame:
    return df.where(F.col(col) == F.lit(instance_id))


def page(df: DataFrame, skip: int = 0, limit: int = 100, id_col: str = "id") -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` by id, an order that does not depend on storage."""
    return df.orderBy(id_col).offset(skip).limit(limit)


def validated(inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) instance inputs: names trimmed, of 1 to 255 characters; colours hex or HSL."""
    own = inputs.withColumn("name", trimmed(F.col("name")))
    ok = valid_name(F.col("name")) & valid_color(F.col("color"))
    return own.where(ok), own.where(~ok)


def with_new_ids(df: DataFrame, order: Sequence[str | Column], start: int = 1, id_col: str = "id") -> DataFrame:
    """Consecutive ids in a given order, the same for any layout: sorted ranges are numbered apart and shifted by what lies before.

    The numbered ranges are written, as a second evaluation could cut them elsewhere.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = written(df, "rows-to-number")  # finding the ranges takes a pass of its own
    held = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "new-ids")
    dropped(rows)
    own = held.withColumns({"_p": F.shiftright("_m", 33), "_own": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = own.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"))  # one row a range
    return own.join(F.broadcast(before), "_p").withColumn(id_col, F.col("_own") + F.col("_before") + start).drop("_p", "_m", "_own", "_before")


def patched(df: DataFrame, patches: DataFrame, fields: Mapping[str, str], id_col: str = "id") -> DataFrame:
    """Rows with a patch applied.  ``fields`` maps a column to the patch's flag column that says whether it is set; a set null is applied."""
    own = patches.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_new_{c}") for c in fields], *[F.col(f).alias(f"_set_{c}") for c, f in fields.items()])
    joined = df.join(own, F.col(id_col) == F.col("_id"), "left")
    return joined.select(*[F.when(F.coalesce(F.col(f"_set_{c}"), F.lit(False)), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns])


def without(df: DataFrame, deleted: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not among the deleted ids (column id)."""
    return df.join(deleted.select(F.col("id").alias("_gone")), F.col(key) == F.col("_gone"), "left_anti")


def cascade_delete(deleted: DataFrame, instances: DataFrame, documents: DataFrame, qa_pairs: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables without the deleted instances and all that belongs to them."""
    return without(instances, deleted), *(without(t, deleted, "instance_id") for t in (documents, qa_pairs, cards))
