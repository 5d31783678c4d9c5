"""Pages of a table by id without sorting it for each of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studyloom.sources.storage import new_folder, written

#: Rows of a key range, about.
RANGE_ROWS = 100_000


@dataclass(frozen=True)
class PageIndex:
    """``path``: rows in files by key range, sorted by id; ``ranges``: _range, n and before, a row for each range."""

    path: str
    ranges: DataFrame
    rows: DataFrame
    id_col: str


def page_index(df: DataFrame, id_col: str = "id", range_rows: int = RANGE_ROWS) -> PageIndex:
    """Sorts once into ranges, counts them, and adds up what lies before each."""
    spark = df.sparkSession
    held = written(df, "rows-to-page")
    n = max(1, -(-held.count() // range_rows))
    path = new_folder(spark, "pages")
    ranged = held.repartitionByRange(n, id_col).withColumn("_range", F.spark_partition_id())
    ranged.sortWithinPartitions("_range", id_col).write.partitionBy("_range").parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path)
    counts = rows.groupBy("_range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("_range")) - F.col("n")  # one row a range
    return PageIndex(path, written(counts.withColumn("before", before), "page-ranges"), rows, id_col)


def page(index: PageIndex, skip: int = 0, limit: int = 100) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` by id, from the files of the ranges that hold them."""
    found = index.ranges.where((F.col("before") < skip + limit) & (F.col("before") + F.col("n") > skip)).agg(F.collect_set("_range").alias("r"), F.min("before").alias("before")).first()
    own = index.rows.where(F.col("_range").isin(found["r"]))
    return own.orderBy(index.id_col).offset(skip - (found["before"] or 0)).limit(limit).drop("_range")


def positions(index: PageIndex) -> DataFrame:
    """All rows with their position by id, from 0; each range is numbered apart."""
    own = F.row_number().over(Window.partitionBy("_range").orderBy(index.id_col)) - 1
    return index.rows.withColumn("position", own.cast("long")).join(index.ranges.drop("n"), "_range").withColumn("position", F.col("position") + F.col("before")).drop("_range", "before")
