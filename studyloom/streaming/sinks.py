"""Running a stream over what is there, and the table that its batches leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "update") -> None:
    """Reads what has come since the last run on this checkpoint and ends.

    Each batch is a partition of its own, written over if the batch comes again after a failure.
    """

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last row of each key that the batches left."""
    rows = spark.read.parquet(out)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_s")).select(*keys, *[F.col("_s")[c].alias(c) for c in others])
