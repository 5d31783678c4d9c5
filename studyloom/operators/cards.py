"""Flashcards: sources, deduplication and what is due."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of a new card.
EASE, INTERVAL, REPETITIONS = 2.5, 1, 0


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each group of keys by ``order``; found on the map side before rows are exchanged."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") == 1).drop("_n")


def first_by(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """As :func:`first_rows` by one id, as an aggregate with partial results, so no group is gathered."""
    others = [c for c in df.columns if c not in (*keys, id_col)]
    best = df.groupBy(*keys).agg(F.min(F.struct(id_col, *others)).alias("_b"))
    return best.select(*keys, F.col(f"_b.{id_col}"), *[F.col("_b")[c].alias(c) for c in others]).select(*df.columns)


def distinct_paths(documents: DataFrame) -> DataFrame:
    """instance_id, file_path and the id of its first document, by id."""
    return documents.groupBy("instance_id", "file_path").agg(F.min("id").alias("id"))


def new_cards(qa_pairs: DataFrame, cards: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Cards for questions that the instance has no card for; of equal questions the one with the lowest id.

    Questions are compared exactly.  ``now`` sets the schedule columns; without it they are left out.
    """
    first = first_by(qa_pairs.select("instance_id", "question", "id", "answer"), ["instance_id", "question"], "id")
    if cards is not None:
        first = first.join(cards.select("instance_id", "question"), ["instance_id", "question"], "left_anti")
    out = first.select("instance_id", "id", "question", "answer", F.lit(EASE).alias("ease_factor"), F.lit(INTERVAL).cast("long").alias("interval"), F.lit(REPETITIONS).alias("repetitions"))
    if now is None:
        return out
    return out.withColumns({"next_review": now, "last_reviewed": F.lit(None).cast("timestamp_ntz"), "created_at": now})


def without_pairs(documents: DataFrame, qa_pairs: DataFrame) -> DataFrame:
    """First documents by path of instances that have no pair yet, the input of a bootstrap."""
    return distinct_paths(documents.join(qa_pairs.select("instance_id").distinct(), "instance_id", "left_anti"))


def unique_questions(qa_pairs: DataFrame, by: list[str]) -> DataFrame:
    """For each group, its questions and its different ones by MD5."""
    own = qa_pairs.groupBy(*by, F.md5("question").alias("h")).agg(F.count("*").alias("n"))
    return own.groupBy(*by).agg(F.sum("n").alias("questions"), F.count("*").alias("unique_questions"))


def due(cards: DataFrame, as_of: datetime | Column, instance_id: int | str | None = None) -> DataFrame:
    """Cards whose review date has come, the moment itself included; cards without a date are not due."""
    found = cards if instance_id is None else cards.where(F.col("instance_id") == F.lit(instance_id))
    return found.where(F.col("next_review") <= (as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")))
