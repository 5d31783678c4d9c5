"""New flashcards as a stream of question-and-answer pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.operators.cards import EASE, INTERVAL, REPETITIONS


def card_stream(pairs: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """Cards for a streaming DataFrame of instance_id, id, question and answer, in update mode.

    The state is one row for each instance and question (by MD5): the pair with the lowest id so far.  Pairs whose ids grow
    from batch to batch make a card once, and the first wins; a lower id that comes late takes its place, so the newest
    row of a question is the same for any cut into batches.  ``cards`` (static): questions that have a card already.
    """
    own = pairs.select("instance_id", F.md5("question").alias("question_md5"), "id", "question", "answer")
    if cards is not None:
        have = cards.select(F.col("instance_id").alias("_i"), F.md5("question").alias("_q")).distinct()
        own = own.join(have, F.col("instance_id").eqNullSafe(F.col("_i")) & (F.col("question_md5") == F.col("_q")), "left_anti")
    first = own.groupBy("instance_id", "question_md5").agg(F.min(F.struct("id", "question", "answer")).alias("p"))
    return first.select("instance_id", "question_md5", "p.*", F.lit(EASE).alias("ease_factor"), F.lit(INTERVAL).cast("long").alias("interval"), F.lit(REPETITIONS).alias("repetitions"))
