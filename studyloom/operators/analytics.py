"""Counts, scores and chart series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studyloom.functions.formats import round_half_up


def instance_counts(instances: DataFrame, documents: DataFrame, cards: DataFrame, as_of) -> DataFrame:
    """Instances with document_count and flashcards_due, 0 where there are none, in one plan."""
    docs = documents.groupBy("instance_id").agg(F.count("*").alias("document_count"))
    due = cards.groupBy("instance_id").agg(F.count_if(F.col("next_review") <= as_of).alias("flashcards_due"))
    own = instances.join(docs, instances["id"] == docs["instance_id"], "left").drop("instance_id").join(due, instances["id"] == due["instance_id"], "left").drop("instance_id")
    return own.withColumns({"document_count": F.coalesce("document_count", F.lit(0).cast("long")), "flashcards_due": F.coalesce("flashcards_due", F.lit(0).cast("long"))})


def chunk_stats(chunks: DataFrame, by: list[str]) -> DataFrame:
    """n_chunks and chunk_words for each text."""
    return chunks.groupBy(*by).agg(F.count("*").alias("n_chunks"), F.sum("word_count").alias("chunk_words"))


def upload_stats(qa_pairs: DataFrame, by: list[str]) -> DataFrame:
    """qa_pairs and chunks for each upload, from rows with chunk_id."""
    each = qa_pairs.groupBy(*by, "chunk_id").agg(F.count("*").alias("n"))
    return each.groupBy(*by).agg(F.sum("n").alias("qa_pairs"), F.count("*").alias("chunks"))


def batch_summary(files: DataFrame) -> DataFrame:
    """One row over per-file results with error, qa_count and chunk_count; counts of failed files are left out."""
    ok = F.col("error").isNull()
    return files.agg(F.count("*").alias("total_files"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("qa_count"))), F.lit(0)).cast("long").alias("total_qa"), F.coalesce(F.sum(F.when(ok, F.col("chunk_count"))), F.lit(0)).cast("long").alias("total_chunks"))


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def by_topic(qa_pairs: DataFrame) -> DataFrame:
    """Questions for each topic.  Rows of a table always carry the key, so a null topic stays null."""
    return count_by(qa_pairs, "topic")


def topic_questions(qa_pairs: DataFrame) -> DataFrame:
    """topic, question and n: the different questions of each topic, a row each, as a common topic has too many for one row."""
    return qa_pairs.groupBy("topic", "question").agg(F.count("*").alias("n"))


#: The totals that :func:`question_totals` gives, from the finest.
SETS = (("instance_id", "topic", "difficulty"), ("instance_id", "difficulty"), ("instance_id",), ("difficulty",), ())


def question_totals(qa_pairs: DataFrame, sets: Sequence[Sequence[str]] = SETS) -> DataFrame:
    """n for each group of each of ``sets`` in one pass; level is the grouping id, which tells a total from a null key."""
    keys = list(dict.fromkeys(c for own in sets for c in own))
    out = qa_pairs.groupingSets([[F.col(c) for c in own] for own in sets], *[F.col(c) for c in keys])
    return out.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))


def topic_accuracy(answers: DataFrame, topic: str = "topic", correct: str = "correct") -> DataFrame:
    """topic, total_questions and accuracy in percent."""
    return answers.groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("total_questions"), (100 * F.avg(F.col(correct).cast("double"))).alias("accuracy"))


def mean_accuracy(topics: DataFrame, weak: DataFrame) -> DataFrame:
    """One row: the rounded mean of the topics' accuracy (null if there is none), their questions and number, and how many areas are weak."""
    areas = weak.agg(F.count("*").alias("weak_areas"))
    return topics.agg(round_half_up(F.avg("accuracy")).alias("mean_accuracy"), F.coalesce(F.sum("total_questions"), F.lit(0)).cast("long").alias("total_questions"), F.count("*").alias("topics")).join(areas)  # a row each


def best_topic(topics: DataFrame) -> DataFrame:
    """One row: the topic with the highest accuracy, the first by name among equals, or a dash."""
    best = topics.agg(F.min(F.struct((-F.col("accuracy")).alias("a"), "topic")).alias("b"))
    return best.select(F.coalesce("b.topic", F.lit("—")).alias("best_topic"), (-F.col("b.a")).alias("accuracy"))


def weak_topics(topics: DataFrame, weak: DataFrame) -> DataFrame:
    """Topics that ``weak`` names."""
    return topics.join(weak.select("topic"), "topic", "left_semi")


def test_score(answers: DataFrame, by: list[str], chosen: str = "chosen", right: str = "right") -> DataFrame:
    """score, total, skipped and percent for each test; an unanswered question is wrong."""
    ok = F.coalesce(F.col(chosen) == F.col(right), F.lit(False))
    own = answers.groupBy(*by).agg(F.count_if(ok).alias("score"), F.count(right).alias("total"), F.count_if(F.col(chosen).isNull()).alias("skipped"))
    return own.withColumn("percent", F.when(F.col("total") > 0, round_half_up(100.0 * F.col("score") / F.col("total"))).otherwise(F.lit(0).cast("long")))


def progress(cards: DataFrame, by: list[str], order: str) -> DataFrame:
    """position, of and percent of each card in its deck."""
    w = Window.partitionBy(*by)
    own = cards.withColumns({"position": F.row_number().over(w.orderBy(order)), "of": F.count("*").over(w)})
    return own.withColumn("percent", round_half_up(100.0 * F.col("position") / F.col("of")))


def accuracy_series(answers: DataFrame, date: str = "date", correct: str = "correct") -> DataFrame:
    """date, accuracy: the line chart's points."""
    return answers.groupBy(F.col(date).alias("date")).agg((100 * F.avg(F.col(correct).cast("double"))).alias("accuracy"))
