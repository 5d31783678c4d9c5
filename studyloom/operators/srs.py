"""Spaced repetition: card state as a fold over review events.

A wrong answer sets the state of a new card, so the state depends only on the answers since the last wrong one, and a
correct one takes ``interval * ease`` with the ease before it.  A correct answer whose date would leave the calendar
changes nothing.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: State of a new card, gain of ease, and the last day of the calendar.
EASE, INTERVAL, REPETITIONS, GAIN, LAST = 2.5, 1, 0, 0.1, datetime(9999, 12, 31)
#: Correct answers in a row after which the next date would always leave the calendar.
STREAK = 13
#: Days from which no date of our era can be reached.
TOO_FAR = 3_000_000


def step(repetitions: int, interval: int, ease: float, correct: bool, at: datetime) -> tuple[int, int, float, datetime, bool]:
    """The state after one review, its next date, and whether it was applied."""
    if not correct:
        return REPETITIONS, INTERVAL, EASE, at + timedelta(days=INTERVAL), True
    days = int(interval * ease)
    try:
        return repetitions + 1, days, ease + GAIN, at + timedelta(days=days), True
    except OverflowError:
        return repetitions, interval, ease, at, False


def _state(r: Column, i: Column, e: Column, at: Column) -> Column:
    return F.struct(r.alias("r"), i.alias("i"), e.alias("e"), at.alias("at"))


def review_state(events: DataFrame, card: str = "card_id", ts: str = "ts", event: str = "event_id", correct: str = "correct") -> DataFrame:
    """card_id, repetitions, interval, ease_factor, last_reviewed and next_review after all events in order of time, then id; of equal ones wrong answers come first.

    Events before a card's last wrong answer can't matter, so they are dropped before a card's events are gathered:
    the last wrong answer is an aggregate with partial results, and what is gathered is the start of one streak, as no
    streak changes a card beyond ``STREAK`` answers.
    """
    own = events.select(F.col(card).alias("card_id"), F.struct(F.col(ts).cast("timestamp_ntz").alias("ts"), F.col(event).alias("id")).alias("o"), F.coalesce(F.col(correct), F.lit(False)).alias("ok"))
    wrong = own.where(~F.col("ok")).groupBy("card_id").agg(F.max("o").alias("reset"))
    since = own.join(wrong, "card_id", "left").where(F.col("reset").isNull() | (F.col("o") >= F.col("reset")))
    # right answers are counted apart: a wrong one that comes many times, all at one time and id, takes no place of theirs
    since = since.withColumn("_n", F.row_number().over(Window.partitionBy("card_id", "ok").orderBy("o"))).where(F.col("_n") <= STREAK + 1)
    runs = since.groupBy("card_id").agg(F.sort_array(F.collect_list(F.struct("o.ts", "o.id", "ok"))).alias("run"))
    new = _state(F.lit(REPETITIONS), F.lit(INTERVAL).cast("long"), F.lit(EASE), F.lit(None).cast("timestamp_ntz"))

    def fold(a: Column, x: Column) -> Column:
        days = (a["i"] * a["e"]).cast("long")
        fits = (days < TOO_FAR) & (F.datediff(F.lit(LAST.date()), x["ts"].cast("date")) >= days)
        right = F.when(fits, _state(a["r"] + 1, days, a["e"] + GAIN, x["ts"])).otherwise(a)
        return F.when(x["ok"], right).otherwise(_state(F.lit(REPETITIONS), F.lit(INTERVAL).cast("long"), F.lit(EASE), x["ts"]))

    folded = runs.select("card_id", F.aggregate("run", new, fold).alias("s"))
    due = F.col("s.at") + F.make_dt_interval(F.col("s.i").cast("int"))
    return folded.select("card_id", F.col("s.r").alias("repetitions"), F.col("s.i").alias("interval"), F.col("s.e").alias("ease_factor"), F.col("s.at").alias("last_reviewed"), due.alias("next_review"))
