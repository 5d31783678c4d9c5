"""Review events as a stream: each card's state is kept, and cards are told when they fall due.

:func:`review_stream` applies events as they arrive, within a batch by time, then id.  :func:`ordered_review_stream` and
:func:`due_stream` apply them in order of time: a watermark says how late an event may come, and what is not yet behind
it is held, so files in any order of batches end in the same rows.  Events that come later still are left out.
"""

from __future__ import annotations

import bisect
import contextlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from studyloom.functions.times import micros
from studyloom.operators.srs import EASE, INTERVAL, REPETITIONS, STREAK, step

OUTPUT = "card_id long, repetitions int, interval long, ease_factor double, last_reviewed timestamp_ntz, next_review timestamp_ntz"
_STATE = "repetitions int, interval long, ease double, at timestamp_ntz, due timestamp_ntz"


def since_reset(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The last wrong answer of all frames and what follows it, in order, as far as a streak can matter.

    Of what has been read only answers since the last wrong one so far are held.  Of equal events wrong answers come first.
    """
    held, order = None, ["ts", "event_id", "correct"]
    for frame in frames:
        held = (frame[order] if held is None else pd.concat([held, frame[order]])).sort_values(order)
        wrong = (~held["correct"].astype(bool)).to_numpy().nonzero()[0]
        held = held.iloc[wrong[-1] if len(wrong) else 0 :]
    return held.iloc[: STREAK + 2]


class ReviewProcessor(StatefulProcessor):
    """A card's repetitions, interval, ease and dates."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("card", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        events = since_reset(rows)
        now = self.state.get() if self.state.exists() else (REPETITIONS, INTERVAL, EASE, None, None)
        r, i, e, at, due = now
        for ts, ok in zip(events["ts"], events["correct"], strict=True):
            moment = pd.Timestamp(ts).to_pydatetime()
            r, i, e, then, applied = step(r, i, e, bool(ok), moment)
            if applied:
                at, due = moment, then
        self.state.update((r, i, e, at, due))
        yield pd.DataFrame({"card_id": [key[0]], "repetitions": [r], "interval": [i], "ease_factor": [e], "last_reviewed": [at], "next_review": [due]})

    def close(self) -> None:
        pass


_EVENT = "ts timestamp_ntz, event_id long, correct boolean"
_NEW = (REPETITIONS, INTERVAL, EASE, None, None)
_EPOCH = datetime(1970, 1, 1)


def applied(state: tuple, moment: datetime, ok: bool) -> tuple:
    """The state after one event."""
    r, i, e, then, fits = step(*state[:3], bool(ok), moment)
    return (r, i, e, moment, then) if fits else (r, i, e, *state[3:])


def folded(state: tuple, events: pd.DataFrame) -> tuple:
    """The state after events in order."""
    for moment, _, ok in _rows(events):
        state = applied(state, moment, ok)
    return state


def in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """Events of all frames by time, then id; of equal ones wrong answers come first."""
    columns = ["ts", "event_id", "correct"]
    some = [f[columns] for f in frames if len(f)]
    own = pd.concat(some, ignore_index=True) if some else pd.DataFrame(columns=columns)
    return own.sort_values(columns, ignore_index=True)


def _rows(events: pd.DataFrame) -> list[tuple]:
    moments = pd.to_datetime(events["ts"]).dt.to_pydatetime() if len(events) else []
    return [(at, int(k), bool(ok)) for at, k, ok in zip(moments, events["event_id"].tolist(), events["correct"].tolist(), strict=True)]


def _held(state: Any) -> pd.DataFrame:
    return pd.DataFrame([tuple(x) for x in state.get()] if state.exists() else [], columns=["ts", "event_id", "correct"])


def _put(state: Any, rows: list[tuple]) -> None:
    """A list state of these rows; it can't be empty."""
    if rows:
        state.put(rows)
    else:
        state.clear()


def _moment(ms: int) -> datetime:
    """A watermark as a time; before the first one it lies before all events."""
    return _EPOCH + timedelta(milliseconds=max(ms, 0))


class OrderedReviewProcessor(StatefulProcessor):
    """The state behind the watermark, and the events after it, of which an earlier one may still come.

    Of these only what follows the last wrong answer is held: no earlier event can matter any more.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.settled = handle.getValueState("settled", _STATE)
        self.later = handle.getListState("later", _EVENT)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        events = in_order(iter([_held(self.later), *rows]))
        state = tuple(self.settled.get()) if self.settled.exists() else _NEW
        wrong = (~events["correct"].astype(bool)).to_numpy().nonzero()[0]
        if len(wrong):
            events, state = events.iloc[wrong[-1] :], _NEW
        sure = (events["ts"] <= _moment(timer_values.getCurrentWatermarkInMs())).to_numpy(dtype=bool)
        state = folded(state, events[sure])
        self.settled.update(state)
        _put(self.later, _rows(events[~sure]))
        r, i, e, at, due = folded(state, events[~sure])
        yield pd.DataFrame({"card_id": [key[0]], "repetitions": [r], "interval": [i], "ease_factor": [e], "last_reviewed": [at], "next_review": [due]})

    def close(self) -> None:
        pass


DUE = "card_id long, last_reviewed timestamp_ntz, next_review timestamp_ntz"


def _due_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["card_id", "last_reviewed", "next_review"]).astype({"card_id": "int64", "last_reviewed": "datetime64[us]", "next_review": "datetime64[us]"})


class DueProcessor(StatefulProcessor):
    """Tells each moment at which a card falls due, once, by timers on event time.

    Events wait until the watermark has passed them and are then applied in order, so a card is told only if no review
    came before its date, in whatever order events arrive.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.card = handle.getValueState("card", f"{_STATE}, told boolean")
        self.later = handle.getListState("later", _EVENT)

    def _wake(self, at: datetime | None) -> None:
        if at is not None:
            self.handle.registerTimer(-(-((at - _EPOCH) // timedelta(microseconds=1)) // 1000))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        events = in_order(rows)
        self.later.appendList(_rows(events))
        self._wake(pd.Timestamp(events["ts"].iloc[0]).to_pydatetime())
        yield _due_rows([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = _moment(timerValues.getCurrentWatermarkInMs())
        *state, told = tuple(self.card.get()) if self.card.exists() else (*_NEW, True)
        state, said = tuple(state), []
        events = sorted(tuple(x) for x in self.later.get()) if self.later.exists() else []
        sure = bisect.bisect_right(events, now, key=lambda x: x[0])

        def tell(until: datetime) -> None:
            nonlocal told
            if not told and state[4] is not None and state[4] <= until:
                said.append((key[0], state[3], state[4]))
                told = True

        for ts, _, ok in events[:sure]:
            tell(ts)
            before = state[3:]
            state = applied(state, ts, ok)
            told = told and state[3:] == before  # a review that changes nothing makes nothing due again
        tell(now)
        self.card.update((*state, told))
        rest = events[sure:]
        _put(self.later, rest)
        for at in [rest[0][0] if rest else None, None if told else state[4]]:
            self._wake(at)
        yield _due_rows(said)

    def close(self) -> None:
        pass


def configure(spark: SparkSession) -> None:
    """The state store that keeps large state outside the heap."""
    spark.conf.set(_STORE, _ROCKS)


_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """As :func:`configure`, for queries started within; the session is left as it was."""
    before = spark.conf.get(_STORE, None)
    configure(spark)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def _events(events: DataFrame) -> DataFrame:
    return events.select(F.col("card_id").cast("long").alias("card_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").cast("long").alias("event_id"), F.coalesce("correct", F.lit(False)).alias("correct"))


def review_stream(events: DataFrame) -> DataFrame:
    """State updates for a streaming DataFrame of card_id, ts, event_id and correct."""
    return _events(events).groupBy("card_id").transformWithStateInPandas(statefulProcessor=ReviewProcessor(), outputStructType=OUTPUT, outputMode="Update", timeMode="None")


def _watched(events: DataFrame, lateness: str) -> DataFrame:
    own = _events(events)
    # a watermark needs an instant; the clock's reading stands for it in any zone
    return own.withColumn("_seen", F.timestamp_micros(micros(own, "ts"))).withWatermark("_seen", lateness)


def ordered_review_stream(events: DataFrame, lateness: str) -> DataFrame:
    """As :func:`review_stream`, with events applied in order of time if they come no later than ``lateness``; a card's newest row is its state."""
    return _watched(events, lateness).groupBy("card_id").transformWithStateInPandas(statefulProcessor=OrderedReviewProcessor(), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")


def due_stream(events: DataFrame, lateness: str) -> DataFrame:
    """card_id, last_reviewed and next_review at each moment at which a card falls due with no review before it."""
    return _watched(events, lateness).groupBy("card_id").transformWithStateInPandas(statefulProcessor=DueProcessor(), outputStructType=DUE, outputMode="Append", timeMode="EventTime")
