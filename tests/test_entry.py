"""Every registered query against its SQL, and the stream against the batch."""

from __future__ import annotations

import datetime as dt
import random
import types
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from studyloom.operators import cards, srs
from studyloom.plans import oracles, queries
from studyloom.streaming import cards as card_streams
from studyloom.streaming import reviews
from studyloom.streaming.sinks import newest, run_available


def norm(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


def rows(columns, data, order):
    at = [columns.index(c) for c in order]
    return sorted(tuple(norm(r[k]) for k in at) for r in data)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_catalogue():
    assert set(queries.queries()) == set(oracles.SQL) and set(oracles.SQL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query(spark, sf, duck, name):
    df = queries.queries()[name](spark, sf)
    want = duck.sql(oracles.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    assert rows(df.columns, df.collect(), order) == rows(want.columns, want.fetchall(), order)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_stream_in_batches(spark, tmp_path):
    """Events in several ordered files, one micro-batch each; the last state of each card is the batch fold's."""
    t0 = dt.datetime(2024, 1, 1)
    events = [(k % 7, t0 + dt.timedelta(minutes=k), k, k % 5 != 0) for k in range(200)]
    schema = "card_id long, ts timestamp_ntz, event_id long, correct boolean"
    whole = spark.createDataFrame(events, schema)
    source, out = tmp_path / "in", str(tmp_path / "out")
    reviews.configure(spark)
    for k in range(4):
        part = whole.where(F.col("event_id").between(50 * k, 50 * k + 49)).coalesce(1)
        part.write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))

        def keep(df, batch, k=k):
            df.withColumn("at", F.lit(k)).write.mode("append").parquet(out)

        reviews.review_stream(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    names = ["repetitions", "interval", "ease_factor", "last_reviewed", "next_review"]
    last = spark.read.parquet(out).groupBy("card_id").agg(F.max_by(F.struct(*names), "at").alias("s")).select("card_id", "s.*")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, srs.review_state(whole).collect()))


def test_questions_of_all_chunks(spark, sf):
    """Every pair is counted, those of later chunks too."""
    rows = entry.queries()["unique_questions"](spark, sf).collect()
    pairs = entry.queries()["fallback_qa"](spark, sf)
    assert sum(r["questions"] for r in rows) == pairs.count() > pairs.where("chunk_id = 1").count()


def test_stream_holds_answers_since_the_last_wrong_one():
    rng = random.Random(4)
    for _ in range(300):
        frames = [pd.DataFrame({"ts": [rng.randrange(40) for _ in range(n)], "event_id": rng.sample(range(1000), n), "correct": [rng.random() < 0.9 for _ in range(n)]}) for n in (rng.randrange(1, 30) for _ in range(rng.randrange(1, 4)))]
        whole = pd.concat(frames).sort_values(["ts", "event_id"])
        at = (~whole["correct"]).to_numpy().nonzero()[0]
        want = whole.iloc[at[-1] if len(at) else 0 :].iloc[: srs.STREAK + 2]
        assert reviews.since_reset(iter(frames)).to_numpy().tolist() == want.to_numpy().tolist()


def test_equal_events_in_any_order():
    """Of events with one time and id the wrong answer comes first, in whatever order they arrive."""
    for ok in ([True, False, True], [False, True, True], [True, True, False]):
        frame = pd.DataFrame({"ts": [dt.datetime(2024, 1, 1)] * 3, "event_id": [7] * 3, "correct": ok})
        assert reviews.since_reset(iter([frame]))["correct"].tolist() == [False, True, True]
        assert reviews.in_order(iter([frame]))["correct"].tolist() == [False, True, True]


@pytest.mark.parametrize("name", ["review_stream", "late_review_stream", "due_stream"])
def test_streams_of_a_table_of_many_files(spark, sf, tmp_path, duck, name):
    """The events' table may be a folder, as Spark writes it."""
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    df, want = queries.queries()[name](spark, str(tmp_path)), duck.sql(oracles.SQL[name])
    order = sorted(want.columns)
    assert rows(df.columns, df.collect(), order) == rows(want.columns, want.fetchall(), order)


STATE = ["repetitions", "interval", "ease_factor", "last_reviewed", "next_review"]
REVIEWS = "card_id long, ts timestamp_ntz, event_id long, correct boolean"


def reviews_of(rng, n, days=60):
    t0 = dt.datetime(2024, 1, 1)
    return [(rng.randrange(6), t0 + dt.timedelta(minutes=rng.randrange(days * 1440), microseconds=rng.randrange(10) * 1000), k, rng.random() < 0.8) for k in range(n)]


def streamed(spark, tmp_path, batches, make, mode):
    """The rows of a stream whose batches come in separate runs on one checkpoint."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    with reviews.state_store(spark):
        for rows in batches:
            spark.createDataFrame(rows, REVIEWS).coalesce(1).write.mode("append").parquet(source)
            run_available(make(spark.readStream.schema(REVIEWS).parquet(source)), out, str(tmp_path / "mark"), mode)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_late_reviews_in_any_order(spark, tmp_path, seed):
    """Batches shuffled over time end in the batch fold's rows, as do those that come within the lateness while the watermark moves."""
    rng = random.Random(seed)
    events = reviews_of(rng, 150)
    want = sorted(map(tuple, srs.review_state(spark.createDataFrame(events, REVIEWS)).collect()))
    shuffled = rng.sample(events, len(events))
    out = streamed(spark, tmp_path / "a", [shuffled[k::4] for k in range(4)], lambda s: reviews.ordered_review_stream(s, "100 days"), "update")
    assert sorted(map(tuple, newest(spark, out, ["card_id"]).select("card_id", *STATE).collect())) == want
    nearly = sorted(events, key=lambda e: e[1] + dt.timedelta(days=rng.uniform(0, 3)))  # up to three days late
    out = streamed(spark, tmp_path / "b", [nearly[k : k + 40] for k in range(0, 150, 40)], lambda s: reviews.ordered_review_stream(s, "3 days"), "update")
    assert sorted(map(tuple, newest(spark, out, ["card_id"]).select("card_id", *STATE).collect())) == want


def test_due_cards_of_every_day_replayed(spark, tmp_path):
    """After any day, the cards told due and not reviewed since are those that are due by the batch query."""
    rng = random.Random(7)
    events = sorted(reviews_of(rng, 60, 20), key=lambda e: e[1])
    shuffled = [rng.sample(events[k : k + 20], 20) for k in range(0, 60, 20)]
    out = streamed(spark, tmp_path, shuffled, lambda s: reviews.due_stream(s, "0 seconds"), "append")
    told = [tuple(r) for r in spark.read.schema(reviews.DUE).parquet(out).drop("batch").collect()]
    assert len(told) == len(set(told))
    whole = spark.createDataFrame(events, REVIEWS)
    for day in (1, 3, 8, 13, 19):
        as_of = min(dt.datetime(2024, 1, 1) + dt.timedelta(days=day), events[-1][1])
        state = srs.review_state(whole.where(F.col("ts") <= F.lit(as_of)))
        want = {tuple(r) for r in cards.due(state, as_of).select("card_id", "next_review").collect()}
        assert {(c, due) for c, at, due in told if due <= as_of and not any(e[0] == c and at < e[1] <= as_of for e in events)} == want


def test_cards_in_any_cut(spark, tmp_path):
    """Pairs in one batch or many make the cards of the batch query; the first of equal questions wins."""
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), k, f"q{rng.randrange(30)}", f"a{k}") for k in range(200)]
    schema = "instance_id long, id long, question string, answer string"
    have = spark.createDataFrame([(1, "q3"), (2, "q4"), (None, "q5")], "instance_id long, question string")
    want = sorted(map(str, cards.new_cards(spark.createDataFrame([r for r in rows if r[0] is not None], schema), have).collect()))
    for n in (1, 5):
        source, out = str(tmp_path / f"in{n}"), str(tmp_path / f"out{n}")
        for k in range(n):
            spark.createDataFrame(rows[k * 200 // n : (k + 1) * 200 // n], schema).write.mode("append").parquet(source)
            run_available(card_streams.card_stream(spark.readStream.schema(schema).parquet(source), have), out, str(tmp_path / f"mark{n}"))
        got = newest(spark, out, ["instance_id", "question_md5"]).where("instance_id is not null").drop("question_md5")
        assert sorted(map(str, got.select("instance_id", "id", "question", "answer", "ease_factor", "interval", "repetitions").collect())) == want


def test_due_cards_make_no_frame_for_each_event(monkeypatch):
    """A card's waiting events are applied as plain values: frames don't grow with them."""

    class Kept:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = put = lambda self, value: setattr(self, "value", value)
        clear = lambda self: setattr(self, "value", None)

    class Now:
        getCurrentWatermarkInMs = lambda self: 1_704_067_200_000 + 86_400_000 * 50  # noqa: E731, N815

    card, t0, made, frame = reviews.DueProcessor(), dt.datetime(2024, 1, 1), [], pd.DataFrame
    card.card, card.later, card._wake = Kept(), Kept(), lambda at: None
    card.later.value = [(t0 + dt.timedelta(days=k % 90), k, k % 9 != 0) for k in range(89, -1, -1)]
    names = {n: getattr(pd, n) for n in ("Timestamp", "to_datetime", "concat")} | {"DataFrame": lambda *a, **k: made.append(1) or frame(*a, **k)}
    monkeypatch.setattr(reviews, "pd", types.SimpleNamespace(**names))
    told = list(card.handleExpiredTimer((7,), Now(), None))
    monkeypatch.undo()
    assert len(made) <= 3 and [r for r in card.later.value if r[0] <= t0 + dt.timedelta(days=50)] == [] and len(card.later.value) == 39
    want = [(7, t0 + dt.timedelta(days=k), t0 + dt.timedelta(days=k + 1)) for k in range(0, 50, 9)]
    assert [tuple(r) for r in told[0].itertuples(index=False) if (r.next_review - r.last_reviewed).days == 1] == want
