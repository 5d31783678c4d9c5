from __future__ import annotations

import datetime as dt
import json
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from studyloom.operators import analytics, cards, crud, qa, srs, vectors
from studyloom.operators.chunking import chunk
from studyloom.plans import flows, queries
from studyloom.sources import storage

T0 = dt.datetime(2024, 1, 1)


def reviews(spark, rows):
    return spark.createDataFrame([(c, T0 + dt.timedelta(hours=h), e, ok) for c, h, e, ok in rows], "card_id long, ts timestamp_ntz, event_id long, correct boolean")


def test_review_literals(spark):
    rows = [(1, k, k, True) for k in range(3)] + [(2, k, k, True) for k in range(3)] + [(2, 9, 9, False)] + [(3, k, k, True) for k in range(14)] + [(4, 0, 2, False), (4, 0, 1, True), (5, 0, 0, None)]
    got = {r["card_id"]: r for r in srs.review_state(reviews(spark, rows)).collect()}
    assert (got[1]["repetitions"], got[1]["interval"], got[1]["ease_factor"]) == (3, 13, 2.5 + 0.1 + 0.1 + 0.1)
    assert got[1]["next_review"] == T0 + dt.timedelta(hours=2, days=13)
    assert (got[2]["repetitions"], got[2]["interval"], got[2]["ease_factor"]) == (0, 1, 2.5)
    assert (got[3]["repetitions"], got[3]["interval"], got[3]["last_reviewed"]) == (13, 1618365, T0 + dt.timedelta(hours=12))  # the 14th would leave the calendar
    assert got[4]["repetitions"] == 0 and got[5]["repetitions"] == 0
    assert srs.review_state(reviews(spark, [])).count() == 0


def test_review_fold_against_steps(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(20), rng.randrange(50), e, rng.random() < 0.8) for e in range(600)]
    want = {}
    for c, h, _, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        r, i, e, at, due = want.get(c, (0, 1, 2.5, None, None))
        moment = T0 + dt.timedelta(hours=h)
        r, i, e, then, applied = srs.step(r, i, e, ok, moment)
        want[c] = (r, i, e, *((moment, then) if applied else (at, due)))
    got = {r["card_id"]: tuple(r)[1:] for r in srs.review_state(reviews(spark, rows)).collect()}
    assert got == want


def test_reviews_that_come_again(spark):
    """Events that come many times with the same id: every answer counts, as in the SQL, whatever the number of wrong ones before."""
    rows = [(1, 0, 0, False)] * 60 + [(1, 1, 1, True)] * 3 + [(2, 0, 2, False)] * 3 + [(2, k, 2 + k, True) for k in range(1, 5) for _ in range(3)]
    rows += [(3, 0, 9, True), (3, 0, 9, False), (3, 0, 9, True)]
    got = {r["card_id"]: (r["repetitions"], r["interval"]) for r in srs.review_state(reviews(spark, rows)).collect()}
    assert got == {1: (3, 13), 2: (12, 437396), 3: (2, 5)}


def test_due(spark):
    df = spark.createDataFrame([(1, 1, T0), (2, 1, T0 + dt.timedelta(microseconds=1)), (3, 1, None), (4, 2, T0)], "id long, instance_id long, next_review timestamp_ntz")
    assert [r["id"] for r in cards.due(df, T0, 1).collect()] == [1]
    assert sorted(r["id"] for r in cards.due(df, T0).collect()) == [1, 4]


def test_new_cards(spark):
    pairs = spark.createDataFrame([(2, 1, "q", "late"), (1, 1, "q", "first"), (3, 1, "Q", "case"), (4, 1, "old", "x"), (5, 2, "old", "y")], "id long, instance_id long, question string, answer string")
    have = spark.createDataFrame([(1, "old")], "instance_id long, question string")
    got = {(r["instance_id"], r["question"]): r["answer"] for r in cards.new_cards(pairs, have).collect()}
    assert got == {(1, "q"): "first", (1, "Q"): "case", (2, "old"): "y"}
    dated = cards.new_cards(pairs, have, F.lit(T0).cast("timestamp_ntz")).first()
    assert (dated["ease_factor"], dated["interval"], dated["repetitions"], dated["next_review"], dated["last_reviewed"]) == (2.5, 1, 0, T0, None)


def test_paths_and_bootstrap(spark):
    docs = spark.createDataFrame([(3, 1, "a"), (1, 1, "a"), (2, 1, "b"), (4, 2, "a")], "id long, instance_id long, file_path string")
    assert sorted(tuple(r) for r in cards.distinct_paths(docs).collect()) == [(1, "a", 1), (1, "b", 2), (2, "a", 4)]
    pairs = spark.createDataFrame([(1,)], "instance_id long")
    assert [tuple(r) for r in cards.without_pairs(docs, pairs).collect()] == [(2, "a", 4)]
    assert [tuple(r) for r in cards.first_rows(docs, ["instance_id", "file_path"], ["id"]).orderBy("id").collect()] == [(1, 1, "a"), (2, 1, "b"), (4, 2, "a")]


def test_top_k(spark):
    v = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(3)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [0.4, 0.0])], "query_id long, query array<float>")
    assert [r["vec_id"] for r in vectors.top_k(v, q).orderBy("rank").collect()] == [0, 1, 2]
    many = spark.createDataFrame([(k, [float(k % 7), 1.0]) for k in range(50)], "vec_id long, embedding array<float>")
    asked = many.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    whole = sorted(map(tuple, vectors.top_k(many, asked, k=3).collect()))
    assert whole == sorted(map(tuple, vectors.top_k(many.repartition(3), asked.repartition(2), k=3).collect())) and len(whole) == 150


def test_scores(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, None, 2)], "t long, chosen int, right int")
    assert tuple(analytics.test_score(df, ["t"]).first()) == (1, 2, 3, 1, 67)
    none = spark.createDataFrame([(1, None, None)], "t long, chosen int, right int")
    assert analytics.test_score(none, ["t"]).first()["percent"] == 0
    topics = analytics.topic_accuracy(spark.createDataFrame([("b", True), ("a", True), ("c", False)], "topic string, correct boolean"))
    assert analytics.best_topic(topics).first()["best_topic"] == "a"
    assert tuple(analytics.mean_accuracy(topics, topics.limit(1)).first()) == (67, 3, 3, 1)
    empty = topics.limit(0)
    assert analytics.best_topic(empty).first()["best_topic"] == "—" and tuple(analytics.mean_accuracy(empty, empty).first()) == (None, 0, 0, 0)
    files = spark.createDataFrame([(None, 2, 6), ("bad", None, None)], "error string, chunk_count long, qa_count long")
    assert tuple(analytics.batch_summary(files).first()) == (2, 1, 1, 6, 2)


def test_counts_default_to_zero(spark):
    own = spark.createDataFrame([(1,), (2,)], "id long")
    docs = spark.createDataFrame([(1,), (1,)], "instance_id long")
    due = spark.createDataFrame([(1, T0), (1, None)], "instance_id long, next_review timestamp_ntz")
    got = {r["id"]: (r["document_count"], r["flashcards_due"]) for r in analytics.instance_counts(own, docs, due, F.lit(T0).cast("timestamp_ntz")).collect()}
    assert got == {1: (2, 1), 2: (0, 0)}


def test_tables(spark):
    df = spark.createDataFrame([(k, f"n{k}") for k in range(150)], "id long, name string")
    assert [r["id"] for r in crud.page(df).collect()] == list(range(100)) and crud.page(df, 100, 100).count() == 50
    assert crud.by_id(df, 7).first()["name"] == "n7" and crud.by_id(df, 999).count() == 0
    patch = spark.createDataFrame([(1, None, True), (2, "x", False), (3, "y", True)], "id long, name string, has_name boolean")
    got = {r["id"]: r["name"] for r in crud.patched(df.limit(5), patch, {"name": "has_name"}).collect()}
    assert (got[1], got[2], got[3], got[4]) == (None, "n2", "y", "n4")
    gone = spark.createDataFrame([(1,)], "id long")
    child = spark.createDataFrame([(5, 1), (6, 2)], "id long, instance_id long")
    left = crud.cascade_delete(gone, df, child, child, child)
    assert left[0].count() == 149 and [r["id"] for r in left[3].collect()] == [6]
    ids = crud.with_new_ids(df.select("name"), ["name"], start=10)
    assert [r["id"] for r in ids.orderBy("name").collect()] == list(range(10, 160))
    good, bad = crud.validated(spark.createDataFrame([(" a ", None), (" ", None), ("b", "#GGGGGG")], "name string, color string"))
    assert [r["name"] for r in good.collect()] == ["a"] and bad.count() == 2


def test_clients(spark):
    chunks = spark.createDataFrame([(1, "first text"), (2, "second text"), (3, None)], "doc_id long, text string")

    def client(text):
        if text.startswith("second"):
            raise OSError("down")
        return '[{"question":"Q?","answer":"A","difficulty":"easy","topic":"t"}]'

    rows = qa.generate(chunks, client).collect()
    assert sorted((r["doc_id"], r["question"][:2]) for r in rows) == [(1, "Q?"), (2, "Wh"), (2, "Wh"), (2, "Ho")] or len(rows) == 4
    compared = {r["model"]: r["n_questions"] for r in qa.compare_models(chunks, [("a", client), ("b", lambda t: None)], ["doc_id"]).collect()}
    assert compared == {"a": 1, "b": 0}
    vectors_ = qa.embed(chunks.where("text is not null"), lambda texts: [[float(len(t))] for t in texts]).orderBy("doc_id").collect()
    assert [r["embedding"] for r in vectors_] == [[10.0], [11.0]]


SHAPES = [
    ('Here: [{"question": "a", "answer": "b", "difficulty": "easy"}] done', "items", 1),
    ('[{"question": "a [x]", "answer": "b", "difficulty": "easy", "more": [1]}, {"question": "a", "answer": "b", "difficulty": "hard", "topic": null}]', "items", 2),
    ('[{"question": "a", "answer": "b"}]', "wrong shape", 0),
    ('[{"question": 1, "answer": "b", "difficulty": "easy"}]', "wrong shape", 0),
    ('[{"question": "a", "answer": "b", "difficulty": "easy"}, 3]', "wrong shape", 0),
    ("[]", "wrong shape", 0),
    ("[1, 2]", "wrong shape", 0),
    ("[null]", "wrong shape", 0),
    ('[{"question": "a",}]', "malformed", 0),
    ("text [not json] text", "malformed", 0),
    ("] nothing [", "absent", 0),
    ("", "absent", 0),
    (None, "absent", 0),
]


def test_shapes_of_outputs(spark):
    df = spark.createDataFrame([(k, x, 1) for k, (x, *_) in enumerate(SHAPES)], "id int, output string, shapes int")
    got = {r["id"]: (r["shape"], r["n_items"]) for r in qa.with_shape(df).collect()}
    assert got == {k: tuple(want) for k, (_, *want) in enumerate(SHAPES)}


def test_items_keep_the_order_given(spark):
    """Of equal questions the first in the list makes the card, whatever its difficulty."""
    items = [("q0", "medium"), ("q1", "easy"), ("q2", "hard"), ("q3", "easy"), ("q1", "hard")]
    client = lambda text: json.dumps([{"question": q, "answer": f"{q} {k}", "difficulty": level, "topic": "t"} for k, (q, level) in enumerate(items)])
    uploads = spark.createDataFrame([(1, 5, "some text"), (2, 5, "other text")], "id long, instance_id long, text string")
    pairs, fresh, _ = flows.upload(uploads, spark.createDataFrame([], "instance_id long, question string"), client=client)
    assert [(r["document_id"], r["question"]) for r in pairs.orderBy("id").collect()] == [(d, q) for d in (1, 2) for q, _ in items]
    assert sorted((r["question"], r["answer"], r["id"]) for r in fresh.collect()) == [("q0", "q0 0", 1), ("q1", "q1 1", 2), ("q2", "q2 2", 3), ("q3", "q3 3", 4)]


def test_a_batch_reads_texts_once(spark, tmp_path):
    """Metadata, chunks and pairs come from what was written: no plan of theirs goes back to the texts."""
    long = " ".join(f"word{k}" for k in range(950)) + "."
    rows = [("a", long, None), ("b", " \n ", None), ("c", None, None), ("d", "x", "OSError"), ("e", "é", None)]
    spark.createDataFrame(rows, "path string, text string, error string").write.parquet(str(tmp_path / "texts"))
    found = spark.read.parquet(str(tmp_path / "texts"))
    for df in flows.batch(found, "now"):
        assert "texts" not in df._jdf.queryExecution().executedPlan().toString()
    meta = {r["path"]: (r["error"], r["file_size_chars"], r["cleaned_size_chars"], r["chunk_count"], r["qa_count"]) for r in flows.batch(found, "now")[0].collect()}
    none = "Failed to extract text"
    assert meta == {"a": (None, len(long), len(long), 3, 9), "b": (none, None, None, 0, 0), "c": (none, None, None, 0, 0), "d": ("OSError", None, None, 0, 0), "e": (None, 1, 0, 0, 0)}
    assert flows.batch_totals(found) == {"total_files": 5, "successful": 2, "failed": 3, "total_chunks": 3, "total_qa": 9}


def test_totals_tell_null_keys_apart(spark):
    df = spark.createDataFrame([(1, "t", "easy"), (1, None, "easy"), (None, "t", "hard"), (None, None, None)], "instance_id long, topic string, difficulty string")
    got = Counter((r["instance_id"], r["topic"], r["difficulty"], r["level"], r["n"]) for r in analytics.question_totals(df).collect())
    want = Counter()
    rows = [tuple(r) for r in df.collect()]
    for keep in (0b111, 0b101, 0b100, 0b001, 0):
        for key, n in Counter(tuple(v if keep >> (2 - k) & 1 else None for k, v in enumerate(r)) for r in rows).items():
            want[(*key, 7 - keep, n)] += 1
    assert got == want


def test_chunks_of_nothing_with_outer(spark):
    df = spark.createDataFrame([(1, "a b"), (2, " "), (3, None)], "id int, text string")
    assert sorted((r["id"], r["chunk_id"], r["text"]) for r in chunk(df, outer=True).collect()) == [(1, 1, "a b"), (2, None, None), (3, None, None)]


def test_upload_report_holds_what_it_counts(spark, sf):
    """One narrow table of questions is written for the report, not all of the pairs twice."""
    with storage.made_tables() as paths:
        queries.upload_flow(spark, sf)
    assert [spark.read.parquet(p).columns for p in paths] == [["instance_id", "document_id", "chunk_id", "question"]]


def test_batch_cuts_cleaned_texts_at_blanks(spark):
    """A cleaned text has no white space but blanks, so it isn't searched for all kinds of it once more."""
    own = spark.createDataFrame([(1, "a\u3000b  c", None), (2, "\u3000 ", None), (3, None, None), (4, "x", "bad")], "path long, text string, error string")
    made = flows.batch_chunks(own)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and not re.search(r"split\([^,]*, \[", plan)
    assert {(r["path"], r["text"], r["error"]) for r in made.collect()} == {(1, "a b c", None), (2, None, "Failed to extract text"), (3, None, "Failed to extract text"), (4, None, "bad")}
