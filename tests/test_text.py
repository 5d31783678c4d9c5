from __future__ import annotations

import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from studyloom.functions import formats, text
from studyloom.operators.chunking import chunk
from studyloom.operators.qa import fallback_qa, from_responses, parse_items


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "text string").select(f(F.col("text")).alias("x")).first()["x"]


def test_clean_literals(spark):
    assert one(spark, "  a\t\tb é c  ", text.light_clean) == "a b   c"
    assert one(spark, "See http://x.io now --- PAGE 3 --- mail a@b.c ok!", text.full_clean) == "See now mail ok!"
    assert one(spark, "éé ü", text.light_clean) == "" and one(spark, "  \n ", text.full_clean) == ""
    assert one(spark, None, text.light_clean) is None


def test_every_white_space(spark):
    every = "".join(chr(c) for a, b in text.WHITE_SPACE for c in range(a, b + 1))
    assert len(every) == 29 and not every.strip()
    assert one(spark, f"a{every}b", text.light_clean) == "a b"
    assert one(spark, f"a{every}b", text.words) == ["a", "b"]


def test_topic_and_sentences(spark):
    assert one(spark, "!!!", text.topic) == "this topic"
    assert one(spark, "a, b; c-d e f g", text.topic) == "a b c d e f"
    short, kept = "x" * 38 + ".", "y" * 39 + "."
    assert one(spark, f"{short} {kept}", text.sentences) == [kept]
    assert one(spark, f"{kept} {kept.upper()} {'z' * 45}!", text.sentences) == [kept, "z" * 45 + "!"]
    assert one(spark, "  short \n text ", text.answers) == ["short text"]
    assert one(spark, " ", text.answers) == []


@pytest.mark.parametrize(("n", "counts"), [(0, []), (1, [1]), (400, [400]), (401, [401, 1]), (500, [500, 100]), (501, [500, 101]), (900, [500, 500, 100])])
def test_chunk_counts(spark, n, counts):
    df = chunk(spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(n)))], "doc_id long, text string"))
    rows = df.orderBy("chunk_id").collect()
    assert [r["word_count"] for r in rows] == counts and [r["chunk_id"] for r in rows] == list(range(1, len(counts) + 1))
    if n > 401:
        assert rows[1]["text"].startswith("w400 ") and rows[0]["title"] == " ".join(f"w{k}" for k in range(8))


def test_chunk_edges(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "", "u"), (3, "a b", "v")], "doc_id long, text string, title string")
    assert [tuple(r) for r in chunk(df).collect()] == [(3, 1, "a b", "a b", 2)]
    assert chunk(df.limit(0)).count() == 0
    for size, overlap in ((5, 5), (5, 6), (0, 0), (5, -1)):
        with pytest.raises(ValueError):
            chunk(df, size=size, overlap=overlap)
    assert chunk(df, size=1, overlap=0).count() == 2


def test_fallback(spark):
    sentence = "This is one long sentence about rivers and lakes."
    rows = fallback_qa(spark.createDataFrame([(1, sentence), (2, " "), (3, None)], "doc_id long, text string")).orderBy("difficulty").collect()
    assert [r["difficulty"] for r in rows] == ["easy", "hard", "medium"] and {r["answer"] for r in rows} == {sentence}
    assert rows[0]["question"] == "What is one key idea from This is one long sentence about?"


def test_model_output(spark):
    good = '{"question":"a","answer":"b","difficulty":"easy","topic":"t"}'
    cases = {f"x [{good}] y": 1, "none": None, "[]": None, "[1,2]": None, f"[{good},]": None, "] [": None, None: None}
    for output, n in cases.items():
        got = spark.createDataFrame([(output,)], "o string").select(parse_items(F.col("o")).alias("x")).first()["x"]
        assert (got and len(got)) == n, output
    df = spark.createDataFrame([(1, "some text", f"[{good}]"), (2, "other text", "broken"), (3, "third", '[{"question":"q"}]')], "doc_id long, text string, output string")
    rows = from_responses(df).collect()
    assert sorted((r["doc_id"], r["rejected"]) for r in rows) == [(1, False), (2, False), (2, False), (2, False), (3, True)]
    assert from_responses(df, fallback=False).count() == 2


def test_formats(spark):
    df = spark.createDataFrame([(1536, 65, 2.5, -0.5)], "b long, s long, x double, y double")
    r = df.select(formats.size_kb(F.col("b")), formats.minutes_seconds(F.col("s")), formats.round_half_up(F.col("x")), formats.round_half_up(F.col("y"))).first()
    assert tuple(r) == ("1.5 KB", "1:05", 3, 0)
    assert one(spark, "../../etc/pass wd", formats.safe_file_name) == "pass_wd"
    assert one(spark, "hsl(10, 20%, 30%)", formats.valid_color) and not one(spark, "#12345", formats.valid_color) and one(spark, None, formats.valid_color)
    assert not one(spark, "", formats.valid_name) and not one(spark, "x" * 256, formats.valid_name) and one(spark, "x", formats.valid_name)


WORDS = st.text(st.sampled_from("ab.!?é \n\t A"), max_size=200)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(WORDS, min_size=20, max_size=40))
def test_against_plain_python(spark, texts):
    ws = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in text.WHITE_SPACE) + "]+"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in df.select("doc_id", text.light_clean(F.col("text")).alias("light"), text.sentences(F.col("text")).alias("s"), text.topic(F.col("text")).alias("topic")).collect()}
    for k, t in enumerate(texts):
        assert got[k]["light"] == re.sub(r"[^\x00-\x7f]+", " ", re.sub(ws, " ", t)).strip(" ")
        kept: list[str] = []
        for s in re.split(r"(?<=[.!?])" + ws, t):
            s = " ".join(s.split())
            if len(s) >= 40 and s.lower() not in [x.lower() for x in kept]:
                kept.append(s)
        assert got[k]["s"] == kept[:3]
        assert got[k]["topic"] == (" ".join(re.findall("[A-Za-z0-9]+", t)[:6]) or "this topic")


def test_long_texts_are_linear(spark):
    """A megabyte that invites backtracking: one word, an inner blank run, at-signs, brackets."""
    size = 1_000_000
    df = spark.createDataFrame([("x" * size,), ("a" + " " * size + "b",), ("a@" * (size // 2),), ("[" * size,)], "t string")
    text.full_clean(F.col("t"))
    began = time.perf_counter()
    for f in (text.full_clean, text.light_clean, text.normalized_ends, parse_items):
        df.select(f(F.col("t")).alias("o")).selectExpr("count(o)").collect()
    assert time.perf_counter() - began < 20
    assert [r[0] for r in df.select(F.length(text.full_clean(F.col("t")))).collect()] == [size, 3, 0, 0]


def test_mail_words(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab@ .") for _ in range(rng.randrange(14))) for _ in range(500)]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(text.full_clean(F.col("t"))).collect()]
    assert got == [re.sub(" +", " ", re.sub("@", "", re.sub("[^ ]+@[^ ]+", "", re.sub(" +", " ", t).strip(" ")))).strip(" ") for t in texts]


def test_colours_end_where_they_end(spark):
    df = spark.createDataFrame([("#ffFF00",), ("#ffff00\n",), ("hsl(1, 2%,3%)",), ("hsl(1,2%,3%)\r\n",), ("#ffff0",), (None,)], "c string")
    assert [r[0] for r in df.select(formats.valid_color(F.col("c"))).collect()] == [True, False, True, False, False, True]


def test_cleaning_keeps_exactly_its_characters(spark):
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kept in (text.ASCII, text.KEPT):
        row = spark.createDataFrame([(every,)], "t string").select(F.regexp_replace("t", text._outside(kept), "").alias("x")).first()
        assert row["x"] == "".join(sorted(kept))


def test_white_space_beside_every_character(spark):
    """Each white space, alone and doubled, between letters and beside the first characters beyond visible ASCII."""
    spaces = [chr(c) for a, b in text.WHITE_SPACE for c in range(a, b + 1)]
    rows = [f"{x}{s * n}{y}" for s in spaces for n in (1, 2) for x in "!~a\x7f\x21é" for y in "!~a\x7fé"]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").select("i", text._single_blanks(F.col("t")).alias("x")).collect()
    assert all(r["x"] == " ".join(filter(None, rows[r["i"]].split())) for r in got)


def test_texts_are_cleaned_once(spark):
    own = spark.createDataFrame([(1, "a  b")], "doc_id long, text string").select("doc_id", text.light_clean(F.col("text")).alias("text"))
    plan = chunk(own, cleaned=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(") == 1
    assert chunk(own.withColumn("text", F.lit(None).cast("string")), cleaned=True).count() == 0
