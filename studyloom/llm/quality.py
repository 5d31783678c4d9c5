"""Quality rules with adaptive thresholds.

Each text gets counts; texts that pass the fixed base rules feed quantile sketches, one for each language, source and
measure.  A sketch is a log-linear histogram: a rate in millionths falls into the bucket of its ``BITS`` leading bits, so a
quantile is exact to one part in 128.  Counts of buckets add up, so sketches merge in any order with the same result, a
language's sketch is the sum of its sources', and a run repeats to the last verdict.  A quantile of a group is drawn
towards its language's, and that towards all texts', with the weight of ``SHRINK`` texts, so a small group borrows nearly
all and a large one nothing, without a size at which verdicts jump.  A threshold is a fence: the upper quartile plus a
multiple of the quartile range plus a slack, so it follows the group's own spread and cuts no fixed share of clean text.
The joined filter then rejects what lies outside a fence.

DataFrame functions only.  One pass over the texts writes the counts; buckets are counted on the map side, so a source
with a third of all rows costs no more than another; fences are a row for each group and joined by their checked size.
The filter writes each row beside its counts and reads it back, so texts are never exchanged.

Defined cases: null and empty texts have no words and fail; null languages and sources form groups of their own;
repeated rows are judged each for itself; an empty table gives an empty result; other columns are ignored, or kept by
``filter_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studyloom.llm.shared import SPACE_CLASS, barrier, col, written

#: Words in a repeated window; least words; percent of words in repeated windows from which a text fails.
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
#: Leading bits of a bucket; texts that a group's language weighs; quartile ranges in a fence; groups up to which fences are broadcast.
BITS, SHRINK, RANGES, BROADCAST_GROUPS = 8, 50, 3, 100_000
MILLION = 1_000_000
#: Each measure: what is counted, of what, and the slack of its fence in millionths.
MEASURES = {
    "symbol_rate": ("n_symbols", "n_words", 100_000),
    "dup_line_rate": ("n_dup_lines", "n_lines", 350_000),
    "repeat_rate": ("n_repeat_words", "n_words", 200_000),
    "word_length": ("word_chars", "n_words", 1_000_000),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Measures with a lower fence too.
BOTH_SIDES = ("word_length",)


def with_counts(df: DataFrame, text: Column) -> DataFrame:
    """Adds _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words and _n_lines (long) for a text (null: empty)."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = barrier(df, _words=words, _lines=lines)
    df = barrier(
        df,
        _n_words=F.size("_words").cast("long"),
        _word_chars=F.char_length(F.array_join("_words", "")).cast("long"),
        _n_symbols=F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        _n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        _n_lines=F.size("_lines").cast("long"),
        _hashes=F.transform("_words", lambda w: F.xxhash64(w)),
    ).drop("_words", "_lines")
    last = F.size("_hashes") - WINDOW
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    df = barrier(df, _windows=windows).drop("_hashes")
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    pairs = F.when(repeated, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    df = barrier(df, _pairs=pairs).drop("_windows")
    again = F.filter("_pairs", lambda e, j: (F.get("_pairs", j - 1)["h"] == e["h"]) | (F.get("_pairs", j + 1)["h"] == e["h"]))
    starts = F.sort_array(F.transform(again, lambda e: e["i"]))
    covered = F.aggregate(starts, F.struct(F.lit(-WINDOW).alias("p"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("p"), (a["n"] + F.least(F.lit(WINDOW), p - a["p"])).alias("n")), lambda a: a["n"])
    return df.withColumn("_n_repeat_words", covered.cast("long")).drop("_pairs")


def base_failed(words: Column, repeats: Column) -> Column:
    return (words < LEAST_WORDS) | (100 * repeats > REPEAT_PERCENT * words)


def rate(measure: str) -> Column:
    """A measure in whole millionths; 0 of 0 is 0."""
    counted, of, _ = MEASURES[measure]
    return F.floor(F.col(counted) * MILLION / F.greatest(F.col(of), F.lit(1))).cast("long")


def bucket(value: Column) -> Column:
    """The least value with the same ``BITS`` leading bits, for values from 0 on."""
    width = F.pow(F.lit(2.0), F.greatest(F.char_length(F.bin(value)) - BITS, F.lit(0))).cast("long")
    return value - value % width


def sketches(counted: DataFrame) -> DataFrame:
    """lang, source, measure, bucket and n from texts that pass the base rules (rows of ``counted``)."""
    buckets = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(rate(m)).alias("bucket")) for m in MEASURES])
    each = counted.where(~F.col("base_failed")).select("lang", "source", F.inline(buckets))
    return each.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """For each group of keys and measure: n, q1 and q3, the first buckets that a quarter and three quarters of n reach."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    # some thousand buckets at most in a window, whatever the rows
    group = Window.partitionBy(*keys, "measure")
    upto = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "n": F.sum("n").over(group)})
    first = lambda quarters: F.min(F.when(4 * F.col("upto") >= quarters * F.col("n"), F.col("bucket")))
    return upto.groupBy(*keys, "measure").agg(F.max("n").alias("n"), first(1).alias("q1"), first(3).alias("q3"))


def shrunk(own: Column, n: Column, wider: Column) -> Column:
    """A quantile of n texts, drawn towards that of a wider group."""
    return (n * own + SHRINK * wider) / (n + SHRINK)


def thresholds(counted: DataFrame) -> DataFrame:
    """A written table of lang, source, and for each measure its fences, for every group with a text that passes the base rules."""
    sketch = written(sketches(counted), "quality-sketches")
    named = lambda df, name: df.select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns])
    own, langs, whole = named(quartiles(sketch, ["lang", "source"]), "o"), named(quartiles(sketch, ["lang"]), "l"), named(quartiles(sketch, []), "w")
    joined = own.join(langs, F.col("o_lang").eqNullSafe(F.col("l_lang")) & (F.col("o_measure") == F.col("l_measure")))
    joined = joined.join(F.broadcast(whole), F.col("o_measure") == F.col("w_measure"))  # a row for each measure
    q = {k: shrunk(F.col(f"o_q{k}"), F.col("o_n"), shrunk(F.col(f"l_q{k}"), F.col("l_n"), F.col(f"w_q{k}"))) for k in (1, 3)}
    slack = F.element_at(F.create_map(*[F.lit(x) for m, (_, _, size) in MEASURES.items() for x in (m, size)]), F.col("o_measure"))
    blended = joined.select(F.col("o_lang").alias("lang"), F.col("o_source").alias("source"), F.col("o_measure").alias("measure"), q[1].alias("q1"), q[3].alias("q3"), slack.alias("slack"))
    spread = RANGES * (F.col("q3") - F.col("q1")) + F.col("slack")
    of = lambda m, c: F.max(F.when(F.col("measure") == m, c))
    fences = blended.groupBy("lang", "source").agg(*[of(m, F.col("q3") + spread).alias(f"{m}_max") for m in MEASURES], *[of(m, F.col("q1") - spread).alias(f"{m}_min") for m in BOTH_SIDES])
    return written(fences, "quality-fences")


def judge(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds kept to rows with the counts, base_failed, lang and source; ``limits`` is a written table."""
    fences = limits.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *[c for c in limits.columns if c not in ("lang", "source")])
    if limits.count() <= BROADCAST_GROUPS:
        fences = F.broadcast(fences)
    joined = counted.join(fences, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    outside = F.lit(False)
    for m in MEASURES:
        outside = outside | F.coalesce(rate(m) > F.col(f"{m}_max"), F.lit(False))
        if m in BOTH_SIDES:
            outside = outside | F.coalesce(rate(m) < F.col(f"{m}_min"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~outside)


def _judged(docs: DataFrame, carried: list[Column], text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """The carried columns, lang, source, the counts, base_failed and kept of each row."""
    row = F.struct(*[col(c) for c in dict.fromkeys([text_col, lang_col, source_col])])
    own = docs.select(*carried, row.alias("_in"))
    names = [c for c in own.columns if c != "_in"]
    counted = with_counts(own, F.col("_in")[text_col])
    counted = counted.select(*names, F.col("_in")[lang_col].cast("string").alias("lang"), F.col("_in")[source_col].cast("string").alias("source"), *[F.col(f"_{c}").alias(c) for c in (*COUNTS, "n_lines")])
    counted = written(counted.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))), "quality-counts")
    return judge(counted, thresholds(counted))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row of ``docs``."""
    return _judged(docs, [col(id_col).alias("doc_id")], text_col, lang_col, source_col).select("doc_id", *COUNTS, "base_failed", "kept")


def filter_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, every column as it was."""
    whole = F.struct(*[col(c) for c in docs.columns]).alias("_row")
    return _judged(docs, [whole], text_col, lang_col, source_col).where("kept").select("_row.*")


def op5_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
