"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates in each text; a hash of each candidate value is counted over the whole corpus by distinct
repositories and distinct owners.  A value that many owners publish, or that stands in many repositories of a few, is a
widely copied example; any other that looks like a credential is live and belongs to its owner.  The verdicts are spans
of their own: kinds ``live`` and ``example``, around the value alone, beside the base kinds (``KINDS``).

DataFrame functions only.  A start offset is the sum of the gaps and matches before it: ``split`` and
``regexp_extract_all`` walk a text by the same leftmost, non-overlapping rule, and sums are taken in ``STRIDE`` steps, so
that many matches don't copy each other.  Only texts that a cheap test lets through are walked.  Frequencies are taken
over distinct (value, owner, repository), summed on the map side at each step, so a value that stands in a third of all
texts costs one row for each task; verdicts are joined once for each distinct set of candidates.  Values leave a task as
hashes only, and texts without a candidate are never exchanged.

Defined cases: null and empty texts have no span; null owners count as one owner; null ids are one repository of their
owner; repeated rows each get their result and count once; an empty table gives an empty result; other columns are
ignored, or kept by ``redact_documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm.shared import barrier, col, written

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, group that holds the value and ends the match, its least length, and a test that every text with a match passes.
KINDS = (
    ("assign", _ASSIGN, 1, 6, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, None),
    ("hex", r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
)
BASE_KINDS = tuple(kind for kind, *_ in KINDS)
ADDED_KINDS = ("live", "example")
#: Owners or repositories from which a value counts as widely copied, and distinct characters from which one looks live.
EXAMPLE_OWNERS, EXAMPLE_REPOS, LIVE_CHARACTERS = 3, 20, 6
#: Words that mark a placeholder.
PLACEHOLDER = "(?i)example|changeme|placeholder|dummy|sample|your_|xxxx|1234567"
#: Matches whose lengths are summed in one step, and characters of a stretch from which parts of a text are taken.
STRIDE, STRETCH = 128, 4096

#: Start, kind, end, start of the value, its hash, and whether it looks like a credential.
_SPAN = "struct<a:int,k:int,b:int,v:int,hash:string,looks:boolean>"


def running(values: str, largest: bool = False) -> Column:
    """For each element of an array column of integers the sum, or the largest, of those before it; 0 for the first."""
    n = F.size(values)
    both = (lambda a, x: F.greatest(a, x)) if largest else (lambda a, x: a + x)
    upto = lambda k: F.sequence(F.lit(0), F.greatest(k, F.lit(0)))
    block = lambda i: F.floor(i / STRIDE).cast("int")
    over = lambda at, size, start: F.aggregate(F.slice(values, at, size), start, both)
    each = F.transform(upto(block(n - 1)), lambda b: over(b * STRIDE + 1, F.lit(STRIDE), F.lit(0)))
    firsts = F.aggregate(each, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, both(F.element_at(acc, -1), x)))
    made = F.transform(F.array(firsts), lambda f: F.transform(upto(n - 1), lambda i: over(block(i) * STRIDE + 1, i % STRIDE, F.get(f, block(i)))))
    return F.when(n > 0, made[0]).otherwise(F.array().cast("array<int>"))


def _spans(kind: str, k: int, pattern: str, group: int, least: int) -> Column:
    """Spans from the matches and the starts of each gap and match."""

    def made(match: Column, i: Column) -> Column:
        value = F.regexp_extract(match, pattern, group) if group else match
        end = F.get(f"s_{kind}", i) + F.get(f"l_{kind}", i)
        looks = (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)
        span = F.struct((end - F.char_length(match)).alias("a"), F.lit(k).alias("k"), end.alias("b"), (end - F.char_length(value)).alias("v"), F.sha2(value, 256).alias("hash"), looks.alias("looks"))
        return F.when(F.char_length(value) >= least, span)

    return F.filter(F.transform(f"m_{kind}", made), lambda s: s.isNotNull())


def _may_match(text: Column) -> dict[str, Column]:
    """For each kind, a cheap test that every text with a match passes."""
    return {kind: F.contains(text, F.lit("AKIA")) if test is None else text.rlike(test) for kind, _, _, _, test in KINDS}


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, rows: bool = False) -> DataFrame:
    """doc_id, owner, repo and spans, the candidates of each row by start and then kind; with ``rows`` also _row, the whole row."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    whole = [F.struct(*[col(c) for c in docs.columns]).alias("_row")] if rows else []
    df = docs.select(col(id_col).alias("doc_id"), col(owner_col).cast("string").alias("owner"), col(repo_col or id_col).cast("string").alias("repo"), text.alias("_text"), *whole)
    kept = ["doc_id", "owner", "repo", *(["_row"] if rows else [])]
    none, may = F.array().cast("array<string>"), _may_match(F.col("_text"))
    df = barrier(df, **{f"m_{kind}": F.when(may[kind], F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(none) for kind, pattern, *_ in KINDS})
    gaps = lambda kind, pattern: F.when(F.size(f"m_{kind}") > 0, F.split("_text", pattern)).otherwise(none)
    df = barrier(df, **{f"g_{kind}": gaps(kind, pattern) for kind, pattern, *_ in KINDS})
    # a gap and the match behind it
    steps = lambda kind: F.transform(f"m_{kind}", lambda m, i: F.char_length(F.get(f"g_{kind}", i)) + F.char_length(m))
    df = barrier(df, **{f"l_{kind}": steps(kind) for kind, *_ in KINDS})
    df = barrier(df, **{f"s_{kind}": running(f"l_{kind}") for kind, *_ in KINDS})
    spans = F.concat(*[_spans(kind, k, pattern, group, least) for k, (kind, pattern, group, least, _) in enumerate(KINDS)])
    return df.select(*kept, F.sort_array(spans.cast(f"array<{_SPAN}>")).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners over all rows of :func:`candidates`."""
    each = found.where(F.size("spans") > 0).select(F.explode(F.array_distinct("spans.hash")).alias("hash"), F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"))
    by_owner = each.distinct().groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def verdicts(found: DataFrame, owners: int = EXAMPLE_OWNERS, repos: int = EXAMPLE_REPOS) -> DataFrame:
    """_key, a hash of a set of spans, and judged, those spans with n_owners, n_repos, example and live.

    ``found`` is read twice; give a written table.
    """
    sets = found.where(F.size("spans") > 0).select(_key().alias("_key"), "spans").groupBy("_key").agg(F.any_value("spans").alias("spans"))
    each = sets.select("_key", F.explode("spans").alias("s")).join(ownership(found).withColumnRenamed("hash", "_hash"), F.col("s.hash") == F.col("_hash"))
    example = (F.col("n_owners") >= owners) | (F.col("n_repos") >= repos)
    judged = F.struct("s.a", "s.k", "s.b", "s.v", "n_owners", "n_repos", example.alias("example"), (~example & F.col("s.looks")).alias("live"))
    return each.groupBy("_key").agg(F.sort_array(F.collect_list(judged)).alias("judged"))  # the spans of one text


def _key() -> Column:
    return F.sha2(F.to_json("spans"), 256)


def with_verdicts(found: DataFrame) -> DataFrame:
    """The rows of a written table of candidates that have any, with judged; the others are left out."""
    return found.where(F.size("spans") > 0).withColumn("_key", _key()).join(verdicts(found), "_key").drop("_key")


def _said(spans: Column, *fields: str) -> Column:
    """Fields of each span, the kind's name for k, joined by colons and commas."""
    names = F.array(*[F.lit(k) for k in (*BASE_KINDS, *ADDED_KINDS)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *[F.get(names, s["k"]) if f == "k" else s[f].cast("string") for f in fields])), ",")


def scan(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, n_live, n_example and ownership (start:owners:repositories of each value)."""
    found = written(candidates(docs, **columns), "secret-candidates")
    own = lambda test, k: F.transform(F.filter("judged", lambda s: s[test]), lambda s: F.struct(s["v"].alias("a"), F.lit(k).alias("k"), s["b"].alias("b")))
    base = F.transform("judged", lambda s: F.struct(s["a"], s["k"], s["b"]))
    judged = barrier(with_verdicts(found), _all=F.sort_array(F.concat(base, own("live", len(KINDS)), own("example", len(KINDS) + 1))))
    spans = F.filter("_all", lambda s, i: ~s.eqNullSafe(F.get("_all", i - 1)))  # two kinds may hold one value
    number = lambda test: F.size(F.filter("judged", test)).cast("long")
    of = lambda k: lambda s: s["k"] == k
    counts = [number(of(k)).alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)]
    some = judged.select("doc_id", *counts, F.sha2(_said(base, "k", "a", "b"), 256).alias("base_sha256"), _said(spans, "k", "a", "b").alias("spans"), number(lambda s: s["live"]).alias("n_live"), number(lambda s: s["example"]).alias("n_example"), _said(F.col("judged"), "v", "n_owners", "n_repos").alias("ownership"))
    zero, empty = F.lit(0).cast("long"), F.lit("")
    none = {**{f"n_{kind}": zero for kind in BASE_KINDS}, "base_sha256": F.sha2(empty, 256), "spans": empty, "n_live": zero, "n_example": zero, "ownership": empty}
    return some.unionByName(found.where(F.size("spans") == 0).select("doc_id", *[c.alias(n) for n, c in none.items()]))


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """The rows of ``docs``, every column as it was, but each live-looking credential in the text replaced by ``<secret>``.

    Widely copied examples stay.  Rows that may hold a candidate, by the cheap tests, are written with what they hold; only
    those that hold one are joined, and all others are passed on as they are read.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    possible = functools.reduce(lambda a, b: a | b, _may_match(text).values())
    found = written(candidates(docs.where(possible), id_col, text_col, owner_col, repo_col, rows=True), "secret-candidates")
    some = with_verdicts(found).withColumn("_text", F.coalesce(F.col("_row")[text_col].cast("string"), F.lit("")))
    live = F.transform(F.filter("judged", lambda s: s["live"]), lambda s: F.struct(s["v"], s["b"]))
    some = barrier(some, _live=F.sort_array(live))
    some = barrier(some, _ends=F.transform("_live", lambda s: s["b"]), _stretches=F.when(F.size("_live") > 0, F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))))
    some = barrier(some, _before=running("_ends", largest=True))
    block = lambda i: F.floor(i / STRETCH).cast("int")
    # the text from a place to another; the work follows the part's length, not the place
    part = lambda a, b: F.substring(F.array_join(F.slice("_stretches", block(a) + 1, block(b) - block(a) + 1), ""), a % STRETCH + 1, b - a)
    # a value that begins within one before it has gone with that one
    kept = F.transform("_live", lambda s, i: F.when(s["v"] >= F.get("_before", i), F.concat(part(F.get("_before", i), s["v"]), F.lit("<secret>"))).otherwise(""))
    end = F.array_max("_ends")
    cut = F.concat(F.array_join(kept, ""), part(end, F.char_length("_text")))
    changed = F.when(F.size("_live") > 0, cut).otherwise(F.col("_row")[text_col].cast("string"))
    out = some.select(F.struct(*[changed.alias(c) if c.lower() == text_col.lower() else F.col("_row")[c].alias(c) for c in docs.columns]).alias("_row"))
    return out.unionByName(found.where(F.size("spans") == 0).select("_row")).select("_row.*").unionByName(docs.where(~possible))


def op4_ownership_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
