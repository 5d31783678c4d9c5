"""URL filters: list rules first, then a naive Bayes verdict over words that a Viterbi search finds in host and path.

Host names run words together.  A unigram model, counted over the whole corpus, lets a Viterbi search split each run of
letters into its most probable words; multinomial naive Bayes then scores the words of host and path.  It learns from the
urls that a rule decides, all of them, and judges the others.

Both models are whole, every word and every token counts, and both stay tables: nothing that grows with the urls reaches
the driver or is held by a worker.  Each different run of letters is split once, by a row that carries the counts of the
words that it holds.  Token counts are sums over different runs, a run's score is the sum of its tokens' log odds, and a
url's score the sum of its runs', in whole billionths, so that no order of summing changes a verdict.  Scores of runs are
rows of fixed size and broadcast within the bound; beyond, they are joined by shuffle, where the skew join splits a run
that a third of the urls share.  Rules are configuration, a few hundred at most, and become one expression.

Defined cases: a null url or one without ``://`` has an empty host and path and is allowed; null ids are kept; repeated
rows each get their result; with no row that a rule blocks, or none that it allows, all others are allowed; an empty table
gives an empty result; columns besides the named ones are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm.shared import ascii_lower, bounded, col, dropped, freed, row_key, written

#: Letters of the longest word.
LONGEST = 20
#: Parts of one in which log odds are summed.
BILLION = 1_000_000_000
#: The registered query's rules: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: What tokens are made of: letters, digits, which count as one kind, and what lies beyond ASCII.
_RUNS = r"[a-z]+|[0-9]+|[^\x00-\x7F]+"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, ascii_lower(F.regexp_extract(F.substring(url, at + 3, F.lit(2147483647)), "^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.regexp_replace(F.substring(url, at + 3, F.lit(2147483647)), "^[^/?#]*", ""), "^[^?#]*", 0)).otherwise("")


def split_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path"""
    url = F.coalesce(col(url_col).cast("string"), F.lit(""))
    return pages.select(col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))


def with_rules(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds rule (host and path as written) and ruled (its verdict), null where no rule fits; the longest fitting rule wins."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the last applied, the longest, is asked first
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, ruled = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    return urls.withColumns({"rule": rule, "ruled": ruled})


def runs_of(urls: DataFrame) -> DataFrame:
    """rid, ruled, mark (h: or p:) and run: a row for each run of each url of ``urls`` (rid, host, path, ruled)."""
    both = F.array(F.struct(F.lit("h:").alias("mark"), F.col("host").alias("part")), F.struct(F.lit("p:").alias("mark"), F.lower("path").alias("part")))
    parts = urls.select("rid", "ruled", F.inline(both))
    return parts.select("rid", "ruled", "mark", F.explode(F.regexp_extract_all("part", F.lit(_RUNS), F.lit(0))).alias("run"))


def word_counts(texts: DataFrame, text_col: str, longest: int = LONGEST) -> DataFrame:
    """A written table of w and n: counts over all rows of all words of letters a to z; markup left out."""
    bare = F.regexp_replace(F.lower(col(text_col).cast("string")), "<[^>]*>", " ")
    words = texts.select(F.explode(F.regexp_extract_all(bare, F.lit(f"[a-z]{{2,{longest}}}"), F.lit(0))).alias("w"))
    return written(words.groupBy("w").agg(F.count("*").alias("n")), "word-counts")


def words_within(runs: DataFrame, counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """run and known, the words with counts that stand in it, for each run of letters of ``runs`` (run, each once)."""
    ends = runs.select("run", F.explode(F.sequence(F.lit(1), F.char_length("run"))).alias("at")).select("run", F.substring("run", F.col("at"), F.lit(longest)).alias("end"))
    words = ends.where(F.char_length("end") > 1).select("run", F.explode(F.transform(F.sequence(F.lit(2), F.char_length("end")), lambda n: F.substring("end", F.lit(1), n))).alias("w")).distinct()
    known = words.join(counts, "w").groupBy(F.col("run").alias("_run")).agg(F.collect_list(F.struct("w", "n")).alias("known"))  # a run's own stretches at most
    return runs.join(known, F.col("run") == F.col("_run"), "left").select("run", F.coalesce("known", F.array().cast("array<struct<w:string,n:bigint>>")).alias("known"))


def split_letters(letters: str, counts: dict[str, int], total: int, longest: int = LONGEST) -> list[str]:
    """The most probable split of letters into words under a unigram model; unknown words cost more the longer they are."""
    every = math.log(total or 1)
    cost = {w: every - math.log(n) for w, n in counts.items()}
    unknown = [every + k * math.log(10) for k in range(longest + 1)]
    best, back = [0.0], [0]
    for end in range(1, len(letters) + 1):
        found, start = min((best[k] + cost.get(letters[k:end], unknown[end - k]), k) for k in range(max(0, end - longest), end))
        best.append(found)
        back.append(start)
    out, end = [], len(letters)
    while end:
        out.append(letters[back[end] : end])
        end = back[end]
    return out[::-1]


def segmented(within: DataFrame, total: int) -> DataFrame:
    """run and words, in order, for rows of :func:`words_within`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(0).to_pylist()
            words = [split_letters(r, {x["w"]: x["n"] for x in known.as_py()}, total) for r, known in zip(runs, batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(words, pa.list_(pa.string()))], names=["run", "words"])

    return within.select("run", "known").mapInArrow(freed(run), "run string, words array<string>")


def tokens_of(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """A written table of mark, run, b, a and token for a written table of mark, run, b and a: a row for each word of each run."""
    letters = F.col("run").rlike("^[a-z]")
    total = counts.agg(F.sum("n")).first()[0] or 0
    split = segmented(words_within(runs.where(letters).select("run").distinct(), counts), total)
    named = runs.where(letters).join(split, "run").select("mark", "run", "b", "a", F.explode("words").alias("word"))
    others = runs.where(~letters).select("mark", "run", "b", "a", F.when(F.col("run").rlike("^[0-9]"), "0").otherwise(F.col("run")).alias("word"))
    return written(named.unionByName(others).select("mark", "run", "b", "a", F.concat("mark", "word").alias("token")), "url-tokens")


def in_billionths(x: Column) -> Column:
    return F.round(x * BILLION).cast("long")


def log_odds(tokens: DataFrame) -> DataFrame:
    """token and odds, block against allow, Laplace-smoothed, in billionths, from rows with b and a, the occurrences in blocked and allowed urls."""
    table = written(tokens.groupBy("token").agg(F.sum("b").alias("b"), F.sum("a").alias("a")).where("a + b > 0"), "token-counts")
    sums = table.agg(F.count("*").alias("kinds"), F.sum("b").alias("b"), F.sum("a").alias("a")).first()
    block, allow = ((x or 0) + sums["kinds"] + 1 for x in (sums["b"], sums["a"]))
    return table.select(F.col("token").alias("_token"), in_billionths(F.log((F.col("b") + 1) / block) - F.log((F.col("a") + 1) / allow)).alias("odds"))


def url_scores(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """A written table of rid and score, the log odds of block in billionths without the prior, for urls that have a run."""
    each, blocked = runs_of(urls), F.col("ruled") == "block"
    runs = written(each.groupBy("mark", "run").agg(F.count_if(blocked).alias("b"), F.count_if(F.col("ruled") == "allow").alias("a")), "url-runs")
    tokens = tokens_of(runs, counts)
    odds = log_odds(tokens)
    key = row_key(F.col("mark"), F.col("run"))
    scored = tokens.join(odds, F.col("token") == F.col("_token"), "left").groupBy("mark", "run").agg(F.sum(F.coalesce("odds", F.lit(0))).alias("score"))
    scored = written(scored.select(*key, "score"), "run-scores")
    scores = each.select("rid", *key).join(bounded(scored), ["_k1", "_k2"]).groupBy("rid").agg(F.sum("score").alias("score"))
    scores = written(scores, "url-scores")
    dropped(runs, tokens, scored)
    return scores


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict and score (log odds of block) of every page; words are counted over the pages' own texts."""
    urls = written(with_rules(split_urls(pages, id_col, url_col), rules).withColumn("rid", F.monotonically_increasing_id()), "urls")
    counts = word_counts(pages, text_col)
    scores = url_scores(urls, counts).withColumnRenamed("rid", "_rid")
    dropped(counts)
    rows = urls.agg(F.count_if(F.col("ruled") == "block").alias("b"), F.count_if(F.col("ruled") == "allow").alias("a")).first()
    ready = min(rows) > 0
    prior = round(math.log(rows["b"] / rows["a"]) * BILLION) if ready else 0
    score = F.coalesce("score", F.lit(0)) + F.lit(prior) if ready else F.lit(0)
    judged = urls.join(scores, F.col("rid") == F.col("_rid"), "left").withColumn("score", score.cast("long"))
    learned = F.when(((F.col("host") != "") | (F.col("path") != "")) & (F.col("score") > 0), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), (F.col("score") / BILLION).alias("score"))


def op7_host_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
