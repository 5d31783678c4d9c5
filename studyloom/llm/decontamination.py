"""Benchmark decontamination by a distributed positional inverted index.

The index stores a posting (term, document, position) for each token of the training texts, every term among them, and
one behind the last word that keeps the document's length.  Files stay split by document and are sorted by term, so
building needs no shuffle.  An index that has been built serves any test set.

Matching starts at the rarest terms.  Each test window names its rarest term and its second-rarest; the few lists of such
terms are taken from the index once.  Every different pair of terms at a distance is intersected there, once however many
windows name it, by moving one list by the offset of the other.  What is left are candidate alignments (item, document,
shift), and only the stretches of documents that hold one are looked up again, for the window's other terms.  Proximity
matches go the same way, with a reach in place of an offset: positions are dealt into blocks of some reaches, and only
postings of one block, or near its ends, meet, so that a long text with many postings of a term stays linear and can be
spread.  Work follows the rare lists, not the frequent ones; postings of a frequent term or passage spread over the
documents that hold it, and no list is gathered in one task.

DataFrame functions only.  What is broadcast has rows of fixed size, hashes and offsets, and is broadcast only up to
``shared.BROADCAST_ROWS`` of them, which is checked; beyond, it is joined by shuffle.

A document is told apart by 128 bits of hashes of its id and text, so rows that repeat an id with another text keep their
own hits.  Defined cases: null and empty texts have no words; empty items match nothing; items shorter than a window
are one window; equal items and repeated rows count once; a null item id reads ``null``; an empty table gives an empty
result; other columns are ignored, or kept by ``filter_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm.shared import ascii_lower, barrier, bounded, col, dropped, row_key, without, written
from studyloom.sources.storage import alone

#: Words in a window, and further words within which a window's terms count as near.
WINDOW, SLOP = 10, 5
#: Reaches in a block of positions: within one, postings meet.
BLOCK = 8
#: Passes in which an index is built, each for a part of the terms.
PASSES = 3
#: A document's key, and the same of another posting.
KEY, OTHER = ["_k1", "_k2"], ["_o1", "_o2"]
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words in order; the first or last element may be empty where the text begins or ends with a gap."""
    return F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), _GAP)


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """ikey, item (the id as string) and words, a row for each different item with a word."""
    own = benchmark.select(F.coalesce(col(id_col).cast("string"), F.lit("null")).alias("item"), F.filter(words_of(col(text_col)), lambda w: w != "").alias("words")).where(F.size("words") > 0)
    return own.distinct().select(F.xxhash64("item", "words").alias("ikey"), "item", "words")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passes: int = PASSES) -> DataFrame:
    """The written index: tid (the term's hash), _k1, _k2, pos, in files of a part of the terms each, sorted by term.

    A task sorts the postings of one part of the terms at a time, which bounds its memory; the texts are read ``passes`` times.  Behind the last word of each document stands a posting whose tid, 0 to 2, counts the empty words at its ends."""
    own = barrier(docs.select(*row_key(col(id_col), col(text_col)), col(text_col).alias("_text")), _w=words_of(F.col("_text"))).drop("_text")
    empty = (F.col("_w")[0] == "").cast("int") + ((F.size("_w") > 1) & (F.element_at("_w", -1) == "")).cast("int")
    posted = own.select(*KEY, F.posexplode(F.concat("_w", F.array(F.concat(F.lit("\0"), empty.cast("string"))))).alias("pos", "term")).where(F.col("term") != "")
    tid = F.when(F.col("term") < "\x01", F.substring("term", 2, 1).cast("long")).otherwise(F.xxhash64("term"))
    postings = posted.select(tid.alias("tid"), *KEY, "pos")
    first, *more = [postings.where(F.pmod("tid", F.lit(passes)) == k).sortWithinPartitions("tid") for k in range(passes)]
    return written(first, "index", *more)


def _other(postings: DataFrame) -> DataFrame:
    """Postings as the other side of a join: _t, _o1, _o2, _p."""
    return postings.select(F.col("tid").alias("_t"), *[F.col(k).alias(o) for k, o in zip(KEY, OTHER, strict=True)], F.col("pos").alias("_p"))


def _same() -> Column:
    return (F.col("_k1") == F.col("_o1")) & (F.col("_k2") == F.col("_o2"))


def _block(pos: Column, reach: int) -> Column:
    return F.floor(pos / (BLOCK * reach)).cast("int")


def _within(pos: Column, reach: int) -> Column:
    """The blocks that hold a position nearer than ``reach``: its own, and the next one if it is as near as that to an end."""
    return F.explode(F.array_distinct(F.array(_block(pos - (reach - 1), reach), _block(pos + (reach - 1), reach)))).alias("_block")


def lengths(index: DataFrame) -> DataFrame:
    """_k1, _k2 and n_words of every document."""
    return index.where(F.col("tid").isin(0, 1, 2)).groupBy(*KEY).agg(F.max(F.col("pos") - F.col("tid")).cast("long").alias("n_words"))


def tokens_of(items: DataFrame) -> DataFrame:
    """ikey, item_words, at, tid: a row for each word of each item."""
    tokens = items.select("ikey", F.size("words").alias("item_words"), F.posexplode("words").alias("at", "term"))
    return tokens.select("ikey", "item_words", "at", F.xxhash64("term").alias("tid"))


def windows_of(tokens: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """ikey, start, length and ranked, the window's (n, at, tid) from the rarest; windows with an unknown term can't match and are left out.

    ``tokens``: ikey, item_words, at, tid.
    """
    known = tokens.join(frequency, "tid", "left")
    length = F.least(F.lit(window), F.col("item_words"))
    first, last = F.greatest(F.lit(0), F.col("at") - length + 1), F.least(F.col("at"), F.col("item_words") - length)
    each = known.select("ikey", length.alias("length"), "at", "tid", F.coalesce("n", F.lit(0)).alias("n"), F.explode(F.sequence(first, last)).alias("start"))
    return each.groupBy("ikey", "start", "length").agg(F.min("n").alias("_least"), F.sort_array(F.collect_list(F.struct("n", "at", "tid"))).alias("ranked")).where(F.col("_least") > 0).drop("_least")


def look_up(index: DataFrame, tokens: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: the test set's terms, its windows with their rarest term and the second (tid, at, tid2, at2), and the postings of all such terms."""
    terms = written(tokens.select("tid").distinct(), "terms")
    frequency = written(index.join(bounded(terms), "tid", "left_semi").groupBy("tid").agg(F.count("*").alias("n")), "term-frequency")
    first, second = F.col("ranked")[0], F.get("ranked", F.least(F.lit(1), F.size("ranked") - 1))
    wins = windows_of(tokens, frequency, window).select("ikey", "start", "length", first["tid"].alias("tid"), first["at"].alias("at"), second["tid"].alias("tid2"), second["at"].alias("at2"), F.array_distinct("ranked.tid").alias("tids"))
    wins = written(wins, "windows")
    rare = written(wins.select("tid").union(wins.select("tid2")).distinct(), "rare-terms")
    lists = written(index.join(bounded(rare), "tid", "left_semi"), "rare-lists")
    dropped(frequency, rare)
    return terms, wins, lists


def _paired(lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """Postings of a pair's tid, with the pair's columns (a pair has tid and tid2)."""
    return lists.join(bounded(written(pairs.distinct(), "term-pairs")), "tid")


def alignments(wins: DataFrame, lists: DataFrame) -> DataFrame:
    """A written table of ikey, the key, shift (document minus item position) and wins (start, length), where the two rarest terms stand at the window's distance."""
    gap = (F.col("at2") - F.col("at")).alias("gap")
    found = _paired(lists, wins.select("tid", "tid2", gap)).join(_other(lists), _same() & (F.col("tid2") == F.col("_t")) & (F.col("_p") == F.col("pos") + F.col("gap")), "left_semi")
    # one posting serves all windows of an item that share the pair at the same place
    seeds = wins.groupBy("ikey", "tid", "at", "tid2", "at2").agg(F.collect_list(F.struct("start", "length")).alias("wins")).withColumn("gap", gap)
    aligned = found.join(seeds, ["tid", "tid2", "gap"]).select("ikey", *KEY, (F.col("pos") - F.col("at")).alias("shift"), "wins")
    return written(aligned.groupBy("ikey", *KEY, "shift").agg(F.array_distinct(F.flatten(F.collect_list("wins"))).alias("wins")), "alignments")


def near_seeds(wins: DataFrame, lists: DataFrame, slop: int, reach: int) -> DataFrame:
    """A written table of ikey, start, length, tids, the key and center (the rarest term's position) where the second-rarest stands within reach."""
    paired = _paired(lists, wins.select("tid", "tid2", "length")).withColumn("_own", _block(F.col("pos"), reach))
    other = _other(lists).select("*", _within(F.col("_p"), reach))
    found = paired.join(other, _same() & (F.col("tid2") == F.col("_t")) & (F.col("_own") == F.col("_block")) & (F.abs(F.col("_p") - F.col("pos")) < F.col("length") + slop), "left_semi")
    same = wins.select("ikey", "start", "tids", *[F.col(c).alias(f"_{c}") for c in ("tid", "tid2", "length")])
    joined = found.join(same, (F.col("tid") == F.col("_tid")) & (F.col("tid2") == F.col("_tid2")) & (F.col("length") == F.col("_length")))
    return written(joined.select("ikey", "start", "length", "tids", *KEY, F.col("pos").alias("center")), "near-seeds")


def spots_of(aligned: DataFrame, reach: int, seeds: DataFrame | None = None) -> DataFrame:
    """The key and _block of every stretch of a document in which a candidate alignment or seed has to be looked at."""
    first, last = (_block(F.col("shift") + F.col("w.start") + x, reach) for x in (F.lit(0), F.col("w.length") - 1))
    spots = aligned.select(*KEY, "shift", F.explode("wins").alias("w")).select(*KEY, F.explode(F.sequence(first, last)).alias("_block"))
    return spots if seeds is None else spots.union(seeds.select(*KEY, _within(F.col("center"), reach)))


def postings_in(index: DataFrame, terms: DataFrame, spots: DataFrame, reach: int) -> DataFrame:
    """_t, _o1, _o2, _p: a written table of the postings of ``terms`` at ``spots``."""
    some = written(spots.distinct(), "candidate-spots")
    known = index.join(bounded(terms), "tid", "left_semi").withColumn("_block", _block(F.col("pos"), reach))
    found = written(_other(known.join(bounded(some), [*KEY, "_block"], "left_semi")), "candidate-postings")
    dropped(some)
    return found


def phrase_matches(aligned: DataFrame, postings: DataFrame, tokens: DataFrame) -> DataFrame:
    """A written table of ikey, the key, shift and wins: the windows of an item all of whose terms stand in a document at one shift."""
    places = F.array_distinct(F.flatten(F.transform("wins", lambda w: F.sequence(w["start"], w["start"] + w["length"] - 1))))
    asked = aligned.select("ikey", *KEY, "shift", F.explode(places).alias("at")).join(tokens.select("ikey", "at", "tid"), ["ikey", "at"])
    met = asked.join(postings, _same() & (F.col("shift") + F.col("at") == F.col("_p")) & (F.col("tid") == F.col("_t")), "left_semi")
    there = met.groupBy("ikey", *KEY, "shift").agg(F.collect_set("at").alias("there"))  # an item's places at most
    ok = F.filter("wins", lambda w: F.size(F.array_intersect(F.sequence(w["start"], w["start"] + w["length"] - 1), "there")) == w["length"])
    return written(aligned.join(there, ["ikey", *KEY, "shift"]).select("ikey", *KEY, "shift", ok.alias("wins")).where(F.size("wins") > 0), "phrase-matches")


def proximity_matches(seeds: DataFrame, postings: DataFrame, slop: int, reach: int) -> DataFrame:
    """ikey, start and the key: windows of which each term stands, in any order, within ``length + slop`` words of the document."""
    asked = seeds.select("*", _within(F.col("center"), reach)).select("*", F.explode("tids").alias("want"))
    near = asked.join(postings.withColumn("_own", _block(F.col("_p"), reach)), _same() & (F.col("want") == F.col("_t")) & (F.col("_own") == F.col("_block")) & (F.abs(F.col("_p") - F.col("center")) < F.col("length") + slop))
    seen = near.groupBy("ikey", "start", "length", *KEY, "center").agg(F.size(F.any_value("tids")).alias("need"), F.collect_set(F.struct(F.col("_p").alias("pos"), F.col("_t").alias("tid"))).alias("seen"))  # two reaches at most
    fits = F.exists("seen", lambda s: F.size(F.array_distinct(F.transform(F.filter("seen", lambda x: (x["pos"] >= s["pos"]) & (x["pos"] < s["pos"] + F.col("length") + slop)), lambda x: x["tid"]))) == F.col("need"))
    return seen.where(fits).select("ikey", "start", *KEY).distinct()


def hits(items: DataFrame, found: DataFrame) -> DataFrame:
    """The key, n_hit, n_items, items (sorted ids, comma-joined) for documents with a phrase match."""
    words = found.select(*KEY, F.explode("wins").alias("w"), "shift").select(*KEY, F.explode(F.sequence(F.col("shift") + F.col("w.start"), F.col("shift") + F.col("w.start") + F.col("w.length") - 1)).alias("pos"))
    n_hit = words.distinct().groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    named = found.select("ikey", *KEY).distinct().join(items.select("ikey", "item"), "ikey").groupBy(*KEY).agg(F.sort_array(F.collect_set("item")).alias("names"))
    return n_hit.join(named, KEY).select(*KEY, "n_hit", F.size("names").cast("long").alias("n_items"), F.array_join("names", ",").alias("items"))


def _known(docs: DataFrame, items: DataFrame, window: int, slop: int, id_col: str, text_col: str) -> DataFrame:
    """The key, n_words, what :func:`hits` has and n_near_items of every document."""
    items, reach = written(items, "items"), window + slop
    tokens, index = tokens_of(items), build_index(docs, id_col, text_col)
    terms, wins, lists = look_up(index, tokens, window)
    aligned, seeds = alignments(wins, lists), near_seeds(wins, lists, slop, reach)
    dropped(lists)
    postings = postings_in(index, terms, spots_of(aligned, reach, seeds), reach)
    found = phrase_matches(aligned, postings, tokens)
    near = proximity_matches(seeds, postings, slop, reach).select("ikey", *KEY).distinct().join(items.select("ikey", "item"), "ikey")
    near = near.select(*KEY, "item").distinct().groupBy(*KEY).agg(F.count("*").alias("n_near_items"))
    return lengths(index).join(hits(items, found), KEY, "left").join(near, KEY, "left")


def _contaminated(docs: DataFrame, items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """The keys of documents with a phrase match."""
    items = written(items, "items")
    tokens, index = tokens_of(items), build_index(docs, id_col, text_col)
    terms, wins, lists = look_up(index, tokens, window)
    aligned = alignments(wins, lists)
    dropped(lists)
    return phrase_matches(aligned, postings_in(index, terms, spots_of(aligned, window), window), tokens).select(*KEY).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items and n_near_items for each row of ``docs``.

    n_near_items counts the items of which a window's terms stand close together in any order, exact ones among them;
    contaminated follows exact windows.
    """
    known = alone(docs.sparkSession, "document-hits", lambda: _known(docs, items_of(benchmark, item_col, item_text_col), window, slop, id_col, text_col))
    own = docs.select(col(id_col).alias("doc_id"), *row_key(col(id_col), col(text_col)))
    zero, names = F.lit(0).cast("long"), F.coalesce("items", F.lit(""))
    return own.join(known, KEY, "left").select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.sha2(names, 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), names.alias("items"), F.coalesce("n_near_items", zero).alias("n_near_items"))


def filter_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a phrase match, every column as it was; of a match only the key is joined, by broadcast within the bound."""
    bad = alone(docs.sparkSession, "contaminated", lambda: _contaminated(docs, items_of(benchmark, item_col, item_text_col), window, id_col, text_col))
    return without(docs, bad, col(id_col), col(text_col))


def op6_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("items")
