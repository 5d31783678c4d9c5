"""Near duplicates by a signature-coordinate inverted join.

Each text becomes a set of hashed word shingles, and each different set one class with a MinHash signature of
``COORDINATES`` values.  Classes are posted under every (coordinate, value) pair.  A pair of classes at the similarity
threshold agrees on at least :func:`matches_for` coordinates but for a chance of about one in a hundred thousand, so it must
meet in the first ``COORDINATES - matches + 1`` coordinates of either in any common order (the prefix).  The order is
by rising frequency: values that one class alone has use up prefix places and are never joined, and a class with more
such values than a match allows is left out at once; frequent values fall behind the prefix.

Lists are merged with skipping.  First each list only compares its members with one pivot, the same class in as many
lists as possible, so that a large group of copies costs one comparison for each member, not one for each pair.
Then lists whose members are all linked already are skipped, and what is left is compared across components, so no link
is lost; in long lists, where nearly all agree on many coordinates, whole-set bounds leave out what can't be similar
(:func:`long_list_pairs`).  Pairs that collide on enough coordinates are confirmed on the full sets; the links' connected components are
found by label propagation with pointer jumping, on written tables.

Classes and rows are told apart by 128 bits, shingles by 64; classes are numbered once their table is written.  Full sets are
hashed once, for the classes that meet another in a list.  Texts are hashed ``PIECE`` bytes at a time, so a long one
takes memory for its words only.  Defined cases: null and empty texts, and rows without an id, are linked with
nothing; texts shorter than a shingle are one shingle; equal texts are one class; rows that repeat an id with another
text are classes of their own under that id; rows that repeat id and text are judged alike, and ``filter_documents`` leaves
one of them; an empty table gives an empty result; other columns are ignored, or kept by ``filter_documents``.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm.shared import bounded, col, dropped, freed, row_key, without, written
from studyloom.sources.storage import alone

#: Words of a shingle and percent of similarity, unless a caller says otherwise.
SHINGLE, PERCENT = 5, 80
#: Signature length, and how many standard deviations below its mean a pair's number of agreeing coordinates may lie.
COORDINATES, DEVIATIONS = 64, 4.7
#: Members beyond which a list that holds several components is merged by whole-set bounds.
LONG_LIST = 64
#: Bytes of text that are taken together, and of these the bytes that are hashed side by side.
BLOCK, PIECE = 1 << 20, 1 << 18
_BASE = 0x9E3779B97F4A7C15


def matches_for(percent: int) -> int:
    """Coordinates on which a pair must agree: 36 of 64 for 80 percent."""
    p = percent / 100
    return max(1, int(COORDINATES * p - DEVIATIONS * math.sqrt(COORDINATES * p * (1 - p))))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64 bits, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def _tables(coordinates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte (capitals as small letters, white space 0), and each coordinate's xor and odd factor."""
    rng = np.random.default_rng(20240607)
    draw = lambda n: rng.integers(1, 1 << 64, n, dtype=np.uint64)
    byte = draw(256) | np.uint64(1)
    byte[65:91] = byte[97:123]
    byte[[9, 10, 11, 12, 13, 32]] = 0
    return byte, draw(coordinates), draw(coordinates) | np.uint64(1)


@functools.cache
def _powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of an odd base, or of its inverse, modulo 2**64."""
    out = np.full(n, np.uint64(pow(_BASE, -1, 1 << 64) if inverse else _BASE))
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of some bytes, and where it starts.

    A word's hash is a polynomial over random byte values, taken from running sums over ``PIECE`` bytes at a time; a word
    that goes on in the next piece is the sum of its parts, the later ones times the base to the length before.
    """
    byte, _, _ = _tables(COORDINATES)
    powers, inverse = _powers(PIECE + 1), _powers(PIECE + 1, inverse=True)
    raws, starts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    open_at, open_raw, open_size = -1, 0, 0
    for at in range(0, len(data), PIECE):
        values = byte[data[at : at + PIECE]]
        n = len(values)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers[:n], out=sums[1:])
        inside = np.concatenate([[False], values != 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edges[::2], edges[1::2]
        raw, begin = (sums[last] - sums[first]) * inverse[first], first + at
        if open_at >= 0:
            if len(first) and first[0] == 0:
                raw[0] = np.uint64((open_raw + int(raw[0]) * pow(_BASE, open_size, 1 << 64)) % (1 << 64))
                begin[0] = open_at
            else:
                raws.append(np.array([open_raw], np.uint64))
                starts.append(np.array([open_at], np.int64))
            open_at = -1
        if len(last) and last[-1] == n and at + n < len(data):
            open_at, open_raw, open_size = int(begin[-1]), int(raw[-1]), at + n - int(begin[-1])
            raw, begin = raw[:-1], begin[:-1]
        raws.append(raw)
        starts.append(begin)
    if open_at >= 0:
        raws.append(np.array([open_raw], np.uint64))
        starts.append(np.array([open_at], np.int64))
    return _mix(np.concatenate(raws)), np.concatenate(starts)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``words`` words, A to Z lower-cased; all its words if it has fewer."""
    hashes, starts = word_hashes(np.frombuffer(b"\n".join([*texts, b""]), np.uint8))
    sizes = np.array([len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    n = len(hashes)
    runs = np.zeros(max(0, n - words + 1), np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    for k in range(words):
        runs *= factor
        runs += hashes[k : k + len(runs)]
    runs = _mix(runs)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        else:
            out.append(np.frombuffer(hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest(), np.uint64) if b > a else np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """(sets, coordinates) of signed 32-bit values; every set has a member."""
    _, xor, factor = _tables(coordinates)
    everything = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets)])[:-1]
    out, held = np.empty((len(sets), coordinates), np.int32), np.empty_like(everything)
    for j in range(coordinates):
        np.bitwise_xor(everything, xor[j], out=held)
        held *= factor[j]
        out[:, j] = (np.minimum.reduceat(held, first) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def class_id(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two numbers."""
    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts, about ``BLOCK`` bytes at a time."""
    ids, texts, size = [], [], 0
    for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        ids.append(doc)
        texts.append((value.as_py() or "").encode())
        size += len(texts[-1])
        if size >= BLOCK:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def signed(docs: DataFrame, words: int) -> DataFrame:
    """_k1, _k2, doc_id, n_shingles, h1 and h2 (the class) and sig; the last three are null for an empty set.  ``docs``: doc_id, text, _k1, _k2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in _blocks(batch):
                own = slice(at, at := at + len(ids))
                sets = shingle_sets(texts, words)
                some = [s for s in sets if len(s)]
                rows = iter(signatures(some).tolist() if some else [])
                sigs = [next(rows) if len(s) else None for s in sets]
                classes = [class_id(s) if len(s) else (None, None) for s in sets]
                columns = [batch.column(2)[own], batch.column(3)[own], pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *[pa.array([c[k] for c in classes], pa.int64()) for k in (0, 1)], pa.array(sigs, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["_k1", "_k2", "doc_id", "n_shingles", "h1", "h2", "sig"])

    return docs.select("doc_id", "text", "_k1", "_k2").mapInArrow(freed(run), "_k1 long, _k2 long, doc_id long, n_shingles long, h1 long, h2 long, sig array<int>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """h1, h2 and members, the whole set.  ``docs``: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _blocks(batch):
                sets = shingle_sets(texts, words)
                members = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                classes = [class_id(s) for s in sets]
                yield pa.RecordBatch.from_arrays([*[pa.array([c[k] for c in classes], pa.int64()) for k in (0, 1)], members], names=["h1", "h2", "members"])

    return docs.select("doc_id", "text").mapInArrow(freed(run), "h1 long, h2 long, members array<bigint>")


def similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def coordinate_lists(classes: DataFrame, matches: int) -> DataFrame:
    """key, node, n: the postings of each class's prefix under (coordinate, value) keys, without keys that no other class has."""
    posted = classes.select("node", F.col("n_shingles").alias("n"), F.posexplode("sig").alias("j", "v")).select("node", "n", (F.shiftleft(F.col("j").cast("long"), 32) + F.col("v").cast("long") + (1 << 31)).alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("often")).where("often > 1").withColumnRenamed("key", "_key")
    common = posted.join(shared, F.col("key") == F.col("_key")).groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("keys")).where(F.size("keys") >= matches)
    return common.select("node", "n", F.explode(F.slice("keys", F.lit(1), F.size("keys") - matches + 1)).alias("k")).select(F.col("k.key").alias("key"), "node", "n")


def pivot_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """a < b: every member of a list with the list's pivot, the member first by a hash that all lists share."""
    pivot = lists.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "n")).alias("p")).withColumnRenamed("key", "_key")
    met = lists.join(pivot, F.col("key") == F.col("_key")).where((F.col("node") != F.col("p.node")) & similar_sizes(F.col("n"), F.col("p.n"), percent))
    return met.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists with members in more than one component, with label and size, the list's length, added."""
    own = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = own.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo < hi").select(F.col("key").alias("_key"), "size")
    return own.join(mixed, F.col("key") == F.col("_key")).select(*lists.columns, "label", "size")


def enough(f: Column, n: Column, n2: Column, percent: int) -> Column:
    """Whether sets of n and n2 with f in common are similar; f = n says no more than that their sizes allow it."""
    return 100 * f >= percent * (n + n2 - f)


def cross_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """a < b: members of a list that are in different components; f is the most that a member can share with another."""
    right = mixed.select(*[F.col(c).alias(f"{c}2") for c in ("key", "node", "n", "label", "f")])
    met = mixed.join(right, (F.col("key") == F.col("key2")) & (F.col("node") < F.col("node2")) & (F.col("label") != F.col("label2")) & enough(F.least("f", "f2"), F.col("n"), F.col("n2"), percent))
    return met.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()


def major_of(mixed: DataFrame) -> DataFrame:
    """_key and major: each list's largest component."""
    return mixed.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy(F.col("key").alias("_key")).agg(F.max(F.struct("c", "label"))["label"].alias("major"))


def minor_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """a < b: every member outside a list's largest component with two members of that component, others in each list."""
    own = mixed.join(major_of(mixed), F.col("key") == F.col("_key"))
    pivots = own.where(F.col("label") == F.col("major")).groupBy(F.col("key").alias("_p")).agg(*[f(F.struct(F.xxhash64("key", "node").alias("h"), "node", "n")).alias(f"p{k}") for k, f in enumerate((F.min, F.max))])
    met = own.where(F.col("label") != F.col("major")).join(pivots, F.col("key") == F.col("_p")).select("node", "n", F.explode(F.array("p0", "p1")).alias("p")).where(similar_sizes(F.col("n"), F.col("p.n"), percent))
    return met.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def long_list_pairs(mixed: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a < b across components of long lists; ``sets`` holds their members.

    Among these members a shingle is rare if ``LONG_LIST`` of them have it or fewer.  Two members with a rare shingle in
    common meet under it, in a short list, and count if the shingles that each shares with anyone are enough.  All
    others have only frequent shingles in common, f of them or fewer, with f the smaller number of frequent ones, and so
    are similar only if f is large enough against their sizes.  Most members that are linked with none fail that even
    against the best of their list.
    """
    posted = sets.select("node", F.size("members").alias("n"), F.explode("members").alias("key"))
    often = posted.groupBy("key").agg(F.count("*").alias("often")).withColumnRenamed("key", "_key")
    posted = written(posted.join(often, F.col("key") == F.col("_key")).select("key", "node", "n", "often"), "member-shingles")
    weights = posted.groupBy("node", "n").agg(F.count_if(F.col("often") > LONG_LIST).alias("f"), F.count_if(F.col("often") > 1).alias("shared"))
    weights = written(weights.withColumnRenamed("node", "_node"), "member-weights")

    rare = posted.where((F.col("often") > 1) & (F.col("often") <= LONG_LIST)).join(weights.drop("n"), F.col("node") == F.col("_node")).select("key", "node", "n", F.col("shared").alias("f"))
    rare = cross_pairs(labelled(rare, labels), percent)
    members = written(mixed.join(weights.drop("n"), F.col("node") == F.col("_node")).select("key", "node", "n", "label", "f"), "long-lists")
    most = members.groupBy("key").agg(F.min("n").alias("least_n"), F.max("f").alias("most_f")).join(major_of(members), F.col("key") == F.col("_key")).drop("key")

    keys = members.groupBy(F.col("node").alias("_n")).agg(F.collect_set("key").alias("keys"))
    members = members.join(keys, F.col("node") == F.col("_n")).drop("_n")
    minor = members.join(most, F.col("key") == F.col("_key")).where((F.col("label") != F.col("major")) & enough(F.least("f", "most_f"), F.col("n"), F.col("least_n"), percent))
    right = members.select(*[F.col(c).alias(f"{c}2") for c in members.columns])
    met = minor.join(right, (F.col("key") == F.col("key2")) & (F.col("label") != F.col("label2")) & enough(F.least("f", "f2"), F.col("n"), F.col("n2"), percent) & (F.array_min(F.array_intersect("keys", "keys2")) == F.col("key")))  # once for each pair
    return rare.union(met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))).distinct()


def colliding(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """The pairs that agree on enough coordinates."""
    sig = lambda k: classes.select(F.col("node").alias(k), F.col("sig").alias(f"sig_{k}"))
    both = pairs.join(sig("a"), "a").join(sig("b"), "b")
    agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return both.where(agree >= matches).select("a", "b")


def sets_of(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of some nodes; within the bound the nodes go to the sets, which are not exchanged then."""
    return sets.join(bounded(written(nodes.select("node").distinct(), "nodes")), "node", "left_semi")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs, a written table, whose full sets are similar."""
    some = sets_of(pairs.select(F.col("a").alias("node")).distinct().union(pairs.select("b").distinct()), sets)
    one = lambda k: some.select(F.col("node").alias(k), F.col("members").alias(f"set_{k}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", F.size("set_a").alias("x"), F.size("set_b").alias("y"), F.size(F.array_intersect("set_a", "set_b")).alias("i"))
    return both.where(100 * F.col("i").cast("long") >= percent * (F.col("x") + F.col("y") - F.col("i"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """A written table with node and label, the smallest node that links reach; nodes without a link are left out."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        hooked = labels.join(seen, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("_n"), F.col("label").alias("up"))
        jumped = written(hooked.join(up, F.col("label") == F.col("_n")).select("node", "old", F.least("label", "up").alias("label")), "labels")
        dropped(labels)
        labels = jumped
        if jumped.where("old <> label").isEmpty():
            dropped(both)
            return labels


def link(docs: DataFrame, classes: DataFrame, words: int, percent: int, matches: int) -> DataFrame:
    """node and label for every class that is linked with another.  ``docs``: doc_id, text; ``classes``: a written table."""
    lists = written(coordinate_lists(classes, matches), "coordinate-lists")
    # whole sets of the classes that meet another, each hashed once, from the document with the least id
    need = written(classes.join(lists.select("node").distinct(), "node", "left_semi").select("node", "doc_id", F.col("h1").alias("_1"), F.col("h2").alias("_2")), "listed-classes")
    ids = written(need.select(F.col("doc_id").alias("_id")).distinct(), "listed-ids")
    found = full_sets(docs.join(bounded(ids), F.col("doc_id") == F.col("_id"), "left_semi"), words)
    # a repeated id can bring texts of other classes
    found = found.join(bounded(need).drop("doc_id"), (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2"))).select("node", "members")
    sets = written(found, "full-sets")
    if not sets.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # a repeated row brings its class again
        sets = written(sets.dropDuplicates(["node"]), "full-sets")

    tried = written(colliding(pivot_pairs(lists, percent), classes, matches), "pivot-pairs")
    edges = written(confirmed(tried, sets, percent), "pivot-links")
    labels = components(edges).select("node", "label")
    mixed = written(labelled(lists, labels), "mixed-lists")
    short, long = mixed.where(F.col("size") <= LONG_LIST), mixed.where(F.col("size") > LONG_LIST)
    pairs = colliding(cross_pairs(short.withColumn("f", F.col("n")), percent).join(tried, ["a", "b"], "left_anti"), classes, matches)
    if not long.isEmpty():
        own = written(sets_of(long, sets), "long-list-sets")
        more = written(confirmed(written(minor_pairs(long, percent), "minor-pairs"), own, percent), "minor-links")
        edges = edges.unionByName(more)
        labels = components(edges).select("node", "label")
        pairs = pairs.union(long_list_pairs(labelled(long.select("key", "node", "n"), labels), labels, own, percent)).distinct()  # that have passed a stricter test
    rest = written(pairs.join(tried, ["a", "b"], "left_anti"), "cross-pairs")
    if not rest.isEmpty():
        labels = components(edges.unionByName(confirmed(rest, sets, percent)))
    dropped(lists, need, ids, sets, tried, mixed, rest)
    return labels


def _judged(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """_k1, _k2, doc_id, n_shingles, component_id and kept of each row, the one table that stays."""
    return alone(docs.sparkSession, "judged", lambda: _linked(docs, words, percent, id_col, text_col))


def _linked(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    own = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    own = own.select("doc_id", "text", *row_key(F.col("doc_id"), F.col("text")))
    identified = F.col("doc_id").isNotNull()
    marked = signed(own, words)
    marked = written(marked.withColumns({c: F.when(identified, F.col(c)) for c in ("h1", "h2")}), "signatures")
    classes = marked.where(F.col("h1").isNotNull()).groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("sig").alias("sig"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    labels = link(own, classes, words, percent, matches_for(percent))
    named = classes.select("node", "doc_id", F.col("h1").alias("_1"), F.col("h2").alias("_2")).join(labels, "node", "left").select("_1", "_2", F.col("doc_id").alias("first"), F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    known = named.join(least, "label").select("_1", "_2", "component_id")
    out = marked.drop("sig").join(known, (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("_k1", "_k2", "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach) and kept for each row of ``docs``."""
    return _judged(docs, words, percent, id_col, text_col).drop("_k1", "_k2")


def filter_documents(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id, every column as it was; of rows that repeat its id and text one stays.

    Rows without an id or a text all stay.  Only keys of rows that go, or come again, are joined with the texts.
    """
    key = (col(id_col).cast("long"), col(text_col).cast("string"))
    judged = _judged(docs, words, percent, id_col, text_col)
    same = judged.groupBy("_k1", "_k2").agg(F.any_value("kept").alias("kept"), F.count("*").alias("n"), F.max(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).alias("linked"))
    same = written(same.where(~F.col("kept") | (F.col("linked") & (F.col("n") > 1))), "rejected")
    out = without(docs, same, *key)
    again = written(same.where("kept").select("_k1", "_k2"), "repeated")
    if again.isEmpty():
        return out
    k1, k2 = row_key(*key)
    whole = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("_row"), k1, k2)
    return out.unionByName(whole.join(bounded(again), ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(F.first("_row").alias("_row")).select("_row.*"))


def op3_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)
