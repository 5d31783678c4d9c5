"""Best-fit packing of token sequences by minimum bin slack.

``tokenize_pieces`` turns each text into token pieces, ``pack`` places the pieces.  Packing needs only how many pieces
there are of each length, a table of at most ``max_tokens`` rows at any input size, so the search runs over that
histogram: a bitset subset-sum dynamic program finds the fullest bin that holds the longest piece left, and the
combination is taken as often as the counts allow.  Pieces then find their place by their rank among those of equal
length, which salted windows compute without gathering a length in one task.

Defined cases: a null text counts as empty (one end token); null ids are kept; repeated rows are packed each for
itself; an empty table gives an empty result; columns besides the named two are ignored.
"""

from __future__ import annotations

import dataclasses
import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studyloom.llm.shared import col, freed, written

#: Tokens in a sequence, and the id that ends a document.
MAX_TOKENS, END_ID = 2048, 0
#: Words that a worker remembers at most, and bytes of ids that it hands over at once, or one text's.
CACHE_WORDS, BATCH_BYTES = 700_000, 8 << 20
#: Bytes of texts whose words are looked up together, or one text's, and words whose ids are put in place at once.
GROUP_BYTES, GATHER_UNITS = 6 << 20, 1 << 16
#: Pieces for each salt of the ranking, about; a length with a third of all pieces has a third of that in a group.
RANK_ROWS = 10_000

#: Marks that may follow a word's letters and make one piece of their own.
_MARKS = ".,!?;:#$%&*()"
_WIDE = re.compile("[^\x00-\xff]")
_LOWER = {k: k + 32 for k in (*range(65, 91), *range(192, 215), *range(216, 223))}
_SPECIAL = "<|"


@dataclasses.dataclass
class Known:
    """Words, their ids one behind another, and how many each word has; as arrays, which take a fraction of a dictionary's memory."""

    words: pa.Array
    flat: np.ndarray
    sizes: np.ndarray

    def __len__(self) -> int:
        return len(self.words)


class WordTokenizer:
    """The tokenizer's ids of texts, as little-endian unsigned 32-bit bytes, by way of their distinct words.

    The vocabulary's pre-tokenizer never joins across a blank, and splits letters from marks, so a text's ids are those
    of its words, and a word of letters with marks behind it has the ids of the letters, then of the marks.  Letters up
    to U+00FF have one composed form and a lower case free of context.  All else goes to the tokenizer as it is.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocab = self.model.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, k in vocab.items():
            self.ends[k] = token.endswith("</w>")
        self.by_words = '"end_of_word_suffix":"</w>"' in self.model.to_str()
        self.limit = cache_words
        self.odd: dict[str, np.ndarray] = {}
        self.newer = self.older = Known(pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def direct(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def kept(self, word: str) -> np.ndarray:
        """As :meth:`direct`, remembered: marks, and words of more than letters."""
        ids = self.odd.get(word)
        if ids is None:
            if len(self.odd) >= self.limit:
                self.odd.clear()
            ids = self.odd[word] = self.direct(word)
        return ids

    def made(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokenizer's ids of distinct words of letters, one behind another, and how many each word has."""
        flat, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 2000):
            some = words.slice(i, 2000).to_pylist()
            own = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[own]) + 1
            if len(ends) == len(some):
                flat.append(own[: ends[-1]])
                sizes.append(np.diff(ends, prepend=0))
            else:
                each = [self.direct(w) for w in some]
                flat += each
                sizes.append(np.array([len(x) for x in each], dtype=np.int64))
        return np.concatenate(flat), np.concatenate(sizes)

    def letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words of letters and how many each word has; letters are in lower case already, as all of the text then is.

        What was made is remembered; where there is no room, what was not used since the last time there was none goes.
        """
        newer, older = self.newer, self.older
        at, aged = (pc.fill_null(pc.index_in(words, value_set=k.words), -1).to_numpy().astype(np.int64) for k in (newer, older))
        added = at < 0
        at[added] = np.where(aged[added] < 0, -1, aged[added] + len(newer))
        missing = at < 0
        at[missing] = len(newer) + len(older) + np.arange(missing.sum())
        own, counts = self.made(words.filter(pa.array(missing)))
        flat, sizes = np.concatenate([newer.flat, older.flat, own]), np.concatenate([newer.sizes, older.sizes, counts])
        if 2 * len(words) <= self.limit:
            if 2 * (len(newer) + added.sum()) > self.limit:
                self.older, self.newer = newer, Known(words, gathered(flat, sizes, at), sizes[at])
            elif added.any():
                self.newer = Known(pa.concat_arrays([newer.words, words.filter(pa.array(added))]), np.concatenate([newer.flat, gathered(flat, sizes, at[added])]), np.concatenate([newer.sizes, sizes[at[added]]]))
        return gathered(flat, sizes, at), sizes[at]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one behind another, and how many each word has."""
        stems = pc.utf8_rtrim(words, characters=_MARKS)
        plain = pc.and_(pc.utf8_is_alpha(stems), pc.invert(pc.match_substring_regex(stems, r"[^\x00-\x{ff}]"))).to_numpy(zero_copy_only=False)
        coded = stems.filter(pa.array(plain)).dictionary_encode()
        flat, sizes = self.letters(coded.dictionary)
        n = len(sizes)
        marked = plain & pc.not_equal(pc.binary_length(stems), pc.binary_length(words)).to_numpy(zero_copy_only=False)
        marks = [w[k:] for w, k in zip(words.filter(pa.array(marked)).to_pylist(), pc.utf8_length(stems.filter(pa.array(marked))).to_pylist(), strict=True)]
        others = words.filter(pa.array(~plain)).to_pylist()
        more = {w: n + 1 + k for k, w in enumerate({*marks, *others})}  # n stands for nothing
        ids = [self.kept(w) for w in more]
        flat, sizes = np.concatenate([flat, *ids]), np.concatenate([sizes, [0], [len(x) for x in ids]]).astype(np.int64)
        units = np.full((len(words), 2), n, dtype=np.int64)  # letters, or the whole word, and marks
        units[plain, 0] = coded.indices.to_numpy()
        units[~plain, 0] = [more[w] for w in others]
        units[marked, 1] = [more[w] for w in marks]
        return gathered(flat, sizes, units.ravel()), sizes[units].sum(axis=1)

    def many(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; the tokenizer sees a word of them once, however often it stands there."""
        pa.default_memory_pool().release_unused()  # what the texts before took
        by_words = [self.by_words and _SPECIAL not in t for t in texts]
        split = pc.split_pattern(pa.array([lowered(t) for t, k in zip(texts, by_words, strict=True) if k], pa.large_string()), " ")
        coded, ends = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        flat, sizes = self.words(coded.dictionary)
        places = coded.indices.to_numpy()
        ids = gathered(flat, sizes, places)
        ends = np.concatenate([[0], np.cumsum(sizes[places])])[ends].tolist()
        k = 0
        for text, found in zip(texts, by_words, strict=True):
            yield ids[ends[k] : ends[k + 1]].tobytes() if found else self.direct(text).tobytes()
            k += found

    def __call__(self, text: str) -> bytes:
        return next(self.many([text]))


def lowered(text: str) -> str:
    """A text in lower case with blanks for its line ends; a capital in a wide text is not lowered here, as one letter's lower case depends on its neighbours."""
    return (text.lower() if text.isascii() or not _WIDE.search(text) else text.translate(_LOWER)).replace("\n", " ")


def gathered(flat: np.ndarray, sizes: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The numbers of units one behind another; ``flat`` holds those of all units, ``sizes`` of them for each."""
    starts, out = np.cumsum(sizes) - sizes, [flat[:0]]
    for i in range(0, len(units), GATHER_UNITS):
        own = units[i : i + GATHER_UNITS]
        n = sizes[own]
        out.append(flat[np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())])
    return np.concatenate(out)


def groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of rows whose texts, the second column, have about ``GROUP_BYTES``; a longer text stands alone or ends one."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // GROUP_BYTES
    ends = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(ends, ends[1:], strict=False) if a < b)


@functools.cache
def tokenizer_of_worker(path: str) -> WordTokenizer:
    """One for all tasks that a Python worker runs."""
    return WordTokenizer(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize_pieces(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and with ``with_ids`` the ids themselves, an array of numbers."""
    path = tokenizer or default_tokenizer()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer_of_worker(path), np.array([end_id], dtype="<u4").tobytes()

        def made(rows: list[tuple], held: list[bytes]) -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            if with_ids:
                at = np.cumsum([0, *[r[3] for r in rows]])
                columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(held), "<i4"))))
            return pa.RecordBatch.from_arrays(columns, names=[*names, *["ids"] * with_ids])

        for batch in batches:
            rows, held, size = [], [], 0
            own = ((own.column(0).to_pylist(), encode.many([t or "" for t in own.column(1).to_pylist()])) for own in groups(batch))
            for doc, text_ids in (pair for docs, ids in own for pair in zip(docs, ids, strict=True)):
                ids = text_ids + end
                for piece, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    own = ids[at : at + 4 * max_tokens]
                    rows.append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own)))
                    if with_ids:
                        held.append(own)
                        size += len(own)
                if size >= BATCH_BYTES:
                    yield made(rows, held)
                    rows, held, size = [], [], 0
            if rows:
                yield made(rows, held)

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")).mapInArrow(freed(run), schema)


def fullest_bin(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The fullest combination with the longest length left, as (length, uses); of equal ones that with longer pieces."""
    longest = max(counts)
    room = capacity - longest
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for size in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[size] - (size == longest), room // size), 1
        while left > 0 and not reach >> room & 1:
            take = min(k, left)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            left, k = left - take, 2 * k
        if reach >> room & 1:
            break
    fill, used = reach.bit_length() - 1, {longest: 1}
    for size, take, before in reversed(steps):
        if not before >> fill & 1:
            fill -= size * take
            used[size] = used.get(size, 0) + take
    return sorted(used.items(), reverse=True)


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """(combination, number of bins) until no piece is left."""
    counts, plan = {k: v for k, v in histogram.items() if v > 0}, []
    while counts:
        used = fullest_bin(counts, capacity)
        times = min(counts[size] // n for size, n in used)
        plan.append((used, times))
        for size, n in used:
            counts[size] -= n * times
            if not counts[size]:
                del counts[size]
    return plan


def placements(plan: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, uses in a bin, offset of the first use) for each length of each combination."""
    rows, ranks, first = [], {}, 0
    for used, times in plan:
        offset = 0
        for size, n in used:
            low = ranks.get(size, 0)
            rows.append((size, low, low + n * times, first, n, offset))
            ranks[size] = low + n * times
            offset += n * size
        first += times
    return rows


def numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` as a written table with _row, fixed when it is written."""
    return written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")


def with_salt(pieces: DataFrame, salts: int) -> DataFrame:
    """Adds _salt, the part of its length in which a piece is ranked."""
    return pieces.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to pieces with doc_id, piece, start and length (1 to ``max_tokens``).

    ``pieces`` is a written table with _row, a number of its own for each row (:func:`numbered`): rows that are alike, or
    share an id, are ranked in as many tasks as other ones.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # max_tokens rows at most
    if any(not 1 <= k <= max_tokens for k in histogram):
        raise ValueError("piece lengths must lie between 1 and max_tokens")
    rows = placements(minimum_bin_slack(histogram, max_tokens))
    schema = "length long, rank_from long, rank_to long, first_sequence long, uses long, base_offset long"
    places = spark.createDataFrame(rows, schema)
    salts = max(1, sum(histogram.values()) // RANK_ROWS)
    salted = with_salt(pieces, salts)
    cells = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = cells.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row"))
    ranked = salted.withColumn("_own", own.cast("long")).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_own") - 1)
    # a few lengths for each of at most some thousand combinations, whatever the input
    placed = ranked.join(F.broadcast(places), "length").where((F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to")))
    nth = F.col("_rank") - F.col("rank_from")
    return placed.select(
        *[c for c in pieces.columns if c != "_row"],
        (F.col("first_sequence") + F.floor(nth / F.col("uses")).cast("long")).alias("sequence_id"),
        (F.col("base_offset") + F.pmod(nth, F.col("uses")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenizes, cuts what is longer than a sequence, and packs."""
    return pack(numbered(tokenize_pieces(docs, tokenizer, max_tokens, end_id, id_col, text_col, with_ids)), max_tokens)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
