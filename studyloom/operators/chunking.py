"""Overlapping word chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.functions.text import words

#: Words in a chunk, words shared with the next, words of a title.
SIZE, OVERLAP, TITLE_WORDS = 500, 100, 8


def chunk(df: DataFrame, text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP, cleaned: bool = False, outer: bool = False) -> DataFrame:
    """A row for each chunk, with chunk_id (from 1), text, title and word_count in place of the text column.

    Windows start every ``size - overlap`` words while a word is left, also where the last lies within the one before.
    Null and blank texts give no row, or with ``outer`` one whose chunk_id is null.  ``cleaned`` says that texts hold no
    white space but blanks.
    """
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size is needed")
    own = F.col(text_col)
    others = [c for c in df.columns if c not in (text_col, "chunk_id", "title", "word_count")]
    # the generator keeps the split from being repeated for each chunk; a test of the text itself would clean it once more
    held = df.select(*others, F.explode(F.array(words(own, cleaned))).alias("_w"))
    some, explode = F.size("_w") > 0, F.explode_outer if outer else F.explode
    held = held if outer else held.where(some)
    each = held.select(*others, "_w", explode(F.when(some, F.sequence(F.lit(0), F.size("_w") - 1, F.lit(size - overlap)))).alias("_at"))
    part = each.select(*others, (F.floor(F.col("_at") / (size - overlap)) + 1).cast("int").alias("chunk_id"), F.slice("_w", F.col("_at") + 1, size).alias("_p"))
    return part.select(*others, "chunk_id", F.array_join("_p", " ").alias(text_col), F.array_join(F.slice("_p", 1, TITLE_WORDS), " ").alias("title"), F.size("_p").alias("word_count"))


def first_chunks(chunks: DataFrame, n: int) -> DataFrame:
    """Chunks 1 to ``n`` of each text."""
    return chunks.where(F.col("chunk_id") <= n)
