"""Whole flows: from files to questions and cards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from studyloom.functions.text import blank, full_clean, light_clean
from studyloom.operators.cards import new_cards, without_pairs
from studyloom.operators.chunking import chunk
from studyloom.operators.crud import with_new_ids
from studyloom.operators.qa import generate
from studyloom.sources.storage import dropped, written


def questions(files: DataFrame, key: list[str], client: Callable[[str], str | None] | None = None, text_col: str = "text", placed: bool = False) -> DataFrame:
    """Files of extracted text: clean lightly, cut into chunks, generate; blank files give nothing.  ``placed``: as in :func:`qa.generate`."""
    own = files.select(*key, light_clean(F.col(text_col)).alias("text"))
    return generate(chunk(own, cleaned=True), client, placed=placed, joined=True)


#: What an upload says.
NO_TEXT = "No text could be extracted from the file"
DONE = "Document processed successfully. Generated %d Q&A pairs and %d flashcards."
NO_PAIRS = "Document uploaded, but no Q&A pairs were generated. Check that Ollama is running and the configured model is available."


def upload(files: DataFrame, cards: DataFrame, now: Column | None = None, first_pair_id: int = 1, client: Callable[[str], str | None] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(qa_pairs, new flashcards, stats) for files of id, instance_id and text.

    stats has the numbers of pairs, chunks and new flashcards, a message and a warning for each file; of equal questions
    the first makes the card, by file, chunk and place in the chunk's list.
    """
    made = questions(files.select("id", "instance_id", "text"), ["id", "instance_id"], client, placed=True)
    pairs = with_new_ids(made.withColumnRenamed("id", "document_id"), ["document_id", "chunk_id", "place"], first_pair_id)
    pairs = pairs.select("id", "instance_id", "document_id", "chunk_id", "question", "answer", "difficulty", "topic", "source_chunk")
    fresh = new_cards(pairs, cards, now)
    return pairs, fresh, upload_report(files, cards, pairs)


def upload_report(files: DataFrame, cards: DataFrame, pairs: DataFrame) -> DataFrame:
    """The stats of :func:`upload` from instance_id, document_id, chunk_id and question of the pairs, a written table as it is read twice.

    Ids follow the files' order, so the first of equal questions is one of the lowest document, and no id is needed here.
    """
    first = pairs.groupBy("instance_id", "question").agg(F.min("document_id").alias("document_id"))
    made_cards = first.join(cards.select("instance_id", "question"), ["instance_id", "question"], "left_anti").groupBy(F.col("document_id").alias("_d")).agg(F.count("*").alias("flashcards"))
    counts = pairs.groupBy("document_id", "chunk_id").agg(F.count("*").alias("_n")).groupBy("document_id").agg(F.sum("_n").alias("qa_pairs"), F.count("chunk_id").alias("chunks"))
    zero = F.lit(0).cast("long")
    number = lambda c: F.coalesce(c, zero)
    return files.select("id", blank(F.col("text")).alias("blank")).join(counts, F.col("id") == F.col("document_id"), "left").join(made_cards, F.col("id") == F.col("_d"), "left").select(
        "id",
        *[number(c).alias(c) for c in ("qa_pairs", "flashcards", "chunks")],
        F.when(F.col("blank"), NO_TEXT).otherwise(F.format_string(DONE, number("qa_pairs"), number("flashcards"))).alias("message"),
        F.when(~F.col("blank") & F.col("qa_pairs").isNull(), NO_PAIRS).alias("warning"),
    )


def bootstrap(documents: DataFrame, texts: DataFrame, qa_pairs: DataFrame, client: Callable[[str], str | None] | None = None) -> DataFrame:
    """Questions for instances without pairs, from each path's first document; ``texts``: file_path and text."""
    need = without_pairs(documents, qa_pairs)
    return questions(need.join(texts, "file_path"), ["instance_id", "id"], client)


#: Columns of a file's metadata.
META = ("path", "error", "file_size_chars", "cleaned_size_chars")


def batch_chunks(files: DataFrame) -> DataFrame:
    """META and the chunks of files (path, text and error), a row each, or one row with a null chunk_id; a text is cleaned once."""
    failed = F.coalesce("error", F.when(blank(F.col("text")), F.lit("Failed to extract text")))
    own = files.select("path", "text", F.explode(F.array(failed)).alias("error"))
    ok = F.col("error").isNull()
    own = own.select("path", "error", F.when(ok, F.char_length("text")).alias("file_size_chars"), F.explode(F.array(F.when(ok, full_clean(F.col("text"))))).alias("text"))
    return chunk(own.withColumn("cleaned_size_chars", F.char_length("text")), cleaned=True, outer=True)


def batch(files: DataFrame, generated_at: str, model: str = "llama3:8b", client: Callable[[str], str | None] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metadata, chunks, qa_pairs) for files of path, text and error, cleaned fully; failed files have metadata with an error only.

    Chunks and pairs are written as they are made, so texts are read once, whichever of the three are used; metadata counts
    what was written.
    """
    held = written(batch_chunks(files), "batch-chunks")
    chunks = held.where(F.col("chunk_id").isNotNull()).drop(*META[1:])
    pairs = written(generate(chunks.withColumnRenamed("title", "chunk_title"), client, fallback=client is None, joined=True), "batch-pairs")
    counted = pairs.groupBy("path").agg(F.count("*").alias("qa_count"))
    meta = held.groupBy(*META).agg(F.count("chunk_id").alias("chunk_count")).join(counted, "path", "left")
    zero = F.lit(0).cast("long")
    return meta.select(*META, "chunk_count", F.coalesce("qa_count", zero).alias("qa_count"), F.lit(model).alias("model"), F.lit(generated_at).alias("generated_at")), chunks, pairs


def batch_totals(files: DataFrame, client: Callable[[str], str | None] | None = None) -> dict[str, int]:
    """What :func:`analytics.batch_summary` counts, by observing rows while chunks and pairs are written; nothing is read for the counts."""
    ok, first = F.col("error").isNull(), F.coalesce("chunk_id", F.lit(1)) == 1
    seen, made = Observation("batch chunks"), Observation("batch pairs")
    counts = [F.count_if(first).alias("total_files"), F.count_if(first & ok).alias("successful"), F.count_if(first & ~ok).alias("failed"), F.count("chunk_id").alias("total_chunks")]
    held = written(batch_chunks(files).observe(seen, *counts), "batch-chunks")
    chunks = held.where(F.col("chunk_id").isNotNull()).drop(*META[1:])
    pairs = written(generate(chunks, client, fallback=client is None, joined=True).observe(made, F.count("*").alias("total_qa")), "batch-pairs")
    totals = seen.get | made.get
    dropped(held, pairs)
    return totals
