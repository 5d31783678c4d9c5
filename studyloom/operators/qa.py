"""Questions and answers from chunks: a deterministic generator, and a model client with the generator behind it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.functions.text import answers_from, sentences, snippet, source_chunk, topic

#: Difficulty and question around the topic.
TEMPLATES = (
    ("easy", "What is one key idea from ", "?"),
    ("medium", "How would you summarize this point about ", "?"),
    ("hard", "Why is this statement important in the context of ", "?"),
)
ITEM = "struct<question:string,answer:string,difficulty:string,topic:string>"


def _items(held_answers: str, held_topic: str) -> Column:
    rows = [
        F.struct(F.concat(F.lit(before), held_topic, F.lit(after)).alias("question"), F.element_at(held_answers, F.least(F.lit(k + 1), F.size(held_answers))).alias("answer"), F.lit(level).alias("difficulty"), F.col(held_topic).alias("topic"))
        for k, (level, before, after) in enumerate(TEMPLATES)
    ]
    return F.array(*rows)


def fallback_qa(chunks: DataFrame, text_col: str = "text", joined: bool = False) -> DataFrame:
    """Three rows for each chunk that isn't blank: question, answer, difficulty, topic and source_chunk in place of the text.

    ``joined`` says that texts are words with one blank between, as the chunk operator makes them.
    """
    others = [c for c in chunks.columns if c not in (text_col, "question", "answer", "difficulty", "topic", "source_chunk")]
    own = F.col(text_col)
    # the generators keep what they hold from being computed again by each use of it
    held = chunks.select(*others, source_chunk(own).alias("source_chunk"), F.inline(F.array(F.struct(sentences(own, joined).alias("_s"), snippet(own, joined).alias("_x"), topic(own).alias("_t")))))
    held = held.select(*others, "source_chunk", "_t", F.explode(F.array(answers_from(F.col("_s"), F.col("_x")))).alias("_a"))
    return held.where(F.size("_a") > 0).select(*others, "source_chunk", F.inline(_items("_a", "_t")))


def bracketed(output: Column) -> Column:
    """What stands between the first ``[`` and the last ``]``, both included; null where there is none."""
    # one start, at the first bracket, and one way back from the end: linear for any text
    return F.nullif(F.regexp_extract(output, r"(?s)\A[^\[]*+(\[.*\])", 1), F.lit(""))


def parse_items(output: Column) -> Column:
    """The items between the first ``[`` and the last ``]``, null where there are none or they can't be read."""
    found = F.from_json(bracketed(output), f"array<{ITEM}>")
    return F.when(F.size(found) > 0, found)


def template_place() -> Column:
    """The place of a generated question among its chunk's, by difficulty."""
    levels = F.array(*[F.lit(level) for level, *_ in TEMPLATES])
    return F.array_position(levels, F.col("difficulty")).cast("int") - 1


#: What an output can be: it has a list of items, a list of something else or none at all, no JSON, or no brackets.
SHAPES = ("items", "wrong shape", "malformed", "absent")


def with_shape(responses: DataFrame, output_col: str = "output") -> DataFrame:
    """Adds shape and n_items: an output read once as a variant, so that what is no JSON is told apart from JSON of another form.

    Items are objects of which every one has question, answer and difficulty as texts; an empty list is of a wrong shape.
    """
    parsed = responses.select("*", F.inline(F.array(F.struct(bracketed(F.col(output_col)).alias("_b"))))).select("*", F.explode(F.array(F.try_parse_json("_b"))).alias("_v"))
    items = F.try_variant_get("_v", "$", "array<variant>")
    field = lambda i, name: F.try_variant_get(i, f"$.{name}", "variant")
    text = lambda i, name: F.coalesce(F.schema_of_variant(field(i, name)) == "STRING", F.lit(False))
    good = (F.size(items) > 0) & F.forall(items, lambda i: text(i, "question") & text(i, "answer") & text(i, "difficulty"))
    shape = F.when(F.col("_b").isNull(), SHAPES[3]).when(F.col("_v").isNull(), SHAPES[2]).when(F.coalesce(good, F.lit(False)), SHAPES[0]).otherwise(SHAPES[1])
    own = parsed.select(*responses.columns, shape.alias("shape"), F.size(items).alias("_n"))
    return own.select(*responses.columns, "shape", F.when(F.col("shape") == SHAPES[0], F.col("_n")).otherwise(0).alias("n_items"))


def accepted(item: Column) -> Column:
    """An item that a table can hold: an object with question, answer and difficulty."""
    return item.isNotNull() & item["question"].isNotNull() & item["answer"].isNotNull() & item["difficulty"].isNotNull()


def from_responses(responses: DataFrame, text_col: str = "text", output_col: str = "output", fallback: bool = True, joined: bool = False) -> DataFrame:
    """Questions parsed from a model's output; with ``fallback``, chunks without a usable output get the generator's.

    Adds place, the item's place in its list, and rejected, true for items that a table could not hold.
    """
    # the generator keeps an output from being parsed again by each use of its items
    parsed = responses.drop("_items").select("*", F.explode(F.array(parse_items(F.col(output_col)))).alias("_items"))
    others = [c for c in responses.columns if c not in (text_col, output_col, "question", "answer", "difficulty", "topic", "source_chunk", "place")]
    good = parsed.where(F.col("_items").isNotNull()).select(*others, source_chunk(F.col(text_col)).alias("source_chunk"), F.posexplode("_items").alias("place", "_i"))
    good = good.select(*others, "source_chunk", "_i.question", "_i.answer", "_i.difficulty", "_i.topic", "place", (~accepted(F.col("_i"))).alias("rejected"))
    if not fallback:
        return good
    rest = fallback_qa(parsed.where(F.col("_items").isNull()).select(*others, text_col), text_col, joined)
    return good.unionByName(rest.withColumns({"place": template_place(), "rejected": F.lit(False)}))


def ask(chunks: DataFrame, client: Callable[[str], str | None], text_col: str = "text", output_col: str = "output") -> DataFrame:
    """Adds what an injected model client returns for each text; null where it raises or returns None."""

    @F.pandas_udf("string")
    def call(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else client(text)
            except Exception:  # noqa: BLE001 - a failed call means no output, as the generator takes over
                return None

        for series in texts:
            yield series.map(one)

    return chunks.withColumn(output_col, call(text_col))


def generate(chunks: DataFrame, client: Callable[[str], str | None] | None = None, text_col: str = "text", fallback: bool = True, placed: bool = False, joined: bool = False) -> DataFrame:
    """Questions by ``client``, or by the generator alone without one; ``placed`` adds place, a question's place in its chunk's list; ``joined`` as in :func:`fallback_qa`."""
    if client is None:
        own = fallback_qa(chunks, text_col, joined)
        return own.withColumn("place", template_place()) if placed else own
    made = from_responses(ask(chunks, client, text_col), text_col, fallback=fallback, joined=joined).where(~F.col("rejected")).drop("rejected")
    return made if placed else made.drop("place")


def compare_models(chunks: DataFrame, clients: Sequence[tuple[str, Callable[[str], str | None]]], order: Sequence[str], text_col: str = "text") -> DataFrame:
    """model, n_questions and sample (the first question, by the chunks' ``order`` and the place in the list), each client over the same chunks."""
    out = None
    for name, client in clients:
        made = from_responses(ask(chunks, client, text_col), text_col, fallback=False).where(~F.col("rejected"))
        own = made.groupBy().agg(F.count("*").alias("n_questions"), F.min_by("question", F.struct(*order, "place")).alias("sample")).select(F.lit(name).alias("model"), "n_questions", "sample")
        out = own if out is None else out.unionByName(own)
    return out


def embed(df: DataFrame, client: Callable[[list[str]], list[list[float]]], text_col: str = "text") -> DataFrame:
    """Adds embedding from an injected client that takes a batch of texts, each cut to 2000 characters."""
    from studyloom.functions.text import embedding_input

    @F.pandas_udf("array<float>")
    def call(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series(client(series.tolist()), index=series.index)

    return df.withColumn("embedding", call(embedding_input(F.col(text_col))))
