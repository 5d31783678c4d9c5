"""JSON, CSV and Markdown output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the columns of the CSV export.
CSV_COLUMNS = ("question", "answer", "difficulty", "topic")


def results_json(metadata: DataFrame, chunks: DataFrame, qa_pairs: DataFrame, key: str) -> DataFrame:
    """key and json: metadata, chunks and qa_pairs of each text as one document; characters beyond ASCII stay."""
    c = chunks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("chunk_id", *[x for x in chunks.columns if x not in (key, "chunk_id")]))).alias("chunks"))
    q = qa_pairs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("chunk_id", *[x for x in qa_pairs.columns if x not in (key, "chunk_id")]))).alias("qa_pairs"))
    own = metadata.select(key, F.struct(*[x for x in metadata.columns if x != key]).alias("metadata")).join(c, key, "left").join(q, key, "left")
    none = lambda name, df: F.coalesce(name, F.array().cast(df.schema[name].dataType))
    return own.select(key, F.to_json(F.struct("metadata", none("chunks", c).alias("chunks"), none("qa_pairs", q).alias("qa_pairs")), {"pretty": "true"}).alias("json"))


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_csv(qa_pairs: DataFrame, path: str) -> None:
    """The four columns with a header, quotes doubled."""
    qa_pairs.select(*CSV_COLUMNS).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", False).csv(path)


def markdown(numbered: DataFrame) -> DataFrame:
    """number and section for rows with number, question, answer, difficulty and topic."""
    text = F.format_string("## %d. %s\n\n**Answer:** %s\n\n**Difficulty:** %s | **Topic:** %s\n\n---\n\n", "number", "question", "answer", "difficulty", "topic")
    return numbered.select("number", text.alias("section"))


def save_markdown(numbered: DataFrame, path: str) -> None:
    """Sections in order behind the title, as text files; their names sort as their sections do."""
    spark = numbered.sparkSession
    title = spark.createDataFrame([(0, "# Generated Q&A Pairs\n\n")], "number int, section string")
    sections = title.unionByName(markdown(numbered)).orderBy("number").select(F.regexp_replace("section", r"\n\z", ""))
    sections.write.mode("overwrite").text(path)
