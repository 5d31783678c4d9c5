"""Line deduplication by levelled, sorted runs of line hashes.

A run is a table of line hashes (128 bits) with the number of documents that hold the line, bucketed and sorted by the
hash.  Documents arrive in batches.  A batch's hashes are counted in one shuffle, merge-anti-joined with the runs, so that
lines known to be common are not stored again, and written as a run of level 0.  As soon as two runs share a level they
are merged into one of the next, so a batch meets a logarithmic number of runs.  Runs share their buckets: anti-joins and
merges exchange nothing.  A line is common when its counts over all runs reach the threshold; only then are texts read
again, and lines that are common leave every document.

DataFrame functions only.  Common lines are broadcast (fixed-size rows) up to ``shared.BROADCAST_ROWS``, which is checked,
and joined by shuffle beyond; a frequent line is counted on the map side first.  Runs and tables are written to the shared
folder, so a lost executor costs its tasks.

Defined cases: each row of ``docs`` is a document, also one that repeats another; a null text is an empty one, which has
one empty line; keys shorter than ``min_length`` are never dropped, so blank lines stay; a line that repeats within one
document counts once; a document that loses all lines keeps an empty text; an empty table gives an empty result; other
columns are ignored, or kept by ``filter_documents``.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm.shared import ascii_lower, barrier, bounded, col, new_folder, row_key, written
from studyloom.sources.storage import removed

#: Documents that make a line common, and code points that its key needs.
MIN_DOCS, MIN_LENGTH = 10, 1
#: Batches in which the files of a table arrive.
BATCHES = 4
_SPACE = " \t\n\x0b\x0c\r"
_HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def key_of(line: Column) -> Column:
    """What makes two lines equal: ends stripped of ASCII white space, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(_SPACE)))


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(k), key).alias(h) for k, h in enumerate(_HASH, 1)]


def document_counts(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """h1, h2 and n: the documents that hold each line; a document's own repeats are dropped before anything is exchanged."""
    keys = F.array_distinct(F.transform(lines_of(col(text_col)), key_of))
    each = docs.select(F.explode(keys).alias("key")).where(F.char_length("key") >= min_length)
    return each.select(*hashes(F.col("key"))).groupBy(*_HASH).agg(F.count("*").alias("n"))


class LineRuns:
    """Levelled runs of line hashes; each has (level, table name, path)."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH, buckets: int | None = None) -> None:
        self.spark, self.min_docs, self.min_length = spark, min_docs, min_length
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str, str]] = []

    def _written(self, counts: DataFrame, level: int) -> None:
        name, path = f"studyloom_run_{uuid.uuid4().hex}", new_folder(self.spark, f"line-run-{level}")
        counts.select(*_HASH, "n").write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", path).saveAsTable(name)
        self.runs.append((level, name, path))

    def add(self, docs: DataFrame, text_col: str = "text") -> None:
        """A batch: its lines that no run knows as common become a run, then full levels are merged."""
        new = document_counts(docs, text_col, self.min_length)
        for _, name, _ in self.runs:
            known = self.spark.table(name).where(F.col("n") >= self.min_docs)
            new = new.join(known.hint("merge"), _HASH, "left_anti")
        self._written(new, 0)
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            self._compact(2)

    def _merged(self, last: int) -> DataFrame:
        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.withColumnRenamed("n", "_n").hint("merge")
            zero = F.lit(0).cast("long")
            return a.join(b, _HASH, "full_outer").select(*_HASH, (F.coalesce("n", zero) + F.coalesce("_n", zero)).alias("n"))

        return reduce(both, [self.spark.table(name) for _, name, _ in self.runs[-last:]])

    def _compact(self, last: int) -> None:
        """The last runs become one of the next level."""
        merged, old = self._merged(last), self.runs[-last:]
        self._written(merged, max(level for level, _, _ in old) + 1)
        self.runs = [*self.runs[: -last - 1], self.runs[-1]]
        self._drop(old)

    def common(self) -> DataFrame:
        """h1 and h2 of the lines in at least ``min_docs`` documents so far, as a written table."""
        if not self.runs:
            return written(self.spark.createDataFrame([], "h1 long, h2 long"), "common-lines")
        return written(self._merged(len(self.runs)).where(F.col("n") >= self.min_docs).select(*_HASH), "common-lines")

    def _drop(self, runs: list[tuple[int, str, str]]) -> None:
        for _, name, _ in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(self.spark, [path for _, _, path in runs])

    def close(self) -> None:
        """Deletes all runs."""
        self._drop(self.runs)
        self.runs = []


def without_lines(docs: DataFrame, common: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """row (a struct of all columns of ``docs``), n_lines, n_dropped and kept, the text without its common lines.

    ``common``: a written table of h1 and h2.  Only the places of common lines are gathered by document, by a key over id
    and text, which is the same for repeated rows; texts are joined with them once.
    """
    keyed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), *row_key(col(id_col), col(text_col)))
    each = docs.select(*row_key(col(id_col), col(text_col)), F.posexplode(lines_of(col(text_col))).alias("at", "line"))
    each = each.select("_k1", "_k2", "at", key_of(F.col("line")).alias("key")).where(F.char_length("key") >= min_length)
    met = each.select("_k1", "_k2", "at", *hashes(F.col("key"))).join(bounded(common), _HASH, "left_semi")
    places = met.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set("at")).alias("gone"))  # a document's lines at most
    lines = lines_of(F.col("row").getField(text_col))
    made = barrier(keyed.join(places, ["_k1", "_k2"], "left").select("row", "gone"), lines=lines)

    def between(j: Column) -> Column:
        """The lines between the j-th place that goes and the one before."""
        first = F.when(j == 0, 0).otherwise(F.get("gone", j - 1) + 1)
        last = F.when(j == F.size("gone"), F.size("lines")).otherwise(F.get("gone", j))
        return F.slice("lines", first + 1, last - first)

    stay = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), between)))
    n_dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return made.select("row", F.size("lines").cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), F.array_join(stay, "\n").alias("kept"))


def common_lines(batches: list[DataFrame], text_col: str = "text", min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH) -> DataFrame:
    """A written table of the hashes of lines that at least ``min_docs`` documents of all ``batches`` hold."""
    runs = LineRuns(batches[0].sparkSession, min_docs, min_length)
    for batch in batches:
        runs.add(batch, text_col)
    found = runs.common()
    runs.close()
    return found


def batches_of(docs: DataFrame, batches: int = BATCHES) -> list[DataFrame]:
    """``docs``, as read from Parquet files, by shares of its files; a table of fewer files has fewer batches."""
    files = sorted(docs.inputFiles())
    if len(files) < 2:
        return [docs]
    step = -(-len(files) // batches)
    read = docs.sparkSession.read.schema(docs.schema)
    return [read.parquet(*files[k : k + step]) for k in range(0, len(files), step)]


def filter_documents(docs: DataFrame, batches: list[DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs``, every column as it was, without common lines in its texts."""
    common = common_lines(batches or [docs], text_col, min_docs, min_length)
    own = without_lines(docs, common, id_col, text_col, min_length)
    return own.select(*[F.col("kept").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def op11_levelled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    own = without_lines(docs, common_lines(batches_of(docs)))
    return own.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
