"""Text out of files: TXT, DOCX and PDF, from a folder or an upload area.

Files are read by Spark, so any store it knows will do, or by tasks from the parts that tasks wrote.  Each is parsed on
its own: what goes wrong with one becomes its error, and the others go on.
"""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.functions.formats import safe_file_name
from studyloom.sources.pdf import pdf_pages

#: Fixed value: what stands before each page.
PAGE = "\n\n--- PAGE {} ---\n\n"
FORMATS = ("pdf", "txt", "docx")
#: Files of a part, of which a task lists one at a time.
PART_FILES = 5000
#: Characters of texts that a task hands over at once, or one text's.
HELD_CHARS = 4_000_000
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def join_pages(pages: DataFrame, by: list[str]) -> DataFrame:
    """One text for each file from rows with page_no and text, each page behind its separator."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))), lambda p: F.concat(F.lit("\n\n--- PAGE "), p["page_no"].cast("string"), F.lit(" ---\n\n"), p["text"]))
    return pages.groupBy(*by).agg(F.array_join(parts, "").alias("text"))


def docx_text(data: bytes) -> str:
    """Paragraph texts, joined by newlines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = root.find(f"{_W}body")
    paragraphs = body.findall(f"{_W}p") if body is not None else []
    return "\n".join("".join({f"{_W}t": n.text or "", f"{_W}tab": "\t", f"{_W}br": "\n"}.get(n.tag, "") for n in p.iter()) for p in paragraphs)


def docx_bytes(text: str) -> bytes:
    """A Word file of the text's lines as paragraphs, the inverse of :func:`docx_text` for texts that XML can hold."""
    paragraphs = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{paragraphs}</w:body></w:document>')
    return out.getvalue()


def pdf_text(data: bytes, pages: Callable[[bytes], list[str]] = pdf_pages) -> str:
    return "".join(PAGE.format(k) + text for k, text in enumerate(pages(data), 1))


def parsed(data: bytes | None, form: str | None, strict: bool, pdf: Callable[[bytes], list[str]]) -> tuple[str, str | None]:
    """The text of one file and its error; see :func:`extracted`."""
    if data is None:
        return "", "no content"
    try:
        if form == "pdf":
            return pdf_text(bytes(data), pdf), None
        if strict or form == "txt":
            return bytes(data).decode("utf-8").replace("\r\n", "\n").replace("\r", "\n"), None
        if form == "docx":
            return docx_text(bytes(data)), None
        return "", f"unsupported format: {form}"
    except Exception as e:  # noqa: BLE001 - one bad file must not end the job
        return "", f"{type(e).__name__}: {e}"


def _stretches(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows that begin with a text, in lists of about ``HELD_CHARS`` characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0])
        if size >= HELD_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def extracted(files: DataFrame, kind: Column, strict: bool = False, pdf: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """Adds text and error to rows with content (binary); ``kind`` names the format.

    Unknown formats and failures have an empty text; with ``strict`` all but PDF is read as UTF-8, and bytes that aren't
    UTF-8 are an error.
    """

    @F.pandas_udf("text string, error string")
    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for data, form in batches:
            for rows in _stretches(parsed(d, f, strict, pdf) for d, f in zip(data, form, strict=True)):
                yield pd.DataFrame(rows, columns=["text", "error"])

    return files.withColumn("_x", parse("content", kind)).withColumns({"text": F.col("_x.text"), "error": F.col("_x.error")}).drop("_x", "content")


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.*", strict: bool = False, pdf: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """path, n_bytes, text and error of each file of a folder (not below it) whose name fits; none if the folder is missing.

    Spark lists the files on the driver; where they are too many for it, :func:`read_parts` lists in tasks.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string, n_bytes long, text string, error string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)
    rows = files.select("path", F.col("length").alias("n_bytes"), "content")
    return extracted(rows, suffix_of(F.col("path")), strict, pdf)


def parts_for(files: int, cores: int) -> int:
    """Into how many parts so many files go: enough for all cores, and ``PART_FILES`` files in each at most, or about so."""
    return max(-(-files // PART_FILES), 4 * cores)


def read_parts(spark: SparkSession, folder: str, suffix: str, strict: bool = False, pdf: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """As :func:`read_folder`, for files of one suffix that :func:`save_files` dealt into parts.

    The driver lists the parts only, and each task the files of one part, so what the driver holds doesn't grow with the
    files.  Tasks read as they wrote, from stores that Arrow knows.
    """
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(_uri(folder))
    parts = sorted(x.base_name for x in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.type == fs.FileType.Directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(_uri(folder))

        def rows(part: str) -> Iterator[tuple]:
            for x in system.get_file_info(fs.FileSelector(f"{base}/{part}")):
                name = x.base_name
                if x.type == fs.FileType.File and name.endswith(suffix) and not name.startswith(("_", ".")):
                    with system.open_input_stream(x.path) as f:
                        data = f.read()
                    yield *parsed(data, name.rpartition(".")[2].lower(), strict, pdf), f"{folder}/{part}/{name}", len(data)

        for batch in batches:
            for k in batch.column(0).to_pylist():
                for held in _stretches(rows(parts[k])):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["text", "error", "path", "n_bytes"])

    read = spark.range(0, len(parts), 1, max(len(parts), 1)).mapInArrow(run, "text string, error string, path string, n_bytes long")
    return read.select("path", "n_bytes", "text", "error")


#: What the binary reader gives.
_FILES = "path string, modificationTime timestamp, length long, content binary"


def follow_folder(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str = "*.*", strict: bool = False, pdf: Callable[[bytes], list[str]] = pdf_pages) -> None:
    """Parses the files that came into a folder since the last run on this checkpoint, each once, and ends.

    A batch is written in one pass to a partition of ``out`` of its own, which is written over if the batch comes again:
    files with a text and those with an error apart (see :func:`followed`).
    """

    def keep(rows: DataFrame, batch: int) -> None:
        read = extracted(rows.select("path", F.col("length").alias("n_bytes"), "content"), suffix_of(F.col("path")), strict, pdf)
        read.withColumn("failed", F.col("error").isNotNull()).write.mode("overwrite").partitionBy("failed").parquet(f"{out}/batch={batch}")

    source = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", pattern).load(folder)
    source.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def followed(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(path, n_bytes and text of the files that could be read, path, n_bytes and error of those that could not)."""
    rows = spark.read.schema("path string, n_bytes long, text string, error string, batch long, failed boolean").parquet(out)
    return rows.where(~F.col("failed")).select("path", "n_bytes", "text"), rows.where("failed").select("path", "n_bytes", "error")


def _uri(folder: str) -> str:
    return folder if ":" in folder else f"file://{folder}"


def save_files(files: DataFrame, folder: str, made: Callable[..., bytes] | None = None, parts: int = 0) -> None:
    """Writes rows of file (a name) and content (bytes) as one file each, into a folder that executors share.

    With ``made`` the content is what it makes of the row's other values.  Tasks write; each file comes under its name only
    when it is whole, and a task that runs again writes the same.  A task holds one file's content beside the rows it is given.
    With ``parts`` files go into so many folders below, by a hash of their names (see :func:`read_parts`).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(_uri(folder))
        system.create_dir(base, recursive=True)
        there = {base}
        for batch in batches:
            for name, *rest in zip(*batch.columns, strict=True):
                own, name = [x.as_py() for x in rest], name.as_py()
                to = f"{base}/{zlib.crc32(name.encode()) % parts:06d}" if parts else base
                if to not in there:
                    system.create_dir(to, recursive=True)
                    there.add(to)
                part = f"{to}/_{name}.{uuid.uuid4().hex}"  # readers leave such names out
                with system.open_output_stream(part) as out:
                    out.write((made(*own) if made else own[0]) or b"")
                system.move(part, f"{to}/{name}")
            yield batch.select([0])

    rest = [c for c in files.columns if c != "file"] if made else ["content"]
    files.select(safe_file_name(F.col("file")).alias("file"), *rest).mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()


def save_texts(texts: DataFrame, folder: str) -> None:
    """As :func:`save_files`, for rows of file and value, a text."""
    save_files(texts.select("file", F.encode("value", "UTF-8").alias("content")), folder)


def save_uploads(uploads: DataFrame, root: str) -> DataFrame:
    """Appends rows of instance_id, file_name (made safe), content and version to the landing table at ``root``.

    The table is partitioned by instance.  Nothing is overwritten in place, so a failed write loses nothing;
    :func:`stored_files` reads the newest version of each name.  ``uploads`` brings version, a number that grows.
    """
    own = uploads.select("instance_id", safe_file_name(F.col("file_name")).alias("file_name"), "content", "version")
    own.write.mode("append").partitionBy("instance_id").parquet(root)
    return own.select("instance_id", "file_name", F.concat_ws("/", F.lit(root.rstrip("/")), F.col("instance_id").cast("string"), "file_name").alias("file_path"))


def stored_files(spark: SparkSession, root: str) -> DataFrame:
    """instance_id, file_name and content, the newest version of each name."""
    files = spark.read.parquet(root)
    newest = files.groupBy("instance_id", "file_name").agg(F.max("version").alias("version"))
    return files.join(newest, ["instance_id", "file_name", "version"], "left_semi").drop("version").dropDuplicates(["instance_id", "file_name"])
