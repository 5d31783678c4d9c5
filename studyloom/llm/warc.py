"""WARC archives whose records are compressed one by one with a dictionary that the archive itself carries.

An archive (``.warc.zst``) starts with a skippable frame, magic 0x184D2A5D, whose content is a Zstandard dictionary
built from records of that very archive; then comes one frame for each record, so any record can be read alone.  The
dictionary is trained on records taken at even steps through the whole archive, as many as ``SAMPLE_BYTES`` hold.

Tasks write archives straight into the shared folder under names that no other attempt uses, and report them as rows;
Spark commits the rows of successful attempts only.  That list is the manifest, and readers open nothing else, so a
lost executor or a second attempt leaves no record missing or twice.  Memory is bounded by ``ARCHIVE_BYTES`` and one
record.  Readers are dealt by the bytes that the manifest states.

Defined cases: a null payload is empty; a null or unusable url becomes ``urn:page:<id>``; a null id is written without
an id field and read back as null; of repeated rows with the largest id each is a response; an empty table gives an
empty manifest and no record; columns besides the named three are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm.shared import bounded, col, freed, new_folder, written

#: Fixed values of the archive format.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes after which a task begins another archive, a dictionary's bytes, the bytes it is trained on, and the compression level.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL = 32 << 20, 64 << 10, 4 << 20, 3
#: Stored bytes that a reading task takes, about.
READ_BYTES = 64 << 20
#: Equal payloads shorter than this are all responses.
REVISIT_BYTES = 1000


def file_system(uri: str):
    """(file system, path) for a folder that executors share: file, hdfs, s3 or gs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if ":" in uri else f"file://{uri}")


def record_id(kind: str, page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page}:{digest}')}>"


def build_record(page: int | None, url: str | None, payload: bytes, digest_hex: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but says its length and digest."""
    digest = "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode()
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url and url.strip() else f"urn:page:{page}"
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(kind, page, digest_hex)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: {digest}", "Content-Type: application/http; msgtype=response"]
    head += [f"X-Page-Id: {page}"] * (page is not None) + [f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id('response', refers_to, digest_hex)}", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes], size: int = DICTIONARY_BYTES, sample: int = SAMPLE_BYTES):
    """A dictionary from records at even steps, or None where there is too little to learn from."""
    import zstandard

    step = max(1, -(-sum(map(len, records)) // sample))
    try:
        return zstandard.train_dictionary(size, records[::step], k=1024, d=8, f=20, split_point=1.0, accel=2, level=LEVEL)
    except (zstandard.ZstdError, ValueError):
        return None


def pack_archive(records: list[bytes]) -> bytes:
    import zstandard

    learned = train(records)
    out = []
    if learned is not None:
        learned.precompute_compress(level=LEVEL)
        raw = learned.as_bytes()
        out.append(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=learned, write_checksum=True, write_content_size=True)
    out += [press.compress(r) for r in records]
    return b"".join(out)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, from its header and block headers."""
    import zstandard

    head = zstandard.frame_header_size(data[at : at + 18])
    checksum, pos = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum, at + head
    while True:
        block = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return pos + 4 * checksum


def unpack_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, in order."""
    import zstandard

    view, at, learned = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        raw = bytes(view[8:at])
        if struct.unpack_from("<I", raw)[0] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        learned = zstandard.ZstdCompressionDict(raw)
    press = zstandard.ZstdDecompressor(dict_data=learned)
    while at < len(data):
        end = frame_end(view, at)
        yield press.decompress(view[at:end])
        at = end


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, payload_digest and refers_to, the id of the response that holds an equal payload.

    Only digests cross the first shuffle, summed on the map side.  Digests that occur once are left out and the rest is
    written: up to ``shared.BROADCAST_ROWS`` of them go to the pages, whose html then stays where it was read.  Beyond,
    pages of ``least`` bytes or more are exchanged, shorter ones and empty ones never; a digest that a third of the pages
    share is split by the skew join.
    """
    html = F.coalesce(col(payload_col).cast("string"), F.lit(""))
    own = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("payload_digest"))
    best = own.where(F.octet_length("html") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("_best"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    best = bounded(repeated := written(best.withColumnRenamed("payload_digest", "_digest"), "repeated-digests"))
    large, digest = F.octet_length("html") >= least, F.col("payload_digest") == F.col("_digest")
    if best is repeated:  # too many to broadcast
        joined = own.where(large).join(best, digest, "left").unionByName(own.where(~large), allowMissingColumns=True)
    else:
        joined = own.join(best, digest & large, "left")
    return joined.select("page_id", "url", "html", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("_best")), F.col("_best")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of :func:`with_revisits`; returns the committed manifest: path, records, raw_bytes, stored_bytes."""
    folder = folder or new_folder(records.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        held, size, done = [], 0, []

        def flush() -> None:
            data = pack_archive(held)
            path = f"{base}/{uuid.uuid4().hex}.warc.zst"
            with system.open_output_stream(path, compression=None) as to:
                to.write(data)
            done.append((path.rsplit("/", 1)[1], len(held), size, len(data)))
            held.clear()

        for batch in batches:
            columns = [batch.column(k) for k in range(5)]
            for k in range(batch.num_rows):
                page, url, html, digest, refers = (c[k].as_py() for c in columns)
                held.append(build_record(page, url, html.encode(), digest, refers, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    flush()
                    size = 0
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["path", "records", "raw_bytes", "stored_bytes"])

    rows = records.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(freed(run), "path string, records long, raw_bytes long, stored_bytes long")
    return written(rows.withColumn("path", F.concat(F.lit(folder + "/"), "path")), "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of the manifest's archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    A response's length and digest are taken from the payload as read, a revisit's from its header.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
    names = [x.split()[0] for x in schema.split(", ")]

    def whole(x: str | None) -> int | None:
        return None if x is None else int(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = file_system(uri)
                with system.open_input_stream(path, compression=None) as source:
                    data = source.read()
                out: list[list] = [[] for _ in names]
                for record in unpack_archive(data):
                    f, payload = parse_record(record)
                    kind, stated = f["WARC-Type"], base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    digest, length = (hashlib.sha1(payload).hexdigest(), len(payload)) if kind == "response" else (stated, int(f["X-Payload-Length"]))
                    if digest != stated:
                        raise ValueError(f"{uri}: a payload differs from its digest")
                    row = (whole(f.get("X-Page-Id")), f["WARC-Target-URI"], length, digest, kind, whole(f.get("X-Refers-To-Page")), payload if kind == "response" else None)
                    for to, x in zip(out, row, strict=False):
                        to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)

    return dealt(manifest).mapInArrow(freed(run), schema)


def dealt(manifest: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """The paths of a written manifest, dealt over as many tasks as their bytes need, and over all cores at least while there are archives for them.

    The number is stated, so small partitions are not put together again: what a row stands for is far larger than the row.
    """
    size = manifest.agg(F.count("*").alias("archives"), F.sum("stored_bytes").alias("stored")).first()
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(size["archives"], max(cores, -(-(size["stored"] or 0) // read_bytes))))
    return manifest.select("path").repartition(tasks)


def op1_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet"))), with_payload=False).drop("url")
