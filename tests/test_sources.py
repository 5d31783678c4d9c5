from __future__ import annotations

import io
import json
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from studyloom.operators.chunking import chunk
from studyloom.operators.qa import fallback_qa
from studyloom.plans import flows, queries
from studyloom.sources import files, sinks, tables
from studyloom.sources.pdf import Document, pdf_bytes, to_unicode


def docx(*paragraphs: str) -> bytes:
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def pdf(*pages: str, deflate: bool = False) -> bytes:
    out = b"%PDF-1.4\n"
    for k, text in enumerate(pages):
        content = f"BT /F1 12 Tf ({text}) Tj ET".encode("latin-1")
        data, extra = (zlib.compress(content), b"/Filter /FlateDecode ") if deflate else (content, b"")
        out += b"%d 0 obj << /Type /Page /Contents %d 0 R >> endobj\n" % (2 * k + 1, 2 * k + 2)
        out += b"%d 0 obj << %s/Length %d >> stream\n%s\nendstream endobj\n" % (2 * k + 2, extra, len(data), data)
    return out + b"%%EOF"


def test_parsers():
    assert files.docx_text(docx("one", "two")) == "one\ntwo"
    for deflate in (False, True):
        assert files.pdf_text(pdf("Hello \\(x\\)", "World", deflate=deflate)) == "\n\n--- PAGE 1 ---\n\nHello (x)\n\n\n--- PAGE 2 ---\n\nWorld\n"


def test_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo", encoding="utf-8")
    (tmp_path / "b.DOCX").write_bytes(docx("two"))
    (tmp_path / "c.pdf").write_bytes(pdf("three"))
    (tmp_path / "d.pdf").write_bytes(b"broken")
    (tmp_path / "e.bin").write_bytes(b"\xff\xfe")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("héllo", None) and got["b.DOCX"] == ("two", None) and got["c.pdf"][0].endswith("three\n")
    assert got["d.pdf"][0] == "" and got["d.pdf"][1] and got["e.bin"] == ("", "unsupported format: bin")
    assert files.read_folder(spark, str(tmp_path), "*.txt").count() == 1
    assert files.read_folder(spark, str(tmp_path / "none")).count() == 0
    strict = {r["path"].rsplit("/", 1)[1]: r["error"] for r in files.read_folder(spark, str(tmp_path), "*.*", strict=True).collect()}
    assert strict["a.txt"] is None and strict["e.bin"].startswith("UnicodeDecodeError")


def test_uploads(spark, tmp_path):
    root = str(tmp_path / "landing")
    schema = "instance_id long, file_name string, content binary, version long"
    files.save_uploads(spark.createDataFrame([(1, "../x y.txt", b"old", 1), (2, "x_y.txt", b"other", 1)], schema), root)
    files.save_uploads(spark.createDataFrame([(1, "x y.txt", b"new", 2)], schema), root)
    got = {(r["instance_id"], r["file_name"]): bytes(r["content"]) for r in files.stored_files(spark, root).collect()}
    assert got == {(1, "x_y.txt"): b"new", (2, "x_y.txt"): b"other"}


def test_pages(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, None)], "f long, page_no int, text string")
    got = {r["f"]: r["text"] for r in files.join_pages(df, ["f"]).collect()}
    assert got == {1: "\n\n--- PAGE 1 ---\n\na\n\n--- PAGE 2 ---\n\nb", 2: "\n\n--- PAGE 1 ---\n\n"}


def test_sinks(spark, tmp_path):
    texts = spark.createDataFrame([("d", "Ein längerer Satz über Flüsse, Seen und das weite Meer.")], "key string, text string")
    chunks = chunk(texts)
    pairs = fallback_qa(chunks.drop("title", "word_count"))
    sinks.save_csv(pairs, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == list(sinks.CSV_COLUMNS) and back.count() == 3
    numbered = pairs.orderBy("difficulty").limit(1).withColumn("number", F.lit(1))
    sinks.save_markdown(numbered, str(tmp_path / "md"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*")))
    assert text.startswith("# Generated Q&A Pairs\n\n## 1. What is one key idea") and text.endswith("---\n\n")
    meta = spark.createDataFrame([("d", "llama3:8b")], "key string, model string")
    got = json.loads(sinks.results_json(meta, chunks, pairs, "key").first()["json"])
    assert got["metadata"] == {"model": "llama3:8b"} and got["chunks"][0]["word_count"] == 10 and len(got["qa_pairs"]) == 3
    sinks.save_json(pairs, str(tmp_path / "json"))
    assert "längerer" in "".join(p.read_text() for p in (tmp_path / "json").glob("part-*"))


def test_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS school")
    tables.create_tables(spark, "school")
    tables.create_tables(spark, "school")
    row = spark.createDataFrame([(7, "f.txt", 1, "/f.txt")], "instance_id long, file_name string, id long, file_path string").withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    tables.append(row, "documents", "school")
    assert spark.table("school.documents").where("instance_id = 7").first()["file_name"] == "f.txt"
    tables.drop_tables(spark, "school")
    assert not spark.catalog.tableExists("school.documents")


def test_flows(spark):
    long = " ".join(f"word{k}" for k in range(450)) + ". "
    uploads = spark.createDataFrame([(1, 5, long), (2, 5, " \n"), (3, 6, "tiny é")], "id long, instance_id long, text string")
    cards = spark.createDataFrame([], "instance_id long, question string")
    pairs, fresh, stats = flows.upload(uploads, cards, F.lit("2024-01-01").cast("timestamp_ntz"))
    assert pairs.count() == 9 and fresh.count() == 9
    got = {r["id"]: (r["qa_pairs"], r["chunks"], r["message"][:7], r["warning"]) for r in stats.collect()}
    assert got == {1: (6, 2, "Documen", None), 2: (0, 0, "No text", None), 3: (3, 1, "Documen", None)}
    batch = spark.createDataFrame([("a", long, None), ("b", "", None), ("c", "", "OSError")], "path string, text string, error string")
    meta, chunks, qa = flows.batch(batch, "now")
    rows = {r["path"]: r for r in meta.collect()}
    assert (rows["a"]["chunk_count"], rows["a"]["qa_count"]) == (2, 6) and rows["b"]["error"] == "Failed to extract text" and rows["c"]["error"] == "OSError"
    docs = spark.createDataFrame([(1, 5, "/p"), (2, 5, "/p"), (3, 6, "/q")], "id long, instance_id long, file_path string")
    texts = spark.createDataFrame([("/p", "text one"), ("/q", "text two")], "file_path string, text string")
    have = spark.createDataFrame([(6,)], "instance_id long")
    assert {(r["instance_id"], r["id"]) for r in flows.bootstrap(docs, texts, have).collect()} == {(5, 1)}


def test_pdf_page_tree():
    """Pages come in the order of the tree, through inner nodes and lists of their own, whatever their order in the file."""
    page = lambda n, text: f"{n} 0 obj << /Type /Page /Contents {n + 10} 0 R >> endobj\n{n + 10} 0 obj << >> stream\nBT ({text}) Tj ET\nendstream endobj\n".encode()
    data = b"%PDF-1.4\n" + page(3, "third") + page(4, "first") + page(5, "second") + b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [7 0 R 3 0 R] >> endobj 7 0 obj << /Type /Pages /Kids 8 0 R >> endobj 8 0 obj [4 0 R 5 0 R 2 0 R] endobj"
    assert [p.strip() for p in files.pdf_pages(data)] == ["first", "second", "third"]


def test_pdf_object_streams():
    bodies = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [4 0 R 3 0 R] >>", 3: b"<< /Type /Page /Contents 6 0 R >>", 4: b"<< /Type /Page /Contents [5 0 R] >>"}
    starts, body = [], b""
    for n, x in bodies.items():
        starts.append(f"{n} {len(body)}")
        body += x + b" "
    head = " ".join(starts).encode() + b" "
    packed = zlib.compress(head + body)
    show = lambda n, text: f"{n} 0 obj << /Filter /FlateDecode >> stream\n".encode() + zlib.compress(f"BT ({text}) Tj ET".encode()) + b"\nendstream endobj\n"
    data = b"%PDF-1.5\n" + show(5, "one") + show(6, "two") + f"9 0 obj << /Type /ObjStm /N {len(bodies)} /First {len(head)} /Filter /FlateDecode >> stream\n".encode() + packed + b"\nendstream endobj"
    assert [p.strip() for p in files.pdf_pages(data)] == ["one", "two"]


@pytest.mark.parametrize("data", [b"", b"no", b"%PDF-1.4 nothing", b"%PDF-1.4 1 0 obj << /Type /Page >> endobj trailer << /Encrypt 3 0 R >>"])
def test_pdf_without_pages_is_an_error(data):
    with pytest.raises(ValueError):
        files.pdf_pages(data)


UNICODE = b"""/CIDInit /ProcSet findresource begin
2 begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange
1 beginbfchar <01> <00660069> endbfchar
2 beginbfrange <20> <7E> <0020> <8001> <8003> [<D83DDE00> <4E00> <00E9>] endbfrange
endcmap"""


def test_to_unicode_tables():
    """Codes of one and two bytes, ligatures, ranges, lists and characters beyond two bytes."""
    sizes, found = to_unicode(UNICODE)
    assert sizes == [(b"\x00", b"\x7f"), (b"\x80\x00", b"\xff\xff")]
    assert found[b"\x01"] == "fi" and found[b"A"] == "A" and found[b"\x80\x01"] == "\U0001f600" and found[b"\x80\x03"] == "é"
    stream = lambda n, data: b"%d 0 obj << /Length %d >> stream\n%s\nendstream endobj\n" % (n, len(data), data)
    data = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [3 0 R] /Resources 9 0 R >> endobj 3 0 obj << /Type /Page /Contents [6 0 R 7 0 R] >> endobj 4 0 obj << /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >> endobj 9 0 obj << /Font << /A 4 0 R /B << /Subtype /Type1 /Encoding /WinAnsiEncoding >> >> >> endobj\n"
    data += stream(5, UNICODE) + stream(6, b"BT /A 9 Tf <0141 8001 8002 9999> Tj 0 -9 Td [(A) -30 (B) -400 (C)] TJ ET") + stream(7, b"BT 1 0 0 1 9 9 Tm /B 9 Tf (\x80 \\050x\\051 (y)) Tj 1 0 0 1 20 9 Tm (z) Tj 1 0 0 1 9 0 Tm (w) Tj ET")
    assert files.pdf_pages(data) == ["fiA\U0001f600\u4e00\ufffd\nAB C\n€ (x) (y)z\nw\n"]


@pytest.mark.parametrize("wide", [False, True])
def test_pdf_round_trip(wide):
    rng = random.Random(wide)
    for _ in range(30):
        pages = ["".join(rng.choice("ab() \\\n<>[]%/é€" + "日\U0001f600" * wide) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 5))]
        data = pdf_bytes(pages, wide)
        assert files.pdf_pages(data) == [p + "\n" for p in pages]
        broken = data.replace(b"startxref\n", b"startxref\n7")
        assert files.pdf_pages(broken) == files.pdf_pages(data)  # found without the references


def test_a_changed_pdf_shows_its_newest_objects():
    data = pdf_bytes(["old", "kept"])
    at, new = len(data) + 1, b"11 0 obj << >> stream\nBT /F1 9 Tf (new) Tj ET\nendstream endobj\n"
    start = int(data.rsplit(b"startxref", 1)[1].split()[0])
    data += b"\n" + new + b"xref\n11 1\n%010d 00000 n \ntrailer << /Size 14 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, start, at + len(new))
    assert files.pdf_pages(data) == ["new\n", "kept\n"]


def test_broken_pdfs_are_errors_of_their_own(spark):
    good = pdf_bytes(["fine"], True)
    rng = random.Random(3)
    rows = [(0, good)] + [(k, good[: rng.randrange(9, len(good))] if k % 2 else bytes(b if rng.random() > 0.02 else rng.randrange(256) for b in good)) for k in range(1, 60)]
    got = files.extracted(spark.createDataFrame(rows, "id int, content binary"), F.lit("pdf")).collect()
    assert len(got) == 60 and [r["text"] for r in got if r["id"] == 0] == ["\n\n--- PAGE 1 ---\n\nfine\n"]
    assert all(r["error"] is None or r["text"] == "" for r in got)


def test_a_followed_folder_is_parsed_once(spark, tmp_path):
    """Files that come in three steps end in what a reading of the whole folder gives; none is parsed twice, and broken ones stand apart."""
    folder, out, mark, seen = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark"), tmp_path / "seen"
    folder.mkdir()
    seen.mkdir()

    def told(data):
        import uuid

        (seen / f"{len(data)}-{uuid.uuid4().hex}").touch()
        return files.pdf_pages(data)

    for k in range(3):
        (folder / f"a{k}.txt").write_text(f"text {k}")
        (folder / f"b{k}.pdf").write_bytes(pdf_bytes([f"page {'x' * k}"]))
        (folder / f"c{k}.pdf").write_bytes(b"broken" + b"!" * k)
        files.follow_folder(spark, str(folder), out, mark, pdf=told)
    files.follow_folder(spark, str(folder), out, mark, pdf=told)
    good, bad = files.followed(spark, out)
    whole = files.read_folder(spark, str(folder))
    assert sorted(map(tuple, good.collect())) == sorted((r["path"], r["n_bytes"], r["text"]) for r in whole.where("error is null").collect())
    assert sorted(map(tuple, bad.collect())) == sorted((r["path"], r["n_bytes"], r["error"]) for r in whole.where("error is not null").collect())
    assert good.count() == 6 and bad.count() == 3 and len(list(seen.iterdir())) == 6


def test_files_are_made_where_they_are_written(spark, tmp_path):
    """A file's content is made of its row by the writing task; values and files in any number of batches."""
    rows = spark.createDataFrame([(f"{k}.pdf", k, "line 中\n" * k) for k in range(1, 30)], "file string, k int, text string")
    files.save_files(rows, str(tmp_path / "pdfs"), lambda k, text: pdf_bytes([text] * 2, k % 2 > 0) if k % 2 else b"none")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_folder(spark, str(tmp_path / "pdfs"), "*.pdf").collect()}
    assert len(got) == 29 and all((got[f"{k}.pdf"]["error"] is None) == (k % 2 > 0) for k in range(1, 30))
    assert got["3.pdf"]["text"].count("line 中\n") == 6


def test_parts_are_listed_by_tasks(spark, tmp_path):
    """Files in parts, saved twice, are read once each, with errors of their own; the driver holds none of their names."""
    folder = f"{tmp_path}/pdfs"
    rows = spark.createDataFrame([(f"{k}.pdf", k) for k in range(300)] + [("a.txt", 1)], "file string, k int")
    for _ in range(2):
        files.save_files(rows, folder, lambda k: pdf_bytes([f"page {k}"], k % 2 > 0) if k % 3 else b"none", 7)
    (tmp_path / "pdfs" / "000003" / "_5.pdf").write_bytes(b"begun")
    read = files.read_parts(spark, folder, ".pdf")
    got = {int(r["path"].rsplit("/", 1)[1][:-4]): r for r in read.collect()}
    assert len(got) == read.count() == 300 and read.inputFiles() == []
    assert all((r["text"], r["error"]) == (("\n\n--- PAGE 1 ---\n\npage %d\n" % k, None) if k % 3 else ("", "ValueError: no PDF header")) for k, r in got.items())
    assert got[3]["n_bytes"] == 4 and sorted(p.name for p in (tmp_path / "pdfs").iterdir()) == [f"{k:06d}" for k in range(7)]
    assert files.read_parts(spark, f"{tmp_path}/none", ".pdf").count() == 0
    assert (files.parts_for(3_000_001, 12), files.parts_for(10, 12), files.parts_for(0, 2)) == (601, 48, 8)


def test_pdf_files_are_not_listed_by_the_driver(spark, sf):
    """What the driver holds of read_pdfs doesn't grow with the documents, of which each is a file."""
    assert queries.read_pdfs(spark, sf).inputFiles() == []


def test_a_read_file_is_let_go():
    """Without the collector, so what a task holds doesn't grow with the files it has read."""
    import gc
    import weakref

    gc.disable()
    try:
        doc = Document(pdf_bytes(["a", "b", "c"], True))
        assert len(list(doc.pages())) == 3
        seen = weakref.ref(doc)
        del doc
        assert seen() is None
    finally:
        gc.enable()
