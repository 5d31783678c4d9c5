"""Archives (exact round trip) and packing (brute force and bounds)."""

from __future__ import annotations

import hashlib
import random
import struct
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from studyloom.llm import packing, warc

PAGES = "page_id long, url string, html string, URL_2 string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)


def round_trip(df, **options):
    made = warc.with_revisits(df)
    return warc.read_archives(warc.write_archives(made, **options))


def expected(rows):
    best = {}
    for page, _, html in rows:
        if html is not None and len(html.encode()) >= 1000 and page is not None:
            best[html] = max(page, best.get(html, page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        refers = best.get(html) if html is not None else None
        refers = None if page is not None and refers == page else refers
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_round_trip(spark):
    big, other = "<p>é</p>" * 200, "z" * 1000
    rows = [(1, "http://a/", big), (5, "http://b/", big), (3, None, big), (7, "x\r\ny: z", "short"), (8, "u", "short"), (9, "u", None), (10, "u", ""), (None, "u", big), (11, "ü", other), (12, "u", "z" * 999), (13, "u", "z" * 999)]
    for options in ({}, {"archive_bytes": 2000}):
        got = round_trip(pages(spark, rows), **options).collect()
        assert sorted([tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got], key=str) == expected(rows)
        payloads = {r["page_id"]: bytes(r["payload"]) for r in got if r["record_type"] == "response"}
        assert payloads[5] == big.encode() and payloads[9] == b""
    twice = round_trip(pages(spark, [(1, "u", big), (1, "u", big), (0, "u", big)])).collect()
    assert sorted(r["record_type"] for r in twice) == ["response", "response", "revisit"]
    assert round_trip(pages(spark, rows).limit(0)).count() == 0


def test_html_is_not_exchanged(spark, monkeypatch):
    """Within the bound only digests cross the network; beyond, short pages stay out of the exchange.  Both give the same records."""
    rows = [(k, "u", None if k % 3 == 0 else "<p>long</p>" * 200 if k % 3 == 1 else f"own {k}") for k in range(300)]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    made = warc.with_revisits(pages(spark, rows))
    assert "BroadcastHashJoin" in plan(made) and "Exchange hashpartitioning" not in plan(made)
    got = sorted(map(tuple, made.collect()), key=str)
    monkeypatch.setattr("studyloom.llm.shared.BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        far = warc.with_revisits(pages(spark, rows))
        assert "Union" in plan(far) and sorted(map(tuple, far.collect()), key=str) == got
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {(r[0], r[4]) for r in expected(rows)}
    assert {(r[0], r[4]) for r in got} == want


def test_reading_is_dealt(spark):
    """Reading tasks follow the bytes stored, and the cores while bytes are few."""
    manifest = lambda n, size: spark.createDataFrame([(f"a{k}", 1, size, size) for k in range(n)], "path string, records long, raw_bytes long, stored_bytes long").coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    for n, size, want in ((100, warc.READ_BYTES, 100), (1000, warc.READ_BYTES // 10, 100), (10, 1, cores), (2, 1, 2), (0, 1, 1)):
        got = warc.dealt(manifest(n, size))
        counts = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert got.rdd.getNumPartitions() == want and sum(r["count"] for r in counts) == n
        assert not counts or max(r["count"] for r in counts) <= 4 * -(-n // want)  # four input parts are dealt in turn each


def test_payloads_above_an_archive(spark):
    """Payloads larger than an archive are records like others."""
    rng = random.Random(9)
    big = "".join(rng.choice("abcdefgh <>/") for _ in range(300_000))
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, "http://c/", big[::-1] * 3), (4, "http://d/", "small")]
    got = round_trip(pages(spark, rows), archive_bytes=100_000).collect()
    assert sorted([tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got], key=str) == expected(rows)
    assert {r["page_id"]: bytes(r["payload"]) for r in got if r["payload"] is not None}[3] == (big[::-1] * 3).encode()


def test_archive_format():
    records = [warc.build_record(k, f"http://h/{k}", f"<html><body>page {k} says hello to the world {k * 7}</body></html>".encode() * 5, "00" * 20, None, "2024-01-01T00:00:00Z") for k in range(400)]
    data = warc.pack_archive(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and struct.unpack_from("<I", data, 8)[0] == 0xEC30A437 and size <= warc.DICTIONARY_BYTES
    assert list(warc.unpack_archive(data)) == records
    end = warc.frame_end(memoryview(data), 8 + size)
    import zstandard

    learned = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    assert zstandard.ZstdDecompressor(dict_data=learned).decompress(data[8 + size : end]) == records[0]  # alone
    alone = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(data) - size < alone
    assert list(warc.unpack_archive(warc.pack_archive(records[:1]))) == records[:1]
    fields, payload = warc.parse_record(records[3])
    assert fields["WARC-Type"] == "response" and fields["WARC-Target-URI"] == "http://h/3" and payload.startswith(b"<html>")


def test_query_on_pages(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = warc.op1_warc_dictionary(spark, sf).collect()
    assert sorted([tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got], key=str) == expected(rows)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_tokenizer())


def test_tokens_are_the_tokenizers(tokenizer):
    rng = random.Random(5)
    fast = packing.WordTokenizer(packing.default_tokenizer(), cache_words=50)
    texts = ["", " ", "Hello, World!! it's 2024", "<|endoftext|> x", "<|ENDOFTEXT|>", "ΑΣ Σ σας", "İstanbul é É", "a b\tc\x1cd\x85e", "ªº µ ß ÿ Ÿ", "don't DON'T we'll 'S", "x" * 5000, "日本語 テスト", "--- ... #tag $5.00 a.b,c;d"]
    letters = "abcDEFéÜß.,!?'- \n0123"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(300)]
    for t in texts:
        assert fast(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t


def brute_fullest(counts, capacity):
    longest = max(counts)
    best = 0
    items = [s for s, n in counts.items() for _ in range(n - (s == longest))]
    sums = {0}
    for x in items:
        sums |= {s + x for s in sums if s + x <= capacity - longest}
    best = max(sums)
    return longest + best


def test_minimum_bin_slack():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 5) for _ in range(rng.randrange(1, 8))}
        used = packing.fullest_bin(counts, 40)
        assert sum(s * n for s, n in used) == brute_fullest(counts, 40) and all(n <= counts[s] for s, n in used) and max(counts) in dict(used)
        plan = packing.minimum_bin_slack(counts, 40)
        total = {}
        for combination, times in plan:
            assert sum(s * n for s, n in combination) <= 40
            for s, n in combination:
                total[s] = total.get(s, 0) + n * times
        assert total == counts
    assert packing.minimum_bin_slack({}, 10) == []


def check_packed(rows, texts, tokenizer, limit=2048):
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts}
    seen, bins = {}, {}
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(own, dtype="<u4").tobytes())
        seen.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, own in ids.items():
        cuts = [(k, a, min(limit, len(own) - a)) for k, a in enumerate(range(0, len(own), limit))]
        assert sorted(seen[d]) == cuts
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    return len(bins), -(-sum(map(len, ids.values())) // limit)


def test_packing(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    used, least = check_packed(packing.op2_best_fit_packing(spark, sf).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()], tokenizer)
    assert used <= least * 1.02 + 1


def test_packing_of_a_larger_table(spark, tokenizer):
    """All documents of sf0.01, with their ids, which are what the checksum says."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs, with_ids=True).collect()
    used, least = check_packed(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()], tokenizer)
    assert used <= least * 1.01 + 1
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in rows)


def test_packing_edges(spark, tokenizer):
    texts = [(1, None), (2, ""), (3, "word " * 3000), (4, "one two"), (5, "Ä" * 100)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in texts], "doc_id long, text string, length int, sequence_id int")
    check_packed(packing.pack_documents(docs).collect(), texts, tokenizer)
    assert packing.pack_documents(docs.limit(0)).count() == 0
    repeated = spark.createDataFrame([(7, "same text")] * 50 + [(None, "x")], "doc_id long, text string")
    rows = packing.pack_documents(repeated, max_tokens=16).collect()
    assert len(rows) == 51 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 51
    held = packing.pack_documents(docs.where("doc_id = 4"), with_ids=True).first()
    assert held["ids"] == [*tokenizer.encode("one two", add_special_tokens=False).ids, 0]
    with pytest.raises(ValueError):
        packing.pack(packing.numbered(spark.createDataFrame([(1, 0, 0, 99)], "doc_id long, piece int, start long, length long")), 16)


def test_ranks_over_many_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 10)
    pieces = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.col("id") % 3 + 5).cast("long").alias("length"))
    rows = packing.pack(packing.numbered(pieces), 16).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(rows) == 500
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 16


def test_equal_rows_are_ranked_in_many_tasks(spark, monkeypatch):
    """A family of rows that are all alike, ids and all, spreads over the salts as other rows do."""
    pieces = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(5).cast("long").alias("length"))
    held = packing.numbered(pieces)
    sizes = [r["n"] for r in packing.with_salt(held, 20).groupBy("length", "_salt").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 20 and max(sizes) < 1500
    monkeypatch.setattr(packing, "RANK_ROWS", 1000)
    rows = packing.pack(held, 16).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 20_000 and len({r["sequence_id"] for r in rows}) == 6667


def test_tokenizer_sees_a_repeated_word_once():
    """Equal words of a group's texts go to the tokenizer once, and words that come again in later groups stay known."""
    fast = packing.WordTokenizer(packing.default_tokenizer(), cache_words=40)
    want = {t: fast.direct(t).tobytes() for t in ["so many words, so few.", "<|endoftext|> x", "", "Few words (so many)", "Ünd 7 Σας few\nso so"]}
    sent, encode = [], fast.model.encode_batch_fast

    class Model:
        def __getattr__(self, name):
            return getattr(model, name)

        def encode_batch_fast(self, texts, **options):
            sent.extend(texts[0].split(" "))
            return encode(texts, **options)

    model, fast.model = fast.model, Model()
    assert list(fast.many(list(want))) == list(want.values())
    assert sorted(sent) == sorted(set(sent)) and {"so", "many", "words", "few"} <= set(sent)
    before = len(sent)
    assert list(fast.many(list(want))) == list(want.values()) and len(sent) == before
    for k in range(30):  # other words come and go, the used one stays
        assert fast(f"so {'abcdefghijklmnopqrstuvwxyzäöüß'[k] * 3}") == fast.direct(f"so {'abcdefghijklmnopqrstuvwxyzäöüß'[k] * 3}").tobytes()
    assert sent.count("so") == 1 and len(fast.newer) + len(fast.older) <= 40


def test_tokenizing_in_groups(monkeypatch):
    """Groups end within a batch, and ids and pieces are those of the tokenizer on each text alone."""
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = [None, "", *[f"word{k} Some more, words {'x' * (k % 7)} ok! " * (k % 5) for k in range(60)], "many " * 3000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr(packing, "GROUP_BYTES", 200)
    monkeypatch.setattr(packing, "GATHER_UNITS", 7)
    got = [x for own in packing.groups(batch) for x in zip(own.column(0).to_pylist(), packing.WordTokenizer(packing.default_tokenizer()).many([t or "" for t in own.column(1).to_pylist()]), strict=True)]
    assert got == [(k, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes()) for k, t in enumerate(texts)]


def test_remembered_words_take_little_memory():
    """A worker that remembers words, next to the JVM, keeps some tens of bytes for each; what they are is still the tokenizer's."""
    fast = packing.WordTokenizer(packing.default_tokenizer())
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(letters[k // 26**i % 26] for i in range(4)) + "ing" for k in range(40_000)]
    texts = [" ".join(words[i : i + 4000]) for i in range(0, len(words), 4000)]
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
        got = [zlib.crc32(x) for x in fast.many(texts)]
        kept = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    assert len(fast.newer) == len(words) and kept < 100 * len(words)
    assert got == [zlib.crc32(fast.direct(t).tobytes()) for t in texts]
