"""Near duplicates, url filters, the byte network, sharding and the pipeline."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from studyloom.llm import language_id, near_dedup, packing, queries, sharding, shared, url_filter

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- near duplicates


def brute_components(rows, words=2, percent=80):
    """(id, size, component, kept) for rows of id and text; equal ids with other texts are nodes of their own."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append(frozenset(zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    posted = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            posted[x].append(k)
    shared = Counter((a, b) for own in posted.values() for i, b in enumerate(own) for a in own[:i])
    for (a, b), n in shared.items():
        if rows[a][0] is not None and rows[b][0] is not None and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            group[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        least[find(k)].append(d)
    out = []
    for k, (d, _) in enumerate(rows):
        c = None if d is None else min(least[find(k)])
        out.append((str(d), len(sets[k]), str(c), c is None or c == d))
    return sorted(out)


def got_components(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in df.collect())


def test_components_on_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got_components(near_dedup.op3_signature_join(spark, sf)) == brute_components(rows)


@pytest.mark.parametrize("long_list", [4, 64])
def test_components_of_a_large_family(spark, monkeypatch, long_list):
    """Copies edited more and less, so that many pairs lie near the threshold, and lists are long or short by the parameter."""
    monkeypatch.setattr(near_dedup, "LONG_LIST", long_list)
    rng = random.Random(long_list)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(160):
        w = list(base)
        for _ in range(rng.randrange(0, 22)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], [f"n{rng.randrange(400)}"], [w[at], f"n{rng.randrange(40)}"]])
        rows.append((k * 3, " ".join(w)))
    rows += [(1000 + k, " ".join(f"x{rng.randrange(10**6)}" for _ in range(50)) + " the same common line here") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_components(near_dedup.near_duplicates(df, words=2)) == brute_components(rows)


def test_component_edges(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(5, text), (3, text.upper()), (3, text), (9, text + " more"), (1, None), (2, ""), (4, " \n"), (None, text), (6, "one"), (7, "ONE"), (8, "one two"), (3, "another text under that id"), (10, "q " * 60_000), (11, "Ähm é"), (12, "ähm é")]
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, node int, label string, _rejected int")
    assert got_components(near_dedup.near_duplicates(df, words=2)) == brute_components(rows)
    left = near_dedup.filter_documents(df, words=2)
    assert left.columns == df.columns
    # of (3, text) twice, once in capitals, both rows have one class but texts of their own; rows that repeat both are one
    assert Counter(str(r["doc_id"]) for r in left.collect()) == Counter(d for d, *_, kept in brute_components(rows) if kept)
    assert Counter(str(r["doc_id"]) for r in near_dedup.filter_documents(df.unionAll(df), words=2).where("doc_id is not null").collect()) == Counter({d: n * (2 if d in ("1", "2", "4") else 1) for d, n in Counter(d for d, *_, kept in brute_components(rows) if kept and d != "None").items()})
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_word_hashes_do_not_depend_on_neighbours():
    texts = [b"alpha beta gamma", b"beta gamma", b"", b"ALPHA  beta\ngamma", b"gamma"]
    together = near_dedup.shingle_sets(texts, 2)
    for t, s in zip(texts, together, strict=True):
        assert np.array_equal(near_dedup.shingle_sets([b"x" * 2_000_000, t], 2)[1], s)
    assert np.array_equal(together[0], together[3]) and set(together[1]) <= set(together[0]) and len(together[2]) == 0


def test_word_hashes_of_long_texts(monkeypatch):
    """Hashes don't depend on how a text is cut into pieces, also through words longer than a piece."""
    rng = random.Random(2)
    texts = [("".join(rng.choice(["a", "bc ", "  ", "D" * 50, "\n", "é"]) for _ in range(rng.randrange(300)))).encode() for _ in range(40)]
    want = near_dedup.shingle_sets(texts, 2)
    for piece in (1, 7, 64):
        monkeypatch.setattr(near_dedup, "PIECE", piece)
        assert all(np.array_equal(a, b) for a, b in zip(near_dedup.shingle_sets(texts, 2), want, strict=True))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for share in (0.2, 0.5, 0.8):
        n = int(4000 * 2 * share / (1 + share))
        b = np.concatenate([a[:n], rng.integers(0, 1 << 63, 4000 - n).astype(np.uint64)])
        many = near_dedup.signatures([a, b], 64)
        assert abs((many[0] == many[1]).mean() - share) < 0.2


# --- url filters


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOW)
    fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, path, *best


def test_urls(spark, sf):
    urls = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    got = {r["page_id"]: r for r in url_filter.op7_host_words(spark, sf).collect()}
    for page, url in urls:
        host, path, rule, verdict = brute_rule(url)
        r = got[page]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("block", "allow") and (verdict is None or r["verdict"] == verdict)


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "http://NET/", "http://a.net/x", "http://xnet/", "http://net", "http://a.net?x", "http://www.Example.NET/en/1", "https://example.com/de/", "https://m.example.com/de", "ftp://ü.org/fr/#a", "x://y://z.net/", "http://example.org/fr\n/x"]
    df = spark.createDataFrame([(k, u, "<p>some words here</p>", "r", 1) for k, u in enumerate(urls)] + [(None, "http://q.net/", None, "r", 1)], "page_id long, url string, html string, rule string, host int")
    got = {r["page_id"]: r for r in url_filter.filter_urls(df).collect()}
    for k, u in enumerate(urls):
        host, path, rule, verdict = brute_rule(u)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule), u
        assert verdict is None or got[k]["verdict"] == verdict
    assert got[0]["verdict"] == "allow" and got[None]["rule"] == "net/"
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_segmentation(spark):
    counts = {"learn": 50, "spark": 40, "fast": 30, "learns": 1, "park": 5, "casino": 20, "win": 20, "big": 25}
    assert url_filter.split_letters("learnsparkfast", counts, 191) == ["learn", "spark", "fast"] and url_filter.split_letters("qqqq", counts, 191) == ["qqqq"]
    table = spark.createDataFrame(list(counts.items()), "w string, n long")
    runs = spark.createDataFrame([("h:", r, 0, 0) for r in ("bigwin", "42", "com", "üß", "x")] + [("p:", "sparkfast", 0, 0)], "mark string, run string, b long, a long")
    got = sorted((r["run"], r["token"]) for r in url_filter.tokens_of(runs, table).collect())
    assert got == [("42", "h:0"), ("bigwin", "h:big"), ("bigwin", "h:win"), ("com", "h:com"), ("sparkfast", "p:fast"), ("sparkfast", "p:spark"), ("x", "h:x"), ("üß", "h:üß")]


def brute_verdicts(rows):
    """Verdict of each page by plain code: all words counted, each part split by trying all splits from the right, all tokens counted."""
    words = Counter(w for _, _, html in rows for w in re.findall("[a-z]{2,20}", re.sub("<[^>]*>", " ", (html or "").lower())))
    total, held = sum(words.values()), {}

    def split(letters):
        if letters not in held:
            best = [(0.0, ())]
            for end in range(1, len(letters) + 1):
                options = []
                for k in range(max(0, end - 20), end):
                    w = letters[k:end]
                    price = np.log(total) - np.log(words[w]) if words[w] else np.log(total) + len(w) * np.log(10)
                    options.append((best[k][0] + price, k, w))
                price, k, w = min(options)
                best.append((price, (*best[k][1], w)))
            held[letters] = best[-1][1]
        return held[letters]

    def tokens(host, path):
        out = []
        for mark, part in (("h:", host), ("p:", path.lower())):
            for run in re.findall("[a-z]+|[0-9]+|[^\x00-\x7f]+", part):
                out += [mark + "0"] if run[0].isdigit() and run.isascii() else [mark + w for w in split(run)] if run.isascii() else [mark + run]
        return out

    judged = [(page, *brute_rule(url)) for page, url, _ in rows]
    told = [(tokens(h, p), v) for _, h, p, _, v in judged if v]
    block, allow = (Counter(t for own, v in told if v == which for t in own) for which in ("block", "allow"))
    kinds = len(set(block) | set(allow)) + 1
    prior = np.log(sum(v == "block" for _, v in told) / sum(v == "allow" for _, v in told))
    odds = lambda t: np.log((block[t] + 1) / (block.total() + kinds)) - np.log((allow[t] + 1) / (allow.total() + kinds)) if t in block or t in allow else 0.0
    scores = {page: prior + sum(map(odds, tokens(h, p))) for page, h, p, _, _ in judged}
    return {page: (v or ("block" if (h or p) and scores[page] > 0 else "allow"), scores[page]) for page, h, p, _, v in judged}


def test_verdicts_by_plain_code(spark):
    """All pages of sf0.01, those without a rule too."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    got = {r["page_id"]: r for r in url_filter.op7_host_words(spark, "/root/testdata/sf0.01").collect()}
    want = brute_verdicts(rows)
    assert len(got) == len(want) and all(got[p]["verdict"] == v and abs(got[p]["score"] - x) < 1e-6 for p, (v, x) in want.items())
    assert {v for p, (v, _) in want.items() if got[p]["rule"] is None} == {"block", "allow"}


def test_long_and_repeated_urls(spark, monkeypatch):
    """Very long runs and texts, and rows that come again; the same by broadcast and by shuffle."""
    long = "http://www.casino.info/" + "winbig" * 2000 + "/" + "7" * 50_000
    rows = [(1, "http://casino.net/winbig", "casino win big " * 20_000), (2, "http://b.org/fr/learn", "learn " * 100), (3, long, None), (3, long, None), (4, "http://learn.info/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = sorted(map(tuple, url_filter.filter_urls(df).collect()))
    assert [r[4] for r in first] == ["block", "allow", "block", "block", "allow"]
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, url_filter.filter_urls(df).collect())) == first


def test_unseen_hosts_follow_their_words(spark):
    """The classifier generalises over segmented words: hosts of a blocked zone and an open one share their words."""
    rng = random.Random(3)
    bad, good = ["casino", "win", "jackpot"], ["learn", "school", "reading"]
    url = lambda words, zone: f"http://{''.join(rng.sample(words, 2))}.{zone}/{rng.choice(words)}"
    rows = [(url(bad, "net"), "block") for _ in range(60)] + [(url(good, "org") + "/x", "allow") for _ in range(60)] + [(url(bad, "info"), None) for _ in range(20)] + [(url(good, "info"), None) for _ in range(20)]
    df = spark.createDataFrame([(k, u, " ".join(bad + good)) for k, (u, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(df, rules=(("block", "net", "/"), ("allow", "org", "/"))).collect()}
    assert [got[k] for k in range(120, 160)] == ["block"] * 20 + ["allow"] * 20


def test_rare_words_split_hosts(spark):
    """A word counts however many others are more frequent; the total is over all words, also those in no url."""
    name = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(4))
    common = " ".join([name(k) for k in range(60_000)] * 2)
    df = spark.createDataFrame([(common + " zyxwvut srqponm",)], "html string")
    counts = url_filter.word_counts(df, "html")
    assert counts.agg(F.sum("n")).first()[0] == 120_002 and counts.where("w in ('zyxwvut', 'srqponm')").count() == 2
    runs = spark.createDataFrame([("zyxwvutsrqponm",)], "run string")
    assert url_filter.segmented(url_filter.words_within(runs, counts), 120_002).first()["words"] == ["zyxwvut", "srqponm"]


# --- language


def test_gradients():
    """Backpropagation through time against finite differences."""
    model = language_id.ByteGRU(["a", "b"], hidden=3, seed=1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    data = np.array([[97, 98], [99, 97], [98, 0]], np.uint8)
    real, labels = (data != 0).astype(np.float64), np.array([0, 1])

    def loss():
        # the states keep 32-bit arrays, so small steps would drown
        return model.gradients(data, real, labels)[0]

    _, g = model.gradients(data, real, labels)
    rng = np.random.default_rng(0)
    for name, x in model.p.items():
        picks = [(0, 0, 97), (1, 2, 98), (0, 4, 99)] if name == "x" else [tuple(rng.integers(0, s) for s in x.shape) for _ in range(3)]
        for at in picks:
            kept = x[at]
            x[at] = kept + 1e-2
            up = loss()
            x[at] = kept - 1e-2
            down = loss()
            x[at] = kept
            assert abs((up - down) / 2e-2 - g[name][at]) < 2e-3, name


def plain_forward(model, text):
    """Probabilities of one text by the equations, a byte after the other: stretches from zero states, no padding, the mean over all bytes."""
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    n, out = model.hidden, []
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for at in range(0, len(text), language_id.STRETCH):
        part = text[at : at + language_id.STRETCH]
        both = []
        for d, order in ((0, range(len(part))), (1, range(len(part) - 1, -1, -1))):
            h, states = np.zeros(n), {}
            for t in order:
                x, u = p["x"][d][:, part[t] or 32], p["u"][d] @ h
                z, r = sigmoid(x[:n] + u[:n]), sigmoid(x[n : 2 * n] + u[n : 2 * n])
                h = (1 - z) * np.tanh(x[2 * n :] + r * (u[2 * n :] + p["c"][d][:, 0])) + z * h
                states[t] = h
            both.append(states)
        for t in range(len(part)):
            logits = p["w"] @ np.concatenate([both[0][t], both[1][t]]) + p["b"][:, 0]
            e = np.exp(logits - logits.max())
            out.append(e / e.sum())
    return np.mean(out, axis=0)


def test_predictions_by_plain_code(spark, sf):
    """Every text of the smallest tables, and lengths around a stretch, against the equations."""
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(whole.where(~language_id.held_out(F.col("doc_id"))), epochs=2)
    texts = {r["doc_id"]: r["text"] for r in whole.select("doc_id", "text").collect()}
    texts |= {-k: "ä" + "b" * k for k in (1, 61, 62, 63, 64, 126, 127)} | {-1000: "a\0b", -1001: None, -1002: "12 3"}
    got = {r["doc_id"]: r for r in language_id.predict(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()}
    for k, text in texts.items():
        if not text or not any(map(str.isalpha, text)):
            assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0)
            continue
        want = plain_forward(model, text.encode())
        assert abs(want.max() - got[k]["score"]) < 1e-3 and want[model.langs.index(got[k]["lang_pred"])] > want.max() - 1e-3


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    rows = language_id.op8_byte_gru(spark, sf).collect()
    assert len(rows) == len(want)
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    right = sum(r["lang_pred"] == want[r["doc_id"]][0] for r in out)
    assert right >= 0.95 * len(out)


def test_language_edges(spark):
    rows = [(k, "the and of with that " * 8, "en") for k in range(30)] + [(100 + k, "der und nicht für über " * 8, "de") for k in range(30)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "123 !?", "en"), (203, "für\0über " * 20_000, None), (None, "the and of with", "en"), (204, "t", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = language_id.train(df, epochs=8)
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    assert {got[k]["lang_pred"] for k in (200, 201, 202)} == {"und"} and got[200]["score"] == 0
    assert got[0]["lang_pred"] == "en" and got[100]["lang_pred"] == "de" and got[None]["lang_pred"] == "en" and got[203]["lang_pred"] == "de"
    labels = model.positions("the and of with that für über")
    assert len(labels) == len("the and of with that für über".encode()) and set(labels) <= {0, 1}
    assert language_id.predict(df.limit(0), model).count() == 0
    assert language_id.train(df.where("lang is null")) is None
    assert {r["lang_pred"] for r in language_id.predict(df, None).collect()} == {"und"}


def test_many_languages(spark, monkeypatch):
    """Beyond a hundred languages each has a smaller sample, and all are learned; so are languages whose rows share one id."""
    monkeypatch.setattr(language_id, "SAMPLE_TOTAL", 600)
    rows = [(k, f"wort{k % 250} text{k % 250} " * 5, f"l{k % 250:03}") for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, epochs=1)
    assert len(model.langs) == 250
    same = spark.createDataFrame([(None, f"{w}{k} " * 9, w) for w in ("eins", "two") for k in range(400)], "doc_id long, text string, lang string")
    assert language_id.train(same, epochs=1, sample_docs=20).langs == ["eins", "two"]
    assert {r["lang_pred"] for r in language_id.predict(df, model).collect()} <= set(model.langs)


# --- sharding


def brute_table(shards, size):
    orders = [[(sharding.word(s, 0) + j * (sharding.word(s, 8) % (size - 1) + 1)) % size for j in range(size)] for s in shards]
    table = {}
    while len(table) < size:
        for k, order in enumerate(orders):
            if len(table) < size:
                table[next(x for x in order if x not in table)] = k
    return [table[k] for k in range(size)]


def test_lookup_table():
    for shards, size in ((("a", "b", "c"), 7), (tuple("abcdefghij"), 101), (("x",), 5)):
        table = sharding.lookup_table(shards, size)
        assert table == brute_table(shards, size)
        share = Counter(table)
        assert max(share.values()) - min(share.values()) <= 1
    before, after = sharding.lookup_table(sharding.SHARDS, 2039), sharding.lookup_table(sharding.SHARDS[:-1], 2039)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.1 * 2039
    for shards, size in ((("a",), 4), ((), 5), (("a", "a"), 5), (tuple("abc"), 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, size)


def test_placement(spark):
    df = spark.createDataFrame([(1, "x", "old", 1), (1, "x", "old", 1), (None, "y", "old", 1), (2, None, None, 1)], "doc_id long, slot string, shard string, _slot int")
    assert sharding.place(df).columns == ["doc_id", "_slot", "slot", "shard"]
    got = sharding.place(df).collect()
    assert len(got) == 4 and len({r["shard"] for r in got if r["doc_id"] == 1}) == 1
    table = sharding.lookup_table()
    for r in got:
        slot = sharding.word("" if r["doc_id"] is None else str(r["doc_id"]), 0) % sharding.TABLE_SIZE
        assert (r["slot"], r["shard"]) == (slot, sharding.SHARDS[table[slot]])
    assert sharding.place(df.limit(0)).count() == 0


# --- SQL and the pipeline


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want, df = con.sql(queries.oracle_sql()[name]), queries.queries()[name](spark, sf)
    order = sorted(df.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(str([r[c] for c in order]) for r in df.collect()) == sorted(str([r[k] for k in at]) for r in want.fetchall())


def test_pipeline(spark, sf):
    """The first four stages against plain Python, the last one's pieces against the tokenizer."""
    from tests.llm.test_text_scans import brute_counts, brute_hits

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    first = stages["quality_rules"](spark, docs, sf)
    assert first.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in first.collect()}
    assert kept <= {d for d, t in texts.items() if not brute_counts(t)[5]} and len(kept) > 0.5 * len(texts)
    second = {r["doc_id"] for r in stages["near_duplicates"](spark, first, sf).collect()}
    assert second == {int(d) for d, _, _, ok in brute_components([(d, texts[d]) for d in kept], words=5) if ok}
    third = {r["doc_id"] for r in stages["benchmark_decontamination"](spark, docs.where(F.col("doc_id").isin(*second)), sf).collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert third == {int(r[0]) for r in brute_hits([(d, texts[d]) for d in second], items) if not r[5]}
    fourth = stages["secret_scans"](spark, docs.where(F.col("doc_id").isin(*third)), sf)
    assert fourth.columns == docs.columns and {r["doc_id"] for r in fourth.collect()} == third
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == third
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for r in fourth.limit(20).collect():
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        own = sorted((p["start"], p["length"], p["ids_crc32"]) for p in rows if p["doc_id"] == r["doc_id"])
        assert [x for p in sorted(rows, key=lambda p: p["start"]) if p["doc_id"] == r["doc_id"] for x in p["ids"]] == ids.tolist()
        assert own == [(a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for a in range(0, len(ids), 2048)]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_pipeline_of_odd_rows(spark, sf, tmp_path):
    """The whole run over null ids and texts, repeated rows, an id with two texts and columns of clashing names; nothing is left but its result."""
    long = " ".join(f"clean words number {k} stand here for once" for k in range(40))
    leaked = next(r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    rows = [(1, long), (1, long), (2, long + " again"), (3, None), (None, long.replace("clean", "other")), (None, None), (4, ""), (5, long.replace("words", "parts") + "\nsecret: " + "aB3xY9" * 4), (5, long.replace("here", "there")), (6, long.replace("stand", "lie") + " " + leaked)]
    df = spark.createDataFrame([(d, t, "en", "s", 1, 2, "x", 3) for d, t in rows], "doc_id long, text string, lang string, source string, _k1 long, n_shingles int, key string, _row int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    count = Counter(r["doc_id"] for r in pieces if r["start"] == 0)
    assert count == {1: 1, None: 1, 5: 2}  # short and leaked texts go, of near copies one stays
    text = Tokenizer.from_file(packing.default_tokenizer())
    assert not any("aB3xY9aB3xY9" in text.decode(r["ids"]) for r in pieces)
    own = {}
    for r in pieces:
        own.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x) <= 2048 and sorted(x)[0][0] == 0 for x in own.values())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, sf).columns == df.columns, name
