"""Secrets, quality, decontamination and personal data against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from studyloom.llm import decontamination, pii, quality, secrets, shared

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, kept int, spans string, key string, n_words int, owner string, _key int, _live int, _rejected int, _id int"


def docs(spark, rows):
    """(id, text, lang, source), with other columns of clashing names."""
    return spark.createDataFrame([(*r, 1, "s", "k", 2, "o", 3, 4, 5, 6) for r in rows], SCHEMA)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def table(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


# --- secrets


def brute_secrets(t):
    t = t or ""
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    s = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[1]) >= 6]
    s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    s += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    n = Counter(x[3] for x in s)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(s)))


def test_secrets_on_documents(spark, sf):
    got = {r["doc_id"]: tuple(r)[1:5] for r in secrets.op4_ownership_frequency(spark, sf).collect()}
    assert got == {d: brute_secrets(t) for d, t, *_ in table(spark, sf)}


def test_secret_edges(spark):
    rng = random.Random(4)
    bits = ["password=", "Token: ", "api_key = '", "APIKEY=", "secret", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "deadbeef", " ", "é", "😀", "\n", "==", "x", '"', "passwd:"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(30))), "en", "s") for k in range(150)]
    rows += [(900, None, None, None), (901, "", "en", None), (None, "password=abcdef123", "en", "s"), (902, "token=" + "a" * 50000, "en", "s"), (903, "a b " * 30000 + "token=zzzzzz9", "en", "s")]
    got = sorted((str(r["doc_id"]), *tuple(r)[1:5]) for r in secrets.scan(docs(spark, rows)).collect())
    assert got == sorted((str(d), *brute_secrets(t)) for d, t, *_ in rows)
    assert secrets.scan(docs(spark, rows).limit(0)).count() == 0


def test_ownership(spark):
    shared, own = "password=e3b3ed3cc8548923d6", "password=1f2e3d4c5b6a798877"
    rows = [(k, f"x {shared} y", "en", f"src{k}") for k in range(4)] + [(9, f"é {own} {shared}", "en", "src1"), (9, f"é {own} {shared}", "en", "src1"), (10, "password=changeme123", "en", "src1")]
    rows += [(100 + k, "token=a1b2c3d4e5f6", "en", "hot") for k in range(20)] + [(200 + k, "token=f6e5d4c3b2a1", "en", "hot") for k in range(19)]
    got = {r["doc_id"]: r for r in secrets.scan(docs(spark, rows)).collect()}
    said = lambda d: (got[d]["n_live"], got[d]["n_example"], got[d]["spans"], got[d]["ownership"])
    assert said(0) == (0, 1, "assign:2:29,example:11:29", "11:4:5")
    assert said(9) == (1, 1, "assign:2:29,live:11:29,assign:30:57,example:39:57", "11:1:1,39:4:5")
    assert said(10) == (0, 0, "assign:0:20", "9:1:1")
    assert said(100) == (0, 1, "assign:0:18,example:6:18", "6:1:20") and said(200) == (1, 0, "assign:0:18,live:6:18", "6:1:19")
    red = {r["doc_id"]: r["text"] for r in secrets.redact_documents(docs(spark, rows)).collect()}
    assert red[9] == f"é password=<secret> {shared}" and red[0] == f"x {shared} y" and red[10] == "password=changeme123" and red[200] == "token=<secret>"
    back = secrets.redact_documents(docs(spark, rows))
    assert back.columns == docs(spark, rows).columns and back.count() == len(rows)


def test_redaction_against_plain_code(spark):
    """Values that touch, nest and overlap, over many stretches, and rows with nulls."""
    rng = random.Random(12)
    value = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([24, 30, 40])))
    texts = ["".join(rng.choice(["token=", "é😀 ", value(), "x/", " ", "AKIA" + value().upper(), "w" * 3000]) for _ in range(rng.randrange(40))) for _ in range(60)]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)] + [(900, None, None, None), (901, "", "en", None)]

    def cut(t):
        spans = [m.span(1) for m in re.finditer(secrets.KINDS[0][1], t) if len(m[1]) >= 6] + [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [m.span() for m in re.finditer("[0-9a-f]{24,}", t)]
        gone = set()
        starts = set()
        end = 0
        for a, b in sorted(x for x in spans if len(set(t[x[0] : x[1]])) >= 6 and re.search("[0-9]", t[x[0] : x[1]]) and re.search("[A-Za-z]", t[x[0] : x[1]]) and not re.search(secrets.PLACEHOLDER, t[x[0] : x[1]])):
            if a >= end:
                starts.add(a)
            gone.update(range(a, b))
            end = max(end, b)
        return "".join("<secret>" * (k in starts) + ("" if k in gone else c) for k, c in enumerate(t))

    got = {r["doc_id"]: r["text"] for r in secrets.redact_documents(docs(spark, rows)).collect()}
    assert got == {d: None if t is None else cut(t) for d, t, *_ in rows}


def test_secrets_of_long_texts(spark):
    """A megabyte of cues without a value, of values, and of blanks behind a cue."""
    rows = [(1, "token" * 200_000), (2, "token=abc123 " * 20_000), (3, "password" + " " * 1_000_000), (4, "eyJ" * 300_000), (5, "a" * 1_000_000), (6, "token= " * 140_000)]
    df = docs(spark, [(d, t, "en", "s") for d, t in rows])
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    assert {d: (r["n_assign"], r["n_hex"]) for d, r in got.items()} == {1: (0, 0), 2: (20_000, 0), 3: (0, 0), 4: (0, 0), 5: (0, 1), 6: (70_000, 0)}
    assert {r["doc_id"]: len(r["text"]) for r in secrets.redact_documents(df).select("doc_id", "text").collect()}[2] == len("token=<secret> ") * 20_000
    assert time.perf_counter() - began < 60


# --- quality


def brute_counts(t):
    t = t or ""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    w = word.findall(t)
    n, c, cov = len(w), Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
    for i in range(n - 7):
        if c[tuple(w[i : i + 8])] > 1:
            cov.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if word.search(x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov), n < 20 or 100 * len(cov) > 30 * n


def test_quality_on_documents(spark, sf):
    rows = quality.op5_adaptive_quality(spark, sf).collect()
    want = {d: brute_counts(t) for d, t, *_ in table(spark, sf)}
    assert {r["doc_id"]: tuple(r)[1:7] for r in rows} == want
    assert all(not r["kept"] for r in rows if r["base_failed"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [r for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert all(r["kept"] for r in good)


def test_quality_edges(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(60))) + rng.choice(["", "\n", "\n\na\na", "\x0b\t"]), "en", "s") for k in range(120)]
    clean = [(1000 + k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)), None, None) for k in range(300)]
    junk = (2000, " ".join(f"w{k}###" for k in range(60)), None, None)
    rows += [*clean, junk, (3000, None, None, None), (3001, "", "xx", "only"), (3002, "q" * 200_000, "en", "s"), (3003, " \n\t ", "en", "s"), (3004, " ".join(map(str, range(30000))), "en", "s")]
    got = quality.quality(docs(spark, rows)).collect()
    assert {r["doc_id"]: tuple(r)[1:7] for r in got} == {d: brute_counts(t) for d, t, *_ in rows}
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert {c[0] for c in clean} <= kept and 2000 not in kept and not {3000, 3001, 3003} & kept
    left = quality.filter_documents(docs(spark, [*rows, junk, clean[0]]))
    assert left.columns == docs(spark, rows).columns and Counter(r["doc_id"] for r in left.collect()) == Counter([*kept, clean[0][0]])
    assert quality.quality(docs(spark, rows).limit(0)).count() == 0


def test_thresholds_follow_the_group(spark):
    """A source whose texts always hold many symbols keeps them; in another the same text is an outlier."""
    rng = random.Random(1)
    words = lambda mark: " ".join(f"w{rng.randrange(10**6)}{mark if rng.random() < 0.5 else ''}" for _ in range(60))
    rows = [(k, words("#"), "en", "code") for k in range(300)] + [(1000 + k, words(""), "en", "prose") for k in range(300)] + [(5000, words("#"), "en", "prose")]
    kept = {r["doc_id"] for r in quality.quality(docs(spark, rows)).where("kept").collect()}
    assert kept == {r[0] for r in rows} - {5000}


# --- decontamination


def brute_hits(rows, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOW))
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + size]), set()).add("null" if i is None else str(i))
    sizes = {len(k) for k in wins}
    out = []
    for d, t in rows:
        w, hit, it = word.findall((t or "").translate(LOW)), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if x := wins.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    it |= x
        out.append((str(d), len(w), len(hit), len(it), sha(",".join(sorted(it))), bool(hit)))
    return sorted(out)


def got_hits(df):
    return sorted((str(r["doc_id"]), *tuple(r)[1:6]) for r in df.collect())


def test_hits_on_documents(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert got_hits(decontamination.op6_positional_index(spark, sf)) == brute_hits([(d, t) for d, t, *_ in table(spark, sf)], items)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_hits_on_small_words(spark, monkeypatch, limit):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", limit)
    rng = random.Random(limit)
    say = lambda n: " ".join(rng.choice(["a", "B", "c", "é", "É", "7"]) for _ in range(n))
    items = [(k, say(rng.randrange(5))) for k in range(4)] + [(10 + k, say(12)) for k in range(3)] + [(20, None), (None, "null item words"), (21, ""), (10, "another text under ten")]
    rows = [(k, say(rng.randrange(40))) for k in range(60)] + [(100, "x " + items[4][1] + " y " + items[5][1]), (101, None), (102, ""), (103, "...null, ITEM! words..."), (100, "again"), (None, items[4][1]), (104, "b " * 20000)]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, key int")
    df = docs(spark, [(d, t, "en", "s") for d, t in rows])
    assert got_hits(decontamination.contamination(df, bench)) == brute_hits(rows, items)
    clean = {r[0] for r in brute_hits(rows, items) if not r[5]}
    left = decontamination.filter_documents(df, bench)
    assert left.columns == df.columns and {str(r["doc_id"]) for r in left.collect()} == clean
    assert decontamination.contamination(df.limit(0), bench).count() == 0
    assert not any(r["contaminated"] for r in decontamination.contamination(df, bench.limit(0)).collect())


def test_proximity(spark):
    item = "alpha beta gamma delta"
    rows = [(1, "x alpha y gamma beta z delta"), (2, "alpha beta " + "q " * 20 + "gamma delta"), (3, "alpha beta gamma")]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r["doc_id"]: r["n_near_items"] for r in decontamination.contamination(df, bench, slop=4).collect()} == {1: 1, 2: 0, 3: 0}


def test_proximity_in_a_long_text(spark):
    """Work is linear in a text whose every word is a rare term of an item: it ends within a minute."""
    df = spark.createDataFrame([(1, "alpha beta " * 100_000), (2, "beta " + "q " * 16 + "alpha")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma")], "item_id long, text string")
    start = time.perf_counter()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_near_items"]) for r in decontamination.contamination(df, bench).collect()}
    assert got == {1: (200_000, 200_000, 1), 2: (18, 0, 0)} and time.perf_counter() - start < 60


def test_index_holds_every_token(spark, sf):
    """All terms of all texts, with their positions, and each text's length."""
    df = spark.createDataFrame([(1, "...b A, a"), (2, None), (3, ""), (4, "c!")], "doc_id long, text string")
    index = decontamination.build_index(df)
    keys = {(r["_k1"], r["_k2"]): r["doc_id"] for r in df.select("doc_id", *shared.row_key(F.col("doc_id"), F.col("text"))).collect()}
    hashes = {r["h"]: r["t"] for r in spark.createDataFrame([(t,) for t in "abc"], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    assert sorted((keys[r["_k1"], r["_k2"]], r["pos"], hashes[r["tid"]]) for r in index.where("tid not in (0, 1, 2)").collect()) == [(1, 1, "b"), (1, 2, "a"), (1, 3, "a"), (4, 0, "c")]
    assert {keys[r["_k1"], r["_k2"]]: r["n_words"] for r in decontamination.lengths(index).collect()} == {1: 3, 2: 0, 3: 0, 4: 1}
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    assert decontamination.build_index(whole).count() == sum(1 + len(word.findall((t or "").translate(LOW))) for _, t, *_ in table(spark, sf))


def test_proximity_of_all_documents(spark, sf):
    """The registered query's near items, by brute force; and a passage with inserted and swapped words."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    said = lambda t: word.findall((t or "").translate(LOW))

    def near(text, items):
        w, out = said(text), set()
        for i, t in items:
            b = said(t)
            size = min(10, len(b))
            wins = [set(b[k : k + size]) for k in range(len(b) - size + 1)] if b else []
            if any(x <= have and any(x <= set(w[p : p + size + 5]) for p in range(len(w))) for have in [set(w)] for x in wins):
                out.add(i)
        return len(out)

    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = decontamination.op6_positional_index(spark, sf).collect()
    assert {r["doc_id"]: r["n_near_items"] for r in rows} == {d: near(t, items) for d, t, *_ in table(spark, sf)}
    assert all(r["n_near_items"] >= r["n_items"] for r in rows)
    w = said(items[0][1])
    moved = " ".join([w[1], w[0], "zzz", *w[2:9][::-1], "zzz", *w[9:12]])
    got = decontamination.contamination(docs(spark, [(1, moved, "en", "s"), (2, items[0][1], "en", "s"), (3, None, "en", "s")]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_items"], r["n_near_items"]) for r in got) == [(1, 0, near(moved, items)), (2, 1, 1), (3, 0, 0)] and near(moved, items) == 1


# --- personal data


def luhn(x):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(x))) % 10 == 0


def brute_pii(t):
    t = t or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = (
        ("email", [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]),
        ("ip", [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]),
        ("card", [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]),
        ("phone", [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]),
    )
    return *(len(v) for _, v in found), sha(",".join(f"{k}:{a}:{b}" for k, v in found for a, b in v))


def test_pii_on_documents(spark, sf):
    got = {r["doc_id"]: tuple(r)[1:6] for r in pii.op10_anchor_expansion(spark, sf).collect()}
    assert got == {d: brute_pii(t) for d, t, *_ in table(spark, sf)}


def brute_added(t):
    """account, url and postal spans by plain patterns, for short texts only."""
    out = {"account": [], "url": [], "postal": []}
    cues = "|".join(sorted({f for c in pii.CUES for f in (c, c.upper(), c.capitalize(), c.title())}, key=len, reverse=True))
    end = 0
    for m in re.finditer(rf"(?=({cues}))", t):
        at = m.start()
        if at < end or at and t[at - 1].isalnum():
            continue
        gap = re.match(r"[ \t]*(?:(?:is|no|number|nr)\b\.?)?[ \t]*[:=#]?[ \t]*", t[m.end(1) :])[0]
        start = m.end(1) + len(gap)
        runs = [[a + start for a in g.span()] for g in re.finditer("[A-Za-z0-9]+", t[start:])]
        ends = []
        for k, (a, b) in enumerate(runs):
            if k == 0 and a != start or k and (a != runs[k - 1][1] + 1 or t[a - 1] not in " -"):
                break
            ends.append(b)
        ends = [b for b in ends if len(re.sub("[ -]", "", t[start:b])) <= 34] if gap else []
        if m[1].lower() == "iban":
            good = [b for b in ends if pii.iban(t[start:b]) and pii.IBAN_LENGTHS.get(t[start : start + 2], str(len(re.sub("[ -]", "", t[start:b])))) == str(len(re.sub("[ -]", "", t[start:b])))]
        else:
            good = [b for b in ends if re.fullmatch("[A-Z]{0,2}[0-9][A-Z0-9]*([ -](?=[A-Z]*[0-9])[A-Z0-9]{2,})*", t[start:b])]
            good = good[-1:] if good and sum(c in "0123456789" for c in t[start : good[-1]]) >= 6 else []
        if good:
            end = good[-1]
            out["account"].append((start, end))
    body = r"[^\s<>\"'`{}|\\^]"
    for m in re.finditer(rf"[A-Za-z][A-Za-z0-9+.-]*://(?=((?:[^\s<>\"'`{{}}|\\^/?#]*@)?(?:[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|localhost)(?::[0-9]+)?[.,;:!?)\]*]*(?=[/?#]|\Z|(?!{body}))))({body}*)", t):
        out["url"].append((m.start(), m.start(2) + len(m[2].rstrip(".,;:!?)]*"))))
    named = r"(?<![A-Za-z0-9])[0-9]{1,6}[A-Za-z]?(?: [A-Z][\w'-]*){1,4}? (?:Street|Road)(?![^\W_])(?:,? (?:Apt|Suite|Unit|Floor)\.? ?[0-9A-Z]{1,6}(?![A-Za-z0-9]))?"
    out["postal"] = [m.span() for m in re.finditer(named, t)]
    return out


def test_pii_added_kinds():
    """Spans of the added kinds against plain patterns on random short texts."""
    rng, anchors = random.Random(16), pii.automaton()
    accounts = ["iban", "IBAN", "ssn", "passport", "account no", "Tax Id", " ", ":", "#", "is", "no", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "123", "12-34", "X1", "ABC", "AND", "4567", "-", "x", ".", "é"]
    urls = ["http", "://", "ftp://", "a.b", "localhost", ":80", "/", "?q=1", "#f", "@", "u:p", ".", ",", ")", " ", "'", "é", "-"]
    streets = ["12", "7B", " ", " ", "12 Baker", " Main", " Street", " Road", ", Apt 4", " Unit 12C", "x", "1234567", ".", "é"]
    for kinds, bits in ((("account",), accounts), (("url",), urls), (("postal",), streets)):
        seen = 0
        for _ in range(6000):
            t = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
            found, want = pii.find(t, anchors), brute_added(t)
            for k in kinds:
                seen += len(want[k])
                assert found[k] == want[k], (t, k)
        assert seen > 30, kinds


def test_pii_boundaries():
    anchors = pii.automaton()
    said = lambda t: {k: [t[a:b] for a, b in v] for k, v in pii.find(t, anchors).items() if v}
    assert said("IBAN DE89 3704 0044 0532 0130 00 THANKS") == {"account": ["DE89 3704 0044 0532 0130 00"]}
    assert said("account number 12345678 AND MORE WORDS") == {"account": ["12345678"]}
    assert said("see (https://example.com/a?x=1).") == {"url": ["https://example.com/a?x=1"]}
    assert said("at 221B Baker Street, Apt 4, London") == {"postal": ["221B Baker Street, Apt 4"]}
    assert said("in Hauptstraße 12, Berlin") == {"postal": ["Hauptstraße 12"]}
    assert said("au 12 rue de la Paix, Paris") == {"postal": ["12 rue de la Paix"]} and said("en Calle Mayor 5.") == {"postal": ["Calle Mayor 5"]}
    assert said("The Street 5, a road, main road 7, iban, ssn 12345") == {}


def test_pii_long_texts():
    """A megabyte of whatever might make a parser go back, each within seconds."""
    anchors, n = pii.automaton(), 1_000_000
    texts = [c + " " * n + "x" for c in pii.CUES] + [p * (n // len(p)) for p in ("iban ", "://", "a://b.c/", "x://a:", "1 Baker ", "Street ", "1 A Street", "straße", "1 rue A", "+1", "1.", "account no 1 2 3 4 5 6 7 8 9 ", "@", "a@", "1 ")]
    for t in [*texts, "a" * n + "@b.co", "account no " + "1 " * n, "+1 " + "(" * n, "x://" + "a" * n]:
        began = time.perf_counter()
        pii.find(t, anchors)
        assert time.perf_counter() - began < 5, t[:30]


def test_pii_of_a_larger_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:6] for r in pii.op10_anchor_expansion(spark, "/root/testdata/sf0.01").collect()}
    assert got == {r["doc_id"]: brute_pii(r["text"]) for r in docs.collect()}


def test_pii_random():
    rng, anchors = random.Random(6), pii.automaton()
    bits = ["@", ".", "a", "b-c", "+", "1", "255", "256", "0001", " ", "-", "(", ")", "4111 1111 1111 1111", "+49 30 1234567", "x@y.com", "1.2.3.4", "\n", "é", "😀", "%", "٣"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        found = pii.find(t, anchors)
        said = ",".join(f"{k}:{a}:{b}" for k in pii.BASE_KINDS for a, b in found[k])
        assert (*(len(found[k]) for k in pii.BASE_KINDS), sha(said)) == brute_pii(t), t


def test_pii_edges(spark):
    rows = [(1, None), (2, ""), (None, "a@b.co"), (3, "IBAN: DE89 3704 0044 0532 0130 00, IBAN DE00 3704 0044 0532 0130 00"), (4, "see ftp://joe:pw@host.org/x"), (5, "9" * 100_000), (6, "a@" * 20_000), (7, "passport no: X1234567")]
    got = {r["doc_id"]: r for r in pii.scan(docs(spark, [(d, t, "en", "s") for d, t in rows])).collect()}
    for d, t in rows:
        assert tuple(got[d][c] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256")) == brute_pii(t)
    assert got[3]["spans"] == "account:6:33" and "login:10:16" in got[4]["spans"] and got[7]["spans"] == "account:13:21"
    assert got[None]["redacted"] == "<email>" and got[1]["redacted"] is None
    assert pii.scan(docs(spark, [(1, "x", "en", "s")]).limit(0)).count() == 0
