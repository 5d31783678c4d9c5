"""Line runs, the overlap join and whitening against plain Python."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from studyloom.llm import line_dedup, overlaps, whitening

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# --- line runs

DOCS = "doc_id long, text string, row string, lines int, gone int, kept string, _k1 long, key string, h1 long, n long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "r", 1, 2, "k", 3, "y", 4, 5) for r in rows], DOCS)


def brute_lines(rows, least=10, length=1):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOW)

    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    common = {k for k, n in held.items() if n >= least and len(k) >= length}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in common]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def line_rows(spark, rows, cuts=1, **options):
    df = docs(spark, rows)
    batches = [docs(spark, rows[k::cuts]) for k in range(cuts)]
    common = line_dedup.common_lines(batches, **options)
    own = line_dedup.without_lines(df, common)
    return sorted(((r["d"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in own.select(F.col("row.doc_id").alias("d"), "n_lines", "n_dropped", "kept").collect()), key=str)


LINES = ["license\n a\nÄ", "\tLicense \nb", "", None, "\n\n", " \n license\r\nlicense", "ä\nÄ\nÄ", "c", "c\nC", "x" * 50_000 + "\nc"]


@pytest.mark.parametrize("cuts", [1, 3, 7])
def test_lines_in_any_batches(spark, cuts):
    rng = random.Random(cuts)
    rows = [(rng.choice([None, k, 7]), rng.choice(LINES)) for k in range(60)]
    assert line_rows(spark, rows, cuts) == brute_lines(rows)


def test_lines_on_both_sides_of_the_broadcast_bound(spark, monkeypatch):
    rows = [(k, "same\nown %d\nOTHER" % k) for k in range(25)]
    rows[3] = (3, "same\nsame\nsame")
    want = brute_lines(rows)
    assert line_rows(spark, rows, 2) == want
    monkeypatch.setattr("studyloom.llm.shared.BROADCAST_ROWS", 0)
    assert line_rows(spark, rows, 2) == want


def test_lines_empty_and_long(spark):
    assert line_rows(spark, []) == []
    long = "\n".join(f"{k}" if k % 2 else "common" for k in range(100_000))
    rows = [(k, long if k == 0 else f"Common\n{k + 100_000}") for k in range(12)]
    assert line_rows(spark, rows, 2) == brute_lines(rows)


def test_runs_are_levelled_and_merged_without_an_exchange(spark, sf):
    runs, every = line_dedup.LineRuns(spark), spark.read.parquet(f"{sf}/documents.parquet")
    for k in range(6):
        runs.add(every.where(F.col("doc_id") % 6 == k))
    assert [level for level, _, _ in runs.runs] == [2, 1]
    plan = runs._merged(2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    want = {(r["h1"], r["h2"]) for r in line_dedup.document_counts(every).where("n >= 10").collect()}
    assert {tuple(r) for r in runs.common().collect()} == want
    before = [name for _, name, _ in runs.runs]
    runs.close()
    assert not any(spark.catalog.tableExists(name) for name in before)


def test_filter_keeps_columns(spark):
    rows = [(k, f"same\n{k}") for k in range(10)]
    got = line_dedup.filter_documents(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns and {(r["doc_id"], r["text"]) for r in got.collect()} == {(k, str(k)) for k in range(10)}


def test_lines_of_documents(spark, sf):
    got = [tuple(r) for r in line_dedup.op11_levelled_runs(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute_lines([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])


# --- overlaps

EPOCH, SLOT = dt.datetime(1970, 1, 1), dt.timedelta(hours=6)
SALES = "sale_id long, client_id long, status string, sold_at timestamp_ntz, s int, e int, us int, open int, client int, shard int"
CLICKS = "ts timestamp_ntz, client_id long, kind string, us int, bin int, first int, k int, error int"
LINED = "sale_id long, shipped_at timestamp_ntz, shipped_us int"


def shop(spark, sales, lines, clicks):
    return (
        spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in sales], SALES),
        spark.createDataFrame([(*r, 1) for r in lines], LINED),
        spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in clicks], CLICKS),
    )


def micro(t):
    return (t - EPOCH) // dt.timedelta(microseconds=1)


def brute_overlaps(sales, lines, clicks):
    inf, by = math.inf, defaultdict(list)
    for ts, c, kind in clicks:
        if ts is not None and c is not None:
            by[c].append((ts, kind))
    found = defaultdict(list)
    for c, own in by.items():
        own.sort(key=lambda x: x[0])
        cut = [k for k in range(len(own)) if not k or own[k][0] - own[k - 1][0] > dt.timedelta(minutes=30)] + [len(own)]
        for a, b in zip(cut, cut[1:], strict=False):
            part = own[a:b]
            last = part[-1][0]
            is_open = any(k == "error" for t, k in part if t == last)
            found[c].append(((part[0][0] - EPOCH) // SLOT, inf if is_open else (last - EPOCH) // SLOT, zlib.crc32(str(micro(part[0][0])).encode())))
    out = {}
    for n, (sale, c, status, sold) in enumerate(sales):
        if c is None or sold is None:
            continue
        shipped = [t for s, t in lines if s is not None and s == sale and t is not None]
        s1, e1 = (sold - EPOCH) // SLOT, inf if status == "open" else (max([sold, *shipped]) - EPOCH) // SLOT
        for s2, e2, crc in found[c]:
            if s1 <= e2 and s2 <= e1:
                r = overlaps.RELATIONS[(s1 > s2) - (s1 < s2) + 1][(e1 > e2) - (e1 < e2) + 1]
                x = out.setdefault((n, sale, r), [0, None, 0])
                both = e1 == inf and e2 == inf
                x[0] += 1
                x[1] = x[1] if both else (x[1] or 0) + int(min(e1, e2) - max(s1, s2) + 1)
                x[2] += crc
    return sorted(((sale, r, *x) for (_, sale, r), x in out.items()), key=str)


def overlap_rows(spark, shop_rows, **options):
    return sorted(map(tuple, overlaps.overlaps(*shop(spark, *shop_rows), **options).collect()), key=str)


def random_shop(rng, n, days=12):
    t = lambda: rng.choice([None, *[dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(days * 1440), microseconds=rng.randrange(3)) for _ in range(9)]])
    client = lambda: rng.choice([None, 1, 1, 1, 2, 3, 9])
    sales = [(rng.choice([k, k, None]), client(), rng.choice(["open", "done", None]), t()) for k in range(n)]
    lines = [(rng.choice([None, 0, rng.randrange(n)]), t()) for _ in range(2 * n)]
    long = [(dt.datetime(2024, 1, 4) + k * dt.timedelta(minutes=29), c, None) for c in (1, 2) for k in range(100)]
    return sales, lines, long + [(t(), client(), rng.choice(["error", "view", None])) for _ in range(3 * n)]


@pytest.mark.parametrize("options", [{}, {"shards": 1}, {"shards": 20, "group_rows": 5}])
def test_overlaps_against_brute_force(spark, options):
    for seed in range(2):
        rows = random_shop(random.Random(seed), 60)
        got = overlap_rows(spark, rows, **options)
        assert got == brute_overlaps(*rows) and len({r[1] for r in got}) >= 8


def test_overlaps_edges(spark):
    day, minute = dt.datetime(2024, 1, 1), dt.timedelta(minutes=1)
    clicks = [(day, 1, "view"), (day + 30 * minute, 1, "view"), (day + 60 * minute + dt.timedelta(microseconds=1), 1, "error"), (day + 60 * minute + dt.timedelta(microseconds=1), 1, None), (dt.datetime(1969, 12, 31, 23), 1, None), (dt.datetime(9999, 12, 31), 1, "error"), (dt.datetime(1, 1, 1), 2, "view")]
    sales = [(1, 1, "done", day), (1, 1, "done", day), (2, 1, "open", dt.datetime(1969, 12, 31, 23)), (3, 2, "open", dt.datetime(1, 1, 1)), (4, 2, "done", dt.datetime(9999, 12, 31)), (5, 8, "open", day)]
    lines = [(1, day - minute), (1, None), (None, day + 9000 * minute), (1, day + 700 * minute)]
    assert overlap_rows(spark, (sales, lines, clicks)) == brute_overlaps(sales, lines, clicks)
    assert overlap_rows(spark, (sales, [], [])) == [] and overlap_rows(spark, ([], lines, clicks)) == []


def test_times_without_a_zone_do_not_move(spark):
    rows = random_shop(random.Random(5), 20)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert overlap_rows(spark, rows) == brute_overlaps(*rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_the_join_is_a_range_join():
    n = 50
    side = {"client": pa.array([k % 5 for k in range(n)]), "s": pa.array(range(n)), "e": pa.array([k + 3 for k in range(n)]), "own": pa.array([True] * n)}
    plan = overlaps.range_join(pa.table(side), pa.table(side | {"n": pa.array([1] * n), "crc": pa.array([1] * n)}), explain=True)
    assert "IE Join" in plan or "IE_JOIN" in plan
    empty = pa.table(side).slice(0, 0)
    assert overlaps.range_join(empty, pa.table(side | {"n": pa.array([1] * n), "crc": pa.array([1] * n)})).num_rows == 0


def test_a_hot_client_is_as_large_as_its_calendar(spark):
    """Clicks, sessions and sales of one client shrink to its half hours and intervals before they meet."""
    day = dt.datetime(2024, 1, 1)
    clicks = [(day + dt.timedelta(seconds=k * 7), 1, "view") for k in range(20_000)]
    sales = [(k, 1, "open" if k % 3 else "done", day + dt.timedelta(seconds=k * 100)) for k in range(2000)]
    s, lines, c = shop(spark, sales, [], clicks)
    assert overlaps.session_intervals(overlaps.sessions(c)).count() == 1
    assert overlaps.sale_intervals(s, lines).select("client", "s", "e").distinct().count() <= 2 * 11
    got = overlaps.overlaps(s, lines, c).groupBy("n_pairs").count().collect()
    assert [tuple(r) for r in got] == [(1, sum(k * 100 // 21600 <= 20_000 * 7 // 21600 for k in range(2000)))]


# --- whitening

VECTORS = "vec_id long, embedding array<float>, n int, v int, id int, component int, i int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], VECTORS)


def whitened(spark, rows, **options):
    return whitening.whiten(vectors(spark, rows), **options).collect()


def plain(rows, components=32):
    """Exact scatter in fractions, then eigh."""
    xs = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(xs), len(xs[0])
    s = [sum(x[i] for x in xs) for i in range(d)]
    v = [[Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in xs), n**3) for j in range(d)] for i in range(d)]
    e, u = np.linalg.eigh(np.array([[float(c) for c in r] for r in v]))
    order = np.argsort(-e)[:components]
    return [sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)) for x in xs], e[order], e[order] / float(sum(v[i][i] for i in range(d))), (np.array(xs) - np.array([b / n for b in s])) @ u[:, order] / np.sqrt(e[order])


def test_whitening_against_fractions(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6)) @ rng.normal(size=(6, 6)) + 3
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(base)]
    deviation, _, explained, w = plain(rows)
    got = whitened(spark, rows)
    assert len(got) == 40 * 6
    sign = {}
    for r in got:
        k, c = r["id"], r["component"] - 1
        assert r["n"] == 40 and r["deviation"] == deviation[k] and r["explained"] == pytest.approx(explained[c], rel=1e-9) and r["identity_error"] < 1e-9
        sign.setdefault(c, 1 if r["whitened"] * w[k, c] > 0 else -1)
        assert r["whitened"] == pytest.approx(sign[c] * w[k, c], rel=1e-7, abs=1e-9)


def test_whitening_leaves_out_unusable_rows(spark):
    good = [(1, [0.1, 0.5]), (1, [0.1, 0.5]), (None, [0.9, -0.5]), (2, [0.4, 0.6]), (4, [0.2, 0.0])]
    bad = [(5, None), (6, [0.1, None]), (7, [float("nan"), 1.0]), (8, [1.0, float("-inf")]), (9, []), (10, [1.0, 2.0, 3.0])]
    got = whitened(spark, good + bad)
    assert Counter(r["id"] for r in got) == {1: 4, None: 2, 2: 2, 4: 2} and {r["n"] for r in got} == {5}
    assert whitened(spark, []) == [] and whitened(spark, bad[:5]) == []


def test_whitening_of_flat_and_wide_values(spark):
    assert whitened(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])]) == []
    flat = whitened(spark, [(k, [k / 4, 0.5]) for k in range(6)])
    assert {r["component"] for r in flat} == {1} and flat[0]["explained"] == pytest.approx(1.0)
    wide = [(k, [float(np.float32((-1) ** k * 3.0e16 * (k + 1))), float(np.float32(k * k * 1e9))]) for k in range(9)]
    deviation, *_ = plain(wide)
    for r in whitened(spark, wide):
        want = deviation[r["id"]]
        assert r["deviation"] == (want if want < 1 << 63 else None) and r["identity_error"] < 1e-4
    assert {r["n"] for r in whitened(spark, [(k, [3.0e38 * (-1) ** k, float(k)]) for k in range(4)])} == {4}


def test_exact_products():
    rng = random.Random(1)
    for bound in (3, 10**6, 10**12, (1 << 62) - 1):
        y = np.array([[rng.randint(-bound, bound) for _ in range(3)] for _ in range(50)], dtype=np.int64)
        want = [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(3)] for i in range(3)]
        assert whitening.exact_products(y).tolist() == want
    for value in (0, 1, -1, 1 << 31, -(1 << 32), 10**40, -(10**40)):
        assert sum(p << 32 * k for k, p in enumerate(whitening.parts(value))) == value


def test_whitening_of_all_embeddings(spark, sf):
    got = whitening.op13_exact_whitening(spark, sf).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    deviation, _, explained, w = plain(rows)
    at = {v: k for k, (v, _) in enumerate(rows)}
    assert len(got) == len(rows) * 32
    sign = {r["component"]: math.copysign(1, r["whitened"] * w[at[r["vec_id"]], r["component"] - 1]) for r in got if abs(r["whitened"]) > 0.5}
    assert all(r["deviation"] == deviation[at[r["vec_id"]]] and math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9) and abs(r["whitened"] - sign[r["component"]] * w[at[r["vec_id"]], r["component"] - 1]) < 1e-6 for r in got)
    assert max(r["identity_error"] for r in got) < 1e-9
