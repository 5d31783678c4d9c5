"""Stored tables: inserts that may be repeated, changes in place, pages."""

from __future__ import annotations

import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from studyloom.operators import paging
from studyloom.sources import storage, tables
from studyloom.sources.storage import new_folder


@pytest.fixture
def db(spark):
    name = f"t_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{new_folder(spark, 'db')}'")
    tables.create_tables(spark, name)
    yield name
    tables.drop_tables(spark, name)
    spark.sql(f"DROP DATABASE {name} CASCADE")


def documents(spark, rows):
    df = spark.createDataFrame(rows, "id long, instance_id long")
    return df.select("instance_id", F.lit("f").alias("file_name"), "id", F.lit("/f").alias("file_path"), F.lit(None).cast("timestamp_ntz").alias("created_at"))


def instances(spark, ids):
    when = F.lit("2024-01-01").cast("timestamp_ntz")
    return spark.createDataFrame([(k,) for k in ids], "id long").select("id", F.concat(F.lit("n"), F.col("id")).alias("name"), F.lit("d").alias("description"), F.lit(None).cast("string").alias("color"), when.alias("created_at"), when.alias("updated_at"), F.lit(None).cast("double").alias("last_score"))


def ids_in(spark, name, db):
    return sorted(r["id"] for r in tables.read(spark, name, db).collect())


def files_of(spark, name, db):
    """Data files by partition, with the time of their last change."""
    root = Path(spark.catalog.getDatabase(db).locationUri.removeprefix("file:")) / name
    out = {}
    for p in root.rglob("*.parquet"):
        out.setdefault(int(p.parent.parent.name.removeprefix("part=")), set()).add((p.name, p.stat().st_mtime_ns))
    return out


def test_an_insert_counts_once(spark, db):
    rows = documents(spark, [(k, k % 5) for k in range(50)])
    assert tables.append_once(rows, "documents", "monday", db)
    assert not tables.append_once(rows, "documents", "monday", db) and ids_in(spark, "documents", db) == list(range(50))
    assert tables.append_once(documents(spark, [(50, 1)]), "documents", "tuesday", db) and ids_in(spark, "documents", db) == list(range(51))
    assert tables.append_once(instances(spark, [1]), "instances", "monday", db)  # a key of its own for each table


def test_a_try_that_broke_off_is_replaced(spark, db, monkeypatch):
    """Rows were written, the record was not: the next try brings them once."""
    rows = documents(spark, [(k, k % 3) for k in range(9)])
    real = tables._commits
    with monkeypatch.context() as m:
        m.setattr(tables, "_commits", lambda s, d: "nowhere://x")
        with pytest.raises(Exception):  # noqa: B017 - any failure of the store
            tables.append_once(rows, "documents", "k", db)
    tables._placed(rows.limit(4), "documents", db, tables.hashlib.sha256(b"k").hexdigest()[:32]).write.mode("append").insertInto(f"{db}.documents")
    assert tables._commits is real and tables.append_once(rows, "documents", "k", db) and ids_in(spark, "documents", db) == list(range(9))


def test_changes_rewrite_touched_partitions_only(spark, db):
    tables.append(instances(spark, range(100)), "instances", db)
    tables.append(documents(spark, [(k, k % 100) for k in range(300)]), "documents", db)
    before = files_of(spark, "instances", db)
    patches = spark.createDataFrame([(3, "new", True), (4, "kept", False), (999, "none", True)], "id long, name string, set_name boolean")
    touched = tables.patch(spark, "instances", patches, {"name": "set_name"}, db)
    got = {r["id"]: r["name"] for r in tables.read(spark, "instances", db).collect()}
    assert len(got) == 100 and got[3] == "new" and got[4] == "n4" and 1 <= len(touched) <= 3
    after = files_of(spark, "instances", db)
    assert all(after[p] == f for p, f in before.items() if p not in touched) and any(after[p] != before[p] for p in touched if p in before)
    tables.patch(spark, "instances", patches, {"name": "set_name"}, db)  # again, after a failure: the same
    assert {r["id"]: r["name"] for r in tables.read(spark, "instances", db).collect()} == got

    docs_before = files_of(spark, "documents", db)
    gone = tables.delete(spark, "documents", spark.createDataFrame([(7,), (8,)], "id long"), db)
    assert ids_in(spark, "documents", db) == [k for k in range(300) if k not in (7, 8)]
    docs_after = files_of(spark, "documents", db)
    assert all(docs_after[p] == f for p, f in docs_before.items() if p not in gone)
    tables.delete_instances(spark, spark.createDataFrame([(k,) for k in range(50)], "id long"), db)
    assert ids_in(spark, "instances", db) == list(range(50, 100)) and {r["instance_id"] for r in tables.read(spark, "documents", db).collect()} == set(range(50, 100))


def test_emptied_partitions_go(spark, db):
    tables.append_once(documents(spark, [(1, 5), (2, 5)]), "documents", "k", db)
    tables.delete(spark, "documents", spark.createDataFrame([(1,), (2,)], "id long"), db)
    assert ids_in(spark, "documents", db) == [] and spark.sql(f"SHOW PARTITIONS {db}.documents").count() == 0
    assert not tables.append_once(documents(spark, [(1, 5), (2, 5)]), "documents", "k", db) and ids_in(spark, "documents", db) == []
    assert tables.delete(spark, "documents", spark.createDataFrame([], "id long"), db) == []


def test_an_instance_is_read_from_its_partition(spark, db):
    tables.append(documents(spark, [(k, k % 40) for k in range(200)]), "documents", db)
    own = tables.read(spark, "documents", db, 7)
    assert sorted(r["id"] for r in own.collect()) == [7, 47, 87, 127, 167] and len(own.inputFiles()) < 30
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_sessions_keep_their_settings(spark, db):
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    tables.append_once(documents(spark, [(1, 1)]), "documents", "k", db)
    assert spark.conf.get(key) == before


def test_pages(spark):
    rows = spark.createDataFrame([(k * 7 % 1009, f"r{k}") for k in range(1009)], "id long, name string")
    index = paging.page_index(rows, range_rows=100)
    want = [r["id"] for r in rows.orderBy("id").collect()]
    assert index.ranges.count() == 11
    for skip, limit in ((0, 100), (250, 100), (995, 100), (2000, 5), (0, 0), (99, 1), (0, 1009)):
        got = paging.page(index, skip, limit)
        assert [r["id"] for r in got.collect()] == want[skip : skip + limit]
    plan = paging.page(index, 500, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and len(paging.page(index, 500, 20)._jdf.inputFiles()) >= 0
    assert index.rows.where(F.col("_range") == 5).rdd.getNumPartitions() <= 4
    assert [r["position"] for r in paging.positions(index).orderBy("id").collect()] == list(range(1009))
    assert paging.page(paging.page_index(rows.limit(0)), 0, 10).count() == 0


def test_a_deletion_writes_its_partitions_once(spark, db, monkeypatch):
    """No second copy is staged, whether rows stay in their tasks or move; partitions without a row left are gone, others whole."""
    tables.append_once(documents(spark, [(k, k % 7) for k in range(70)]), "documents", "first", db)
    for few, gone in ((1_000_000, 3), (0, 5)):
        monkeypatch.setattr(tables, "FEW_IDS", few, raising=False)
        with storage.made_tables() as paths:
            tables.delete(spark, "documents", spark.createDataFrame([(gone,)], "id long"), db, "instance_id")
        assert not [p for p in paths if "staged" in p]
    left = {(r["id"], r["instance_id"]) for r in tables.read(spark, "documents", db).collect()}
    assert left == {(k, k % 7) for k in range(70) if k % 7 not in (3, 5)}
    parts = {r["partition"].split("/")[0] for r in spark.sql(f"SHOW PARTITIONS {db}.documents").collect()}
    assert parts == {f"part={r['part']}" for r in spark.table(f"{db}.documents").select("part").distinct().collect()}
