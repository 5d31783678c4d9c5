"""Schemas of the four tables, where they are kept, and how their rows are added and changed.

Tables are partitioned by a hash of the instance, of which there may be any number, and by insert.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from studyloom.operators import crud
from studyloom.sources.storage import dropped, removed, written


def _s(*fields: tuple) -> StructType:
    return StructType([StructField(n, t(), null) for n, t, null in fields])


SCHEMAS = {
    "instances": _s(("id", LongType, False), ("name", StringType, False), ("description", StringType, True), ("color", StringType, True), ("created_at", TimestampNTZType, False), ("updated_at", TimestampNTZType, False), ("last_score", DoubleType, True)),
    "documents": _s(("id", LongType, False), ("instance_id", LongType, False), ("file_name", StringType, False), ("file_path", StringType, False), ("created_at", TimestampNTZType, True)),
    "qa_pairs": _s(("id", LongType, False), ("instance_id", LongType, False), ("question", StringType, False), ("answer", StringType, False), ("difficulty", StringType, False), ("topic", StringType, True), ("source_chunk", StringType, True), ("created_at", TimestampType, True)),
    "flashcards": _s(("id", LongType, False), ("instance_id", LongType, False), ("question", StringType, False), ("answer", StringType, False), ("ease_factor", DoubleType, True), ("interval", LongType, True), ("repetitions", IntegerType, True), ("next_review", TimestampNTZType, True), ("last_reviewed", TimestampNTZType, True), ("created_at", TimestampNTZType, True)),
}
#: Partitions by a hash of the instance, whatever the number of instances, so that a change rewrites a share of a table.
PARTS = 32
#: Partition columns behind the table's own: of a row's instance, and the insert that brought it.
PLACES = ("part", "batch")
#: A partition's folder in a file's path.
_PLACE = re.compile(r"/part=(\d+)/batch=([^/]+)/")
#: Ids up to which deletions are broadcast, 8 bytes each.
FEW_IDS = 1_000_000
#: The batch of rows that were appended without a key.
NO_KEY = "-"


def part_of(instance: Column) -> Column:
    return F.pmod(F.xxhash64(instance.cast("long")), F.lit(PARTS)).cast("int")


def _owner(name: str) -> Column:
    return F.col("id" if name == "instances" else "instance_id")


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Creates what isn't there yet."""
    for name, schema in SCHEMAS.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            spark.sql(f"CREATE TABLE {database}.{name} ({columns}, part int, batch string) USING parquet PARTITIONED BY (part, batch)")


def drop_tables(spark: SparkSession, database: str = "default") -> None:
    """Drops the tables and the records of their inserts."""
    for name in SCHEMAS:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
    removed(spark, [_commits(spark, database)])


def read(spark: SparkSession, name: str, database: str = "default", instance_id: int | None = None) -> DataFrame:
    """A table's own columns; of one instance from its partition alone."""
    own = spark.table(f"{database}.{name}")
    if instance_id is not None:
        own = own.where((F.col("part") == part_of(F.lit(instance_id))) & (_owner(name) == F.lit(instance_id)))
    return own.drop(*PLACES)


def _placed(df: DataFrame, name: str, database: str, batch: str) -> DataFrame:
    own = df.select(*SCHEMAS[name].names).withColumns({"part": part_of(_owner(name)), "batch": F.lit(batch)})
    return own.hint("rebalance", "part")  # few files for a partition, and several tasks for a large one


def append(df: DataFrame, name: str, database: str = "default") -> None:
    """Adds rows; columns are put in the table's order by name."""
    _placed(df, name, database, NO_KEY).write.mode("append").insertInto(f"{database}.{name}")


@contextlib.contextmanager
def _dynamic(spark: SparkSession) -> Iterator[None]:
    """Overwriting replaces the partitions that the new rows have, and no other."""
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _commits(spark: SparkSession, database: str) -> str:
    return spark.catalog.getDatabase(database).locationUri.rstrip("/") + "/_commits"


def append_once(df: DataFrame, name: str, key: str, database: str = "default") -> bool:
    """Adds the rows of an insert that may be tried again; False if an insert of this key is in the table already.

    The rows go to partitions of their own, which a second try replaces, and a record is created when they are whole; its
    creation is atomic.  Between the two a reader may see rows that a later try will bring again, never both.
    """
    spark, batch = df.sparkSession, hashlib.sha256(key.encode()).hexdigest()[:32]
    context = spark.sparkContext
    record = context._jvm.org.apache.hadoop.fs.Path(f"{_commits(spark, database)}/{name}-{batch}")
    system = record.getFileSystem(context._jsc.hadoopConfiguration())
    if system.exists(record):
        return False
    spark.sql(f"ALTER TABLE {database}.{name} DROP IF EXISTS PARTITION (batch = '{batch}')")
    with _dynamic(spark):
        _placed(df, name, database, batch).write.mode("overwrite").insertInto(f"{database}.{name}")
    system.create(record, False).close()
    return True


def parts_of(spark: SparkSession, name: str, ids: DataFrame, database: str = "default", by: str = "id") -> list[int]:
    """The partitions that hold rows whose ``by`` is among the ids (column id); PARTS at most."""
    if by == "instance_id" or name == "instances":
        found = ids.select(part_of(F.col("id")).alias("part"))
    else:
        found = spark.table(f"{database}.{name}").join(ids.select(F.col("id").alias("_id")), F.col(by) == F.col("_id"), "left_semi").select("part")
    return sorted(r["part"] for r in found.distinct().collect())


def rewrite(spark: SparkSession, name: str, parts: list[int], change: Callable[[DataFrame], DataFrame], database: str = "default", moved: bool = True) -> None:
    """Puts ``change`` of some partitions' rows in their place; the files of all others stay as they are.

    The new rows are written aside by the dynamic overwrite, which swaps them in, a partition at a time, when they are whole.
    A change that has the same result when it is applied again, as patches and deletions have, can be repeated after a
    failure.  ``moved`` says that ``change`` may send rows to other tasks; else each task's rows stay together, and with them
    the partition's files.
    """
    if not parts:
        return
    table = f"{database}.{name}"
    own = spark.table(table).where(F.col("part").isin(parts))
    before = set(own.inputFiles())
    made = change(own).select(*own.columns)
    with _dynamic(spark):
        (made.hint("rebalance", *PLACES) if moved else made).write.mode("overwrite").insertInto(table)
    spark.catalog.refreshTable(table)
    kept = {m.groups() for f in before.intersection(spark.table(table).inputFiles()) if (m := _PLACE.search(f)) and int(m[1]) in parts}
    for part, batch in sorted(kept):  # no row was left to put in these files' place
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (part = {part}, batch = '{batch}')")


def patch(spark: SparkSession, name: str, patches: DataFrame, fields: Mapping[str, str], database: str = "default") -> list[int]:
    """Applies :func:`crud.patched` to a stored table; returns the partitions that were rewritten."""
    held = written(patches, "patches")
    parts = parts_of(spark, name, held, database)
    rewrite(spark, name, parts, lambda rows: crud.patched(rows, held, fields), database)
    dropped(held)
    return parts


def delete(spark: SparkSession, name: str, ids: DataFrame, database: str = "default", by: str = "id") -> list[int]:
    """Deletes the stored rows whose ``by`` is among the ids; returns the partitions that were rewritten."""
    held = written(ids.select("id").distinct(), "deleted")
    parts = parts_of(spark, name, held, database, by)
    few = held.count() <= FEW_IDS
    rewrite(spark, name, parts, lambda rows: crud.without(rows, F.broadcast(held) if few else held, by), database, moved=not few)
    dropped(held)
    return parts


def delete_instances(spark: SparkSession, ids: DataFrame, database: str = "default") -> None:
    """Deletes instances with all that belongs to them; what belongs to them goes first, so that a failure leaves no orphan."""
    for name in ("flashcards", "qa_pairs", "documents"):
        delete(spark, name, ids, database, "instance_id")
    delete(spark, "instances", ids, database)


def read_jdbc(spark: SparkSession, url: str, name: str, partitions: int = 16, bounds: tuple[int, int] = (0, 1 << 31), **options: str) -> DataFrame:
    """A table of a relational store, read in ranges of its id at once."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn="id", lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions), **options)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, name: str, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=name, **options).mode("append").save()
