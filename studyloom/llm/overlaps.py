"""Interval overlap join of sales with click sessions, by DuckDB's inequality range join (IEJoin) inside Arrow tasks.

Both sides become intervals of slots by client: clicks shrink to one row for each half hour before sessions are cut, so a
client's window has as many rows as its calendar has half hours; equal intervals of a client become one row that carries
how many sessions it stands for.  Intervals are dealt over tasks by a hash of the client and by shards of time, whose
bounds are quantiles of the starts; one that reaches into later shards is copied there, and a pair counts in the shard in
which the later of both starts.  In a task, clients lie behind one another on one axis, open ends stand at a sentinel at
the end of the client's stretch, and two inequalities on that axis are the whole join; pairs are classified and summed
where they are found.  Partial sums of the shards are merged by Spark and joined with the sales that have the interval.

A hot client is thus bounded by its calendar, not by its rows, and spread over the shards; the lines of a hot sale are
reduced before they are exchanged.  Nothing is broadcast and only the shards' bounds go to the driver.

Defined cases: rows without client, start or click time are ignored, as are lines without a sale or a time; clicks that
repeat a time are one moment, an error among them makes it one; each row of ``sales`` is a sale, also one that repeats an
id; sales without a pair give no row; times before 1970 have negative slots; empty tables give an empty result; other
columns are ignored.  Times are read as they stand if they have no zone, as instants if they have one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from studyloom.llm.shared import col, written

SECOND_US = 1_000_000
#: Longest pause in a session, and a slot.
GAP_US, SLOT_US = 1800 * SECOND_US, 6 * 3600 * SECOND_US
#: The slot of an open end: later than any date that Spark knows.
OPEN = 1 << 30
#: Shards of time, and intervals of both sides for each bucket of clients; a task joins what a shard has of them.
SHARDS, GROUP_ROWS = 8, 200_000
#: Relations by where the sale starts (earlier, equally, later) and ends.
RELATIONS = [["overlaps", "finished_by", "contains"], ["starts", "equals", "started_by"], ["during", "finishes", "overlapped_by"]]


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970; without a zone the clock's reading counts, whatever the session's zone."""
    at = col(name)
    if isinstance(df.schema[name].dataType, TimestampType):
        return F.unix_micros(at)
    seconds = F.unix_date(at.cast("date")).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60
    return seconds * SECOND_US + (F.date_part(F.lit("SECOND"), at) * SECOND_US).cast("long")


def slot(us: Column, size: int = SLOT_US) -> Column:
    """The slot that holds a time, rounded down before 1970 too; whole numbers throughout."""
    return F.call_function("div", us - F.pmod(us, F.lit(size)), F.lit(size))


def sessions(clicks: DataFrame, client_col: str = "client_id", ts_col: str = "ts", kind_col: str = "kind") -> DataFrame:
    """client, first_us, last_us and open: a row for each session."""
    own = clicks.where(col(client_col).isNotNull() & col(ts_col).isNotNull()).select(col(client_col).alias("client"), micros(clicks, ts_col).alias("us"), F.coalesce(col(kind_col) == "error", F.lit(False)).alias("error"))
    # times of one half hour always belong together
    last = F.max(F.struct("us", "error"))
    bins = own.groupBy("client", slot(F.col("us"), GAP_US).alias("bin")).agg(F.min("us").alias("first"), last.alias("last"))
    by_time = W.partitionBy("client").orderBy("bin")
    begins = F.coalesce(F.col("first") - F.lag("last.us").over(by_time) > GAP_US, F.lit(True))
    told = bins.withColumn("begins", begins.cast("int")).withColumn("k", F.sum("begins").over(by_time))
    return told.groupBy("client", "k").agg(F.min("first").alias("first_us"), F.max("last").alias("last")).select("client", "first_us", F.col("last.us").alias("last_us"), F.col("last.error").alias("open"))


def session_intervals(sessions: DataFrame) -> DataFrame:
    """client, s and e (slots), n and crc: a row for each different interval of a client."""
    e = F.when(F.col("open"), OPEN).otherwise(slot(F.col("last_us")))
    own = sessions.select("client", slot(F.col("first_us")).alias("s"), e.alias("e"), F.crc32(F.col("first_us").cast("string")).alias("crc"))
    return own.groupBy("client", "s", "e").agg(F.count("*").alias("n"), F.sum("crc").alias("crc"))


def sale_intervals(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """sale_id, client, s and e (slots): a row for each sale."""
    shipped = lines.where(F.col("sale_id").isNotNull() & F.col("shipped_at").isNotNull()).groupBy("sale_id").agg(F.max(micros(lines, "shipped_at")).alias("shipped_us"))
    own = sales.where(F.col("client_id").isNotNull() & F.col("sold_at").isNotNull()).select("sale_id", F.col("client_id").alias("client"), micros(sales, "sold_at").alias("us"), F.coalesce(F.col("status") == "open", F.lit(False)).alias("open"))
    end = F.when(F.col("open"), OPEN).otherwise(slot(F.greatest("us", "shipped_us")))  # greatest leaves nulls out
    return own.join(shipped, "sale_id", "left").select("sale_id", "client", slot(F.col("us")).alias("s"), end.alias("e"))


def shard_bounds(intervals: DataFrame, shards: int = SHARDS) -> list[int]:
    """First slots of the second and later shards: quantiles of the starts, so that a broken date doesn't stretch a shard."""
    at = intervals.agg(F.percentile_approx("s", [k / shards for k in range(1, shards)], 1000)).first()[0]
    return sorted(set(at or []))


def dealt(intervals: DataFrame, bounds: list[int], buckets: int) -> DataFrame:
    """Adds bucket, shard and own (it starts here), a row for each shard that the interval reaches."""

    def shard(x: Column) -> Column:
        return sum(((x >= b).cast("int") for b in bounds), F.lit(0))

    bucket = F.pmod(F.xxhash64("client"), F.lit(buckets)).cast("int")
    each = intervals.select("*", bucket.alias("bucket"), shard(F.col("s")).alias("first"), F.explode(F.sequence(shard(F.col("s")), shard(F.col("e")))).alias("shard"))
    return each.select(*intervals.columns, "bucket", "shard", (F.col("first") == F.col("shard")).alias("own"))


_CLASSED = "CASE " + " ".join(f"WHEN a.s {x} b.s AND a.t {y} b.t THEN {3 * i + j}" for i, x in enumerate("<=>") for j, y in enumerate("<=>")) + " END"
#: A client's stretch of the axis; slots of all dates that Spark knows, and the sentinel at its end.
STRETCH, BACK = 1 << 26, 1 << 25
_AXIS = f"""CREATE TEMP TABLE {{0}} AS SELECT i.*, k * {STRETCH} + i.s + {BACK} AS lo, CASE WHEN i.e = {OPEN} THEN (k + 1) * {STRETCH} - 1 ELSE k * {STRETCH} + i.e + {BACK} END AS hi, e AS t FROM {{0}}_rows i JOIN clients USING (client)"""
JOIN = f"""SELECT a.i, {_CLASSED} AS r, sum(CASE WHEN a.own OR b.own THEN b.n END)::BIGINT AS n_pairs,
  sum(CASE WHEN (a.own OR b.own) AND NOT (a.t = {OPEN} AND b.t = {OPEN}) THEN b.n * (least(a.t, b.t) - greatest(a.s, b.s) + 1) END)::BIGINT AS overlap_slots,
  sum(CASE WHEN a.own OR b.own THEN b.crc END)::BIGINT AS sessions_crc
FROM sales a JOIN sessions b ON a.lo <= b.hi AND b.lo <= a.hi GROUP BY ALL"""
OUT = "client {}, s long, e long, relation string, n_pairs long, overlap_slots long, sessions_crc long"


def range_join(sales: pa.Table, sessions: pa.Table, explain: bool = False) -> pa.Table | str:
    """Sums of the pairs of a group by sale interval and relation; one connection and one thread, as it runs in a task."""
    import duckdb

    sales = sales.append_column("i", pa.array(np.arange(sales.num_rows)))
    with duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""}) as con:
        con.execute("SET nested_loop_join_threshold = 0")
        con.execute("SET merge_join_threshold = 0")
        con.register("sales_rows", sales)
        con.register("sessions_rows", sessions)
        con.execute("CREATE TEMP TABLE clients AS SELECT client, row_number() OVER () AS k FROM (SELECT client FROM sales_rows INTERSECT SELECT client FROM sessions_rows)")
        con.execute(_AXIS.format("sales"))
        con.execute(_AXIS.format("sessions"))
        if explain:
            return con.execute("EXPLAIN " + JOIN).fetchall()[0][1]
        return con.sql(f"SELECT client, s, e, i.r, n_pairs, overlap_slots, sessions_crc FROM ({JOIN}) i JOIN sales ON sales.i = i.i WHERE n_pairs IS NOT NULL").to_arrow_table()


def overlap_classes(sales: DataFrame, sessions: DataFrame, bounds: list[int], buckets: int) -> DataFrame:
    """client, s, e, relation and the three sums, for each different interval of a client's sales."""
    names, client = [r for row in RELATIONS for r in row], sales.schema["client"].dataType

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        found = range_join(left.select(["client", "s", "e", "own"]), right.select(["client", "s", "e", "own", "n", "crc"]))
        relation = pa.array(names, pa.string()).take(found.column("r").cast(pa.int32()))
        return pa.table({"client": found.column("client").cast(left.schema.field("client").type), "s": found.column("s"), "e": found.column("e"), "relation": relation, **{c: found.column(c) for c in ("n_pairs", "overlap_slots", "sessions_crc")}})

    left, right = (dealt(x, bounds, buckets).groupBy("bucket", "shard") for x in (sales, sessions))
    parts = left.cogroup(right).applyInArrow(joined, OUT.format(client.simpleString()))
    return parts.groupBy("client", "s", "e", "relation").agg(*[F.sum(c).alias(c) for c in ("n_pairs", "overlap_slots", "sessions_crc")])


def overlaps(sales: DataFrame, lines: DataFrame, clicks: DataFrame, shards: int = SHARDS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """sale_id, relation, n_pairs, overlap_slots and sessions_crc for each sale and each relation that it has with sessions of its client."""
    sold, seen = written(sale_intervals(sales, lines), "sale-intervals"), written(session_intervals(sessions(clicks)), "session-intervals")
    bounds, buckets = shard_bounds(sold, shards), max(1, -(-(sold.count() + seen.count()) // group_rows))
    found = overlap_classes(sold.select("client", "s", "e").distinct(), seen, bounds, buckets)
    return sold.join(found, ["client", "s", "e"]).select("sale_id", "relation", "n_pairs", "overlap_slots", "sessions_crc")


def op12_overlap_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales, lines, clicks = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sales", "sale_lines", "clicks"))
    return overlaps(sales, lines, clicks)
