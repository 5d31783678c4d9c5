"""Shard placement by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size.  In turns, each shard claims its
most wanted slot still free, until the table is full; so shards own nearly equal shares, and few slots change hands
when a shard joins or leaves.  A key's slot is its hash modulo the table size, and the table, whose size is a
parameter, is broadcast: placement is one hash and one lookup, with no shuffle whatever the keys' skew.

DataFrame functions only; the table itself is filled while the plan is made, in time that no input changes.

Defined cases: a null key is placed as the empty string; repeated rows go to the same shard; an empty table gives an
empty result; other columns are kept, those named slot or shard replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm.shared import col

#: Slots (a prime, a hundred times the shards or more) and shards of the registered query.
TABLE_SIZE, SHARDS = 2039, tuple(f"shard-{k:02d}" for k in range(16))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def word(text: str, at: int) -> int:
    """32 bits of the text's MD5."""
    return int(hashlib.md5(text.encode()).hexdigest()[at : at + 8], 16)


def lookup_table(shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """The shard's place in ``shards`` for each slot.  A shard prefers offset, offset + skip, offset + 2 skip, ... modulo the size."""
    if not is_prime(size) or not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("the size must be a prime no less than the number of shards, and shards must differ")
    at = [word(s, 0) % size for s in shards]
    skip = [word(s, 8) % (size - 1) + 1 for s in shards]
    table, filled = [-1] * size, 0
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            table[at[k]] = k
            filled += 1
            if filled == size:
                return table


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key: the first 32 bits of its MD5 modulo the table size."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key_col: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """Adds slot and shard."""
    table = df.sparkSession.createDataFrame([(k, shards[s]) for k, s in enumerate(lookup_table(shards, size))], "_slot int, shard string")
    kept = df.select(*[col(c) for c in df.columns if c.lower() not in ("slot", "shard")], slot_of(col(key_col), size).alias("slot"))
    return kept.join(F.broadcast(table), kept["slot"] == table["_slot"]).drop(table["_slot"])  # as many rows as the parameter says


def op9_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")))
