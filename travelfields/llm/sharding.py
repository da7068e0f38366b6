"""Sharding by a permutation-filled lookup table.

Each shard ranks the slots of a prime-sized table by its own permutation; the shards take
turns, each claiming the first slot of its ranking that is still free. Every shard gets
the same number of slots to within one, and adding or removing a shard moves few slots."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
MAX_TABLE_SIZE = 1_048_583


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def slot_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index into shards. size must be prime, above the number of shards, and at most
    MAX_TABLE_SIZE, which bounds what place() broadcasts."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be present and distinct")
    if not _is_prime(size) or not len(shards) < size <= MAX_TABLE_SIZE:
        raise ValueError("size must be a prime above the number of shards and within MAX_TABLE_SIZE")
    digest = [hashlib.sha256(s.encode()).digest() for s in shards]
    offset = [int.from_bytes(d[:8], "big") % size for d in digest]
    skip = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 for d in digest]
    step, table, free = [0] * len(shards), [-1] * size, size
    while free:
        for i in range(len(shards)):
            while table[slot := (offset[i] + step[i] * skip[i]) % size] >= 0:
                step[i] += 1
            table[slot] = i
            step[i] += 1
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: 60 bits of its MD5 modulo size. A null key counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size


def slot_frame(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard, shard_name), size rows."""
    claimed = F.split(F.lit(",".join(map(str, slot_table(shards, size)))), ",")
    names = F.array(*(F.lit(s) for s in shards))
    return (
        spark.range(1).select(F.posexplode(claimed).alias("slot", "claim"))
        .select(F.col("slot").cast("long").alias("slot"), F.col("claim").cast("int").alias("shard"))
        .withColumn("shard_name", F.element_at(names, F.col("shard") + 1))
    )


def place(df: DataFrame, key: Column, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """df with shard_slot, shard and shard_name. Each row is placed on its own, without a shuffle,
    by one lookup in the broadcast table of at most MAX_TABLE_SIZE rows. Repeated rows go to the
    same shard; null keys share one; an empty df stays empty. Columns of df of these three
    names are replaced."""
    kept = [c for c in df.columns if c not in ("shard_slot", "shard", "shard_name")]
    base = df.select(*(F.col(f"`{c}`") for c in kept), slot_of(key, size).alias("shard_slot"))
    table = slot_frame(df.sparkSession, shards, size).withColumnRenamed("slot", "shard_slot")
    return base.join(F.broadcast(table), "shard_slot").select(*(F.col(f"`{c}`") for c in kept), "shard_slot", "shard", "shard_name")
