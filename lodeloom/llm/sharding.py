"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable key goes to one of n shards by a short pseudo-random walk; no ring table is kept, and with
one more shard only the fraction 1/(n+1) of the keys moves, all of it into the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeloom.llm.common import held, utf8_crc32

#: Sub-ranges that the rows of a shard are numbered in, each by a task of its own.
SLOT_BUCKETS = 1024
#: Copies of a row that are written out together; more are dealt out in runs of so many.
RUN = 10_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of each 64-bit key; vectorised over the keys."""
    if shards < 1:
        raise ValueError("there must be one shard at least")
    state = np.asarray(keys).astype(np.int64).view(np.uint64).copy()
    at, ahead = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = ahead[live]
        s = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        state[live] = s
        step = float(1 << 31) / ((s >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[live] = ((at[live] + 1) * step).astype(np.int64)
        live = live[ahead[live] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Column form of jump_hash. A null key is hashed as 0."""

    @F.pandas_udf(T.IntegerType())
    def jump(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(np.int64), shards))

    return jump(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def assign_shards(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into a shard that only its key and the shard count decide, and number the rows of each shard.

    Returns the key, size, text_crc32, law, shard, slot, grown_shard. Slots run from 0 without gaps in the order
    (sub-range, key, text_crc32, size), nulls first. A null key is hashed as 0, a null text has no bytes; wholly equal
    rows get neighbouring slots, in no particular order. Other columns of docs are ignored; an empty table gives none.

    Equal rows are counted before the shuffle, and the sub-range depends on the key and on the text, so neither a hot
    key nor a hot text meets in one task; copies of one row beyond RUN are dealt out in runs. Offsets come from
    shards x SLOT_BUCKETS counts. What is known of each distinct row is held, so that it is hashed once.
    """
    rows = docs.select(F.col(key).alias("key"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), utf8_crc32(F.col(text)).alias("text_crc32"))
    groups = rows.groupBy("key", "size", "text_crc32").agg(F.count("*").alias("n"))
    groups = groups.withColumn("shard", shard_of(F.col("key"), shards)).withColumn("grown_shard", shard_of(F.col("key"), shards + 1))
    mixed = F.coalesce(F.col("key").cast("long"), F.lit(0).cast("long")).bitwiseXOR(F.col("text_crc32"))
    groups = held(groups.withColumn("bucket", F.pmod(mixed, F.lit(SLOT_BUCKETS))), "shard-rows")

    by_bucket = groups.groupBy("shard", "bucket").agg(F.sum("n").alias("in_bucket"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.select("shard", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("bucket_start"))
    within = Window.partitionBy("shard", "bucket").orderBy(F.col("key").asc_nulls_first(), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("group_start", F.coalesce(F.sum("n").over(within), F.lit(0)))
    # starts has one row a sub-range, shards * SLOT_BUCKETS at most
    placed = placed.join(F.broadcast(starts), ["shard", "bucket"])
    runs = placed.where(F.col("n") > RUN).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))).alias("from")).repartition("key", "from")
    last = F.least(F.col("from") + RUN, F.col("n")) - 1
    every = placed.where(F.col("n") <= RUN).withColumn("from", F.lit(0).cast("long")).unionByName(runs)
    each = F.explode(F.sequence("from", last)).alias("copy")
    return every.select("*", each).select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("bucket_start") + F.col("group_start") + F.col("copy")).cast("long").alias("slot"),
        "grown_shard",
    )
