"""Numbering rows without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def hash_bucket(*columns: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets))


def numbered(rows: DataFrame, bucket: Column, order: list[Column], within: list[str] | None = None, name: str = "nth") -> DataFrame:
    """rows with their number, from 0 and without gaps, in the order of (bucket, order); anew for each value of within.

    Rows are numbered in their bucket, and buckets begin where those before them end, so that the largest bucket bounds a task.
    """
    keys, dealt = within or [], rows.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    starts = dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    return dealt.withColumn("_nth", nth).join(starts, [*keys, "_bucket"]).withColumn(name, (F.col("_start") + F.col("_nth")).cast("long")).drop("_bucket", "_nth", "_start")
