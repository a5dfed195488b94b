"""Places and quantiles over any order, without a task that gets a whole table or group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.files import shared_folder


def running(df: DataFrame, order: list[str], weight: str | None = None, out: str = "before", rows: int = 1_000_000) -> DataFrame:
    """``df`` with the sum of ``weight`` (default: the number) of the rows before each one in ``order``, from 0.

    Rows are dealt by ranges of the order, of about ``rows`` each, and written with their range; sums inside a range and over ranges then
    agree, whatever task is run again. Rows that tie wholly lie in one range: aggregate them first, or end ``order`` with a key.
    """
    spark = df.sparkSession
    parts = max(1, -(-df.count() // rows))
    path = shared_folder(spark)
    dealt = df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    one = F.col(weight) if weight else F.lit(1).cast("long")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range").agg(F.sum(one).alias("_sum"))  # a row for each range
    starts = totals.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(before(Window.orderBy("_range"))), F.lit(0)).alias("_start"))
    own = F.coalesce(F.sum(one).over(before(Window.partitionBy("_range").orderBy(*order))), F.lit(0))
    return dealt.join(F.broadcast(starts), F.col("_range") == F.col("_r")).withColumn(out, F.col("_start") + own).drop("_range", "_r", "_start")


def medians(df: DataFrame, by: str, value: str, rows: int = 1_000_000) -> DataFrame:
    """by, median: exact, the mean of the two in the middle for an even number; nulls are left out, a group without values has no row.

    Equal values are counted before they are dealt out, so neither a huge group nor a frequent value fills a task.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running(counted, ["_by", "_v"], "_n", "_at", rows)
    group = placed.groupBy(F.col("_by").alias("_g")).agg(F.min("_at").alias("_first"), F.sum("_n").alias("_all"))
    placed = placed.join(group, F.col("_by").eqNullSafe(F.col("_g")))
    low, high = F.col("_first") + F.expr("(_all - 1) div 2"), F.col("_first") + F.expr("_all div 2")
    inside = lambda t: (F.col("_at") <= t) & (t < F.col("_at") + F.col("_n"))
    middle = placed.where(inside(low) | inside(high)).groupBy("_by").agg(((F.min("_v") + F.max("_v")) / 2).alias("median"))
    return middle.select(F.col("_by").alias(by), "median")
