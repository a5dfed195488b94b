"""What several operators share: tables in the shared folder, spread-out ranks, connected components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.files import shared_folder

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

def materialize(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: this cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch, column: str, rows: int = 500, size: int = 8 << 20):
    """Parts of an Arrow batch of at most ``rows`` rows and, but for single longer ones, ``size`` bytes in ``column``."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        until = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        until = max(at + 1, min(until, at + rows))
        yield batch.slice(at, until - at)
        at = until


def released(run):
    """``run`` over the batches of a task; what it held then goes back to the system, as Python workers live on beside the next stages."""

    def task(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return task


def row_keys() -> list[Column]:
    """k1, k2: digests of ``text``; with the doc_id they tell rows apart that share it, or have none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    empty = F.col("text").isNull()
    return [F.xxhash64(text, empty).alias("k1"), F.xxhash64(F.lit(17), text, empty).alias("k2")]


def root_of(count: int, least: int = 16) -> int:
    """Buckets for two-level ranks: their number and their size both grow as the square root of the rows."""
    return max(least, math.isqrt(max(0, count)))


def bucket_of(n: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n))


def spread_rank(df: DataFrame, key: str, order: list[str], buckets: int, weight: str | None = None, out: str = "rank") -> DataFrame:
    """Running sum of ``weight`` (default 1) within ``key``, from 0, without one task for a hot key.

    Rows are dealt to buckets within their key; the sum before a bucket comes from a window over bucket totals
    (``buckets`` rows a key at most), the sum before a row from a window inside its bucket. Rows that tie in
    ``order`` must be alike in what matters to the caller. A null key is a key of its own.
    """
    one = F.col(weight) if weight else F.lit(1).cast("long")
    df = df.withColumn("_bucket", bucket_of(buckets, *[F.col(c) for c in order]))
    totals = df.groupBy(key, "_bucket").agg(F.sum(one).alias("_sum"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(totals, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(out, F.col("_before") + F.coalesce(F.sum(one).over(own), F.lit(0))).drop("_bucket", "_b", "_key", "_before")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (node, component), component the smallest node; linked nodes only.

    Each round hooks every node that has a smaller neighbour onto the smallest one, follows the hooks to their
    roots by pointer jumping, and contracts the edges to roots; contracted edges vanish or at least halve the
    roots left. All of it is joins and minima over tables in the shared folder: no node's neighbours are gathered.
    """
    small, large = F.least("a", "b"), F.greatest("a", "b")
    live = materialize(edges.where("a <> b").select(small.alias("b"), large.alias("a")).distinct())
    result = None
    while not live.isEmpty():
        hook = materialize(live.groupBy("a").agg(F.min("b").alias("root")))
        while True:
            up = hook.select(F.col("a").alias("_a"), F.col("root").alias("_up"))
            if hook.join(up, F.col("root") == F.col("_a"), "left_semi").isEmpty():
                break
            hook = materialize(hook.join(up, F.col("root") == F.col("_a"), "left").select("a", F.coalesce("_up", "root").alias("root")))
        a, b = hook.select(F.col("a").alias("_a"), F.col("root").alias("_ra")), hook.select(F.col("a").alias("_b"), F.col("root").alias("_rb"))
        live = live.join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b"), "left")
        live = live.select(F.col("_ra").alias("a"), F.coalesce("_rb", "b").alias("b")).where("a <> b")
        live = materialize(live.select(small.alias("b"), large.alias("a")).distinct())
        if result is None:
            result = hook
        else:
            old = result.join(a, F.col("root") == F.col("_a"), "left").select("a", F.coalesce("_ra", "root").alias("root"))
            result = materialize(old.unionByName(hook))
    if result is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    roots = result.select(F.col("root").alias("a"), "root").distinct()
    return result.unionByName(roots).select(F.col("a").alias("node"), F.col("root").alias("component"))
