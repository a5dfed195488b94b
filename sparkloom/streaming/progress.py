"""Work on a stream of items that may stop anywhere: results are stored once, failures are kept apart, what is left is known."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.streaming.imports import stored_rows


def _without(df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``df`` whose key isn't in ``other``; null is a key like any other."""
    there = other.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(key)])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(key)])
    return df.join(there, same, "left_anti")


def _work(batch: DataFrame, batch_id: int, sink: str, key: list[str], generate: Callable[[DataFrame], DataFrame], like: DataFrame) -> None:
    fresh = batch.dropDuplicates(key)
    if batch_id:
        before = stored_rows(batch.sparkSession, sink, like).where(F.col("batch") < batch_id)
        fresh = _without(fresh, done(before), key)
    # a replay writes the same folder again, so a crash after the write and before the checkpoint changes nothing
    generate(fresh).select(*like.columns).write.mode("overwrite").parquet(f"{sink}/rows/batch={batch_id}")


def process(source: DataFrame, sink: str, key: list[str], generate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run what is in ``source`` now through ``generate``; all rows stored so far. Call it again to resume.

    ``generate`` adds the text column ``result``, null or blank where it failed. A key that has a result is not worked
    on again; one that failed is, once it comes again. Keys are taken to be alike in all columns.
    """
    like = generate(source)
    run = source.writeStream.foreachBatch(partial(_work, sink=sink, key=key, generate=generate, like=like))
    run.option("checkpointLocation", f"{sink}/progress").trigger(availableNow=True).start().awaitTermination()
    return stored_rows(source.sparkSession, sink, like)


def done(rows: DataFrame) -> DataFrame:
    """Rows with a result that is not blank."""
    return rows.where(F.trim("result") != "")


def failed(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that have been tried and have no result yet."""
    return _without(rows.select(*key).distinct(), done(rows), key)


def unfinished(items: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Items without a result."""
    return _without(items, done(rows), key)


def until_pause(rows: DataFrame, by: str, order: list[str], failed: Column, most: int = 3) -> DataFrame:
    """``rows`` that are worked on before a run pauses, with cursor (from 1) and state: it pauses at the last of ``most`` failures in a row."""
    w = Window.partitionBy(by).orderBy(*order)
    numbered = rows.withColumn("cursor", F.row_number().over(w)).withColumn("_bad", F.coalesce(failed, F.lit(False)))
    row = [F.lag("_bad", i).over(w) for i in range(1, most)]
    stop = F.col("_bad")
    for c in row:
        stop = stop & F.coalesce(c, F.lit(False))
    marked = numbered.withColumn("_stop", F.when(stop, F.col("cursor")))
    first = F.min("_stop").over(Window.partitionBy(by))
    kept = marked.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("cursor") <= F.col("_first")))
    return kept.withColumn("state", F.when(F.col("_first").isNull(), "idle").otherwise("paused")).drop("_bad", "_stop", "_first")
