"""Incremental import: new files are taken up once, rows whose key is stored already are skipped, replays change nothing."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _store(batch: DataFrame, batch_id: int, sink: str, key: list[str], order: list[str], made: Callable[[DataFrame], DataFrame] | None = None) -> None:
    batch = made(batch) if made else batch
    rest = [c for c in batch.columns if c not in key and c not in order]
    first = batch.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("r")).select(*key, "r.*")
    if batch_id:
        stored = stored_rows(batch.sparkSession, sink, first).where(F.col("batch") < batch_id)
        before = stored.select(*[F.col(c).alias(f"stored_{i}") for i, c in enumerate(key)])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"stored_{i}")) for i, c in enumerate(key)])
        first = first.join(before, same, "left_anti")  # a null key is a key: it comes in once
    first.write.mode("overwrite").parquet(f"{sink}/rows/batch={batch_id}")  # a replay of a batch writes the same folder again


def stored_rows(spark: SparkSession, sink: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.select(*like.columns).withColumn("batch", F.lit(0)).schema).parquet(f"{sink}/rows")


def import_new(source: DataFrame, sink: str, key: list[str], order: list[str], made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run the stream ``source`` until what is there now is stored under ``sink``; the rows stored, with their batch. Call it again to resume.

    ``made`` turns each batch into the rows that are stored.
    """
    run = source.writeStream.foreachBatch(partial(_store, sink=sink, key=key, order=order, made=made)).option("checkpointLocation", f"{sink}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return stored_rows(source.sparkSession, sink, made(source) if made else source)
