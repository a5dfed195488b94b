"""A table in the shared folder that is changed by key: rows lie in buckets by a hash of the key, and a change rewrites the buckets of its keys only.

``data/<commit>/bucket=<b>`` holds what a commit wrote, ``log/<commit>`` tells for every bucket which commit's rows count. Readers
take the newest row of the log, so they see a commit whole or not at all, and a commit that is run again under its name replaces itself.
One writer at a time: two leave two rows in the log, of which one counts; their files are never mixed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

_LOG = "number long, name string, held map<int,string>"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems, so that it may lie anywhere."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)]


def same_key(left: DataFrame, right: DataFrame, key: list[str]) -> Column:
    """Equal keys, where null is a key like any other."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in key])


class KeyedStore:
    """Rows of ``schema`` under ``path``, any number for each ``key``, in ``buckets`` parts."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: StructType | str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _told(self, but: str | None = None):
        """The newest row of the log, leaving aside that of the commit ``but``."""
        try:
            log = self.spark.read.schema(_LOG).parquet(f"{self.path}/log/*")
            if but:
                log = log.where(F.col("name") != but)
            return log.orderBy(F.desc("number"), F.desc("name")).first()
        except AnalysisException:  # nothing there yet
            return None

    def commits(self) -> int:
        told = self._told()
        return told.number if told else 0

    def holds(self, name: str) -> bool:
        """Whether ``name`` is the newest commit."""
        told = self._told()
        return told is not None and told.name == name

    def read(self, buckets: list[int] | None = None, before: str | None = None) -> DataFrame:
        """All rows, or those of some buckets; as they were before the commit ``before``, if that is the newest."""
        told = self._told(before)
        held = told.held if told else {}
        paths = [f"{self.path}/data/{c}/bucket={b}" for b, c in sorted(held.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets that ``keys`` lie in: as many numbers as there are buckets, at most."""
        return sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())

    def of(self, keys: DataFrame, before: str | None = None) -> DataFrame:
        """The rows of ``keys``, read from their buckets only."""
        rows, some = self.read(self.touched(keys), before), keys.select(*self.key).distinct()
        return rows.join(some, same_key(rows, some, self.key), "left_semi")

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], name: str | None = None) -> list[int]:
        """Replace the rows of the buckets of ``keys`` by ``change`` of them; the buckets that were written."""
        name = name or uuid.uuid4().hex
        told, some = self._told(name), self.touched(keys)
        new = change(self.read(some, name)).select(*self.schema.names)
        out = f"{self.path}/data/{name}"
        new.withColumn("bucket", self._bucket()).repartition(max(1, len(some)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)
        held = {b: c for b, c in (told.held if told else {}).items() if b not in some}
        try:
            held |= {r[0]: name for r in self.spark.read.parquet(out).select(F.col("bucket").cast("int")).distinct().collect()}
        except AnalysisException:  # no rows are left
            pass
        row = [((told.number if told else 0) + 1, name, held)]
        self.spark.createDataFrame(row, _LOG).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/{name}")
        return some

    def upsert(self, rows: DataFrame, name: str | None = None) -> list[int]:
        """``rows`` in place of all rows of their keys."""
        keys = rows.select(*self.key).distinct()
        return self.rewrite(keys, lambda old: old.join(keys, same_key(old, keys, self.key), "left_anti").unionByName(rows.select(*old.columns)), name)

    def delete(self, keys: DataFrame, name: str | None = None) -> list[int]:
        """No rows of ``keys`` any more."""
        keys = keys.select(*self.key).distinct()
        return self.rewrite(keys, lambda old: old.join(keys, same_key(old, keys, self.key), "left_anti"), name)

    def vacuum(self) -> int:
        """Delete what no commit but the last two holds; how many commits' data went."""
        log = self.spark.read.schema(_LOG).parquet(f"{self.path}/log/*").orderBy(F.desc("number"), F.desc("name")).collect()
        kept = {c for row in log[:2] for c in row.held.values()}
        for row in log[2:]:
            remove(self.spark, f"{self.path}/log/{row.name}")
        gone = [c for c in children(self.spark, f"{self.path}/data") if c not in kept]
        for name in gone:
            remove(self.spark, f"{self.path}/data/{name}")
        return len(gone)
