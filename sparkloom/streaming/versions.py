"""Import into a store with states: what a batch brings is judged by what is stored, in the buckets of its own paths and contents.

Versions of a path and contents by digest are two keyed stores. A batch is judged first, its outcome written, then contents and
last versions take it up; a batch that is run again after a stop at any point finds the stores as they were before it and
writes the same once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.sources.keyed import KeyedStore, same_key


class ImportStore:
    """Versions of paths. ``schema`` has the columns of the imports: ``path`` columns, ``order`` columns, ``content`` (text) and the boolean ``done``; not the names that outcomes have (version, status, content_id, supersedes, duplicate_of, hash, ok, is_new, first_path)."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, path: list[str], order: list[str], content: str = "content", done: str = "done", buckets: int = 64):
        self.spark, self.folder, self.path, self.order, self.content, self.done = spark, folder, path, order, content, done
        self.given = StructType.fromDDL(schema)
        own = ", ".join(f"`{c}` {self.given[c].dataType.simpleString()}" for c in [*path, *order])
        self.versions = KeyedStore(spark, f"{folder}/versions", path, f"{own}, version int, hash string, ok boolean, content_id string, supersedes string", buckets)
        self.contents = KeyedStore(spark, f"{folder}/contents", ["hash"], f"hash string, {content} string, first_path string, versions long", buckets)

    def judged(self, batch: DataFrame, name: str) -> DataFrame:
        """``batch`` with version, status, content_id, supersedes and duplicate_of, as ``import_states`` gives them for all imports so far."""
        hashed = F.sha2(F.coalesce(self.content, F.lit("")).cast("binary"), 256)
        told = F.when(F.col(self.content).isNull(), F.lit("null")).otherwise(hashed)  # a null content is one of its own
        rows = batch.select(*self.given.names, told.alias("hash"), F.coalesce(self.done, F.lit(False)).alias("ok"), F.concat_ws("/", *self.path).alias("_path"), F.lit(1).alias("_late"))
        stored = self.versions.of(rows, name)
        last = Window.partitionBy(*self.path).orderBy(F.desc("version"))
        heads = stored.withColumn("_i", F.row_number().over(last)).where("_i = 1").select(*self.path, *self.order, "hash", "ok", "version", "content_id", "supersedes", F.lit(0).alias("_late"))
        w = Window.partitionBy(*self.path).orderBy("_late", *self.order)
        all_rows = rows.unionByName(heads, allowMissingColumns=True)
        fresh = F.lag("hash").over(w).isNull() | (F.lag("hash").over(w) != F.col("hash"))
        all_rows = all_rows.withColumn("_new", (F.col("_late") == 1) & fresh)
        all_rows = all_rows.withColumn("version", F.sum(F.when(F.col("_late") == 0, F.col("version")).otherwise(F.col("_new").cast("int"))).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
        made = F.substring(F.sha2(F.concat(F.when(F.col("hash") == "null", hashed).otherwise(F.col("hash")), F.lit("\0"), "_path").cast("binary"), 256), 1, 24)
        all_rows = all_rows.withColumn("content_id", F.coalesce("content_id", made))
        before = F.when(F.col("_new"), F.lag("content_id").over(w)).when(F.col("_late") == 0, F.col("supersedes"))
        inside = Window.partitionBy(*self.path, "version").orderBy("_late", *self.order)
        all_rows = all_rows.withColumn("_before", before).withColumn("supersedes", F.first("_before").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        earlier = F.coalesce(F.max(F.col("ok").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
        status = F.when(earlier, "unchanged").when(~F.col("ok"), "failed").when(~F.col("_new"), "retried").when(F.col("version") > 1, "superseding").otherwise("new")
        out = all_rows.withColumn("status", status).where("_late = 1")
        known = self.contents.of(rows.select("hash"), name).select(F.col("hash").alias("_h"), F.col("first_path").alias("_known"))
        first = rows.groupBy(F.col("hash").alias("_g")).agg(F.min(F.struct(*self.order, "_path")).alias("_f")).select("_g", F.col("_f")["_path"].alias("_first"))
        out = out.join(first, F.col("hash") == F.col("_g")).join(known, F.col("hash") == F.col("_h"), "left").withColumn("_first", F.coalesce("_known", "_first"))
        return out.select(*self.given.names, "version", "status", "content_id", "supersedes", F.when(F.col("_first") != F.col("_path"), F.col("_first")).alias("duplicate_of"), "hash", "ok", F.col("_new").alias("is_new"), F.col("_first").alias("first_path"))

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """One batch of a stream; one that has been taken up whole is passed over."""
        name = f"batch-{batch_id}"
        if self.versions.holds(name):
            return
        judged = self.judged(batch, name)
        folder = f"{self.folder}/rows/batch={batch_id}"
        judged.write.mode("overwrite").parquet(folder)
        judged = self.spark.read.schema(judged.schema).parquet(folder)
        self._count(judged.where("is_new").groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.first(self.content).alias(self.content), F.first("first_path").alias("first_path")), name)
        newest = judged.groupBy(*self.path, "version").agg(F.max(F.struct(*self.order)).alias("o"), F.first("hash").alias("hash"), F.max("ok").alias("ok"), F.first("content_id").alias("content_id"), F.first("supersedes").alias("supersedes"))
        self.versions.rewrite(judged.select(*self.path).distinct(), lambda old: self._grown(old, newest.select(*self.path, "o.*", "version", "hash", "ok", "content_id", "supersedes")), name)

    def _grown(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Stored versions and those of a batch; one that is in both has what both know."""
        both = old.unionByName(new)
        rest = [F.first(c).alias(c) for c in ("hash", "content_id", "supersedes")]
        return both.groupBy(*self.path, "version").agg(F.max(F.struct(*self.order)).alias("o"), F.max("ok").alias("ok"), *rest).select(*self.path, "o.*", "version", "hash", "ok", "content_id", "supersedes")

    def _count(self, changes: DataFrame, name: str) -> None:
        """Add ``n`` versions to each content of ``changes(hash, n, content, first_path)``; those that no version holds any more go."""

        def change(old: DataFrame) -> DataFrame:
            c = changes.select(F.col("hash").alias("_h"), "n", F.col(self.content).alias("_c"), F.col("first_path").alias("_f"))
            met = old.join(c, F.col("hash") == F.col("_h"), "full")
            met = met.select(F.coalesce("hash", "_h").alias("hash"), F.coalesce(self.content, "_c").alias(self.content), F.coalesce("first_path", "_f").alias("first_path"), (F.coalesce("versions", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("versions"))
            return met.where("versions > 0")

        self.contents.rewrite(changes.select("hash"), change, name)

    def run(self, source: DataFrame) -> DataFrame:
        """Take up what the stream ``source`` has now; all outcomes so far. Call it again to resume."""
        query = source.select(*self.given.names).writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.outcomes()

    def outcomes(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/rows").parquet(f"{self.folder}/rows")

    def current(self) -> DataFrame:
        """The newest version of each path."""
        w = Window.partitionBy(*self.path).orderBy(F.desc("version"))
        return self.versions.read().withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")

    def forget(self, chosen: DataFrame, name: str) -> DataFrame:
        """Delete every version of the paths of ``chosen``, and contents that then no version holds; the digests of those.

        A deletion stopped half way is finished by another call under the same ``name``.
        """
        paths = chosen.select(*self.path).distinct()
        gone = self.versions.of(paths, name)
        folder = f"{self.folder}/deleted/{name}"
        if not self.versions.holds(name):
            gone.groupBy("hash").agg((-F.count(F.lit(1))).alias("n")).write.mode("overwrite").parquet(folder)
        lost = self.spark.read.schema("hash string, n long").parquet(folder)
        self._count(lost.withColumn(self.content, F.lit(None).cast("string")).withColumn("first_path", F.lit(None).cast("string")), name)
        self.versions.delete(paths, name)
        left = self.contents.of(lost)
        return lost.join(left, same_key(lost, left, ["hash"]), "left_anti").select("hash")
