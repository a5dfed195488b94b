"""An inverted index that is kept: refreshing it splits only texts that are new or changed, and rewrites only what they touch.

Objects with their length and digest lie in a keyed store, which says what segment holds an object's postings. A segment is what one
refresh added: postings of its objects, in buckets by word. Postings of a segment that an object has left are dead: tombstones
name (object, segment) until ``compact`` folds all segments into one. Counts of objects and words of a part are kept as differences by
refresh. A search reads the buckets of the words that are asked for, and document frequencies come from the same live postings, so scores
are those of an index built anew. What a refresh writes has its number for a name, and counts once it is told: one that
stopped half way is written over by the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from sparkloom.functions.text import tokens
from sparkloom.operators.search import B, K1, row_postings
from sparkloom.sources.files import shared_folder
from sparkloom.sources.keyed import KeyedStore, children, remove

_TOLD = "number long, name string, segments array<string>, changed long"
#: Tombstones that are sent to every task (some 60 bytes each).
BROADCAST_DEAD = 500_000
#: Keys of new texts, of texts that share their key, and counts of words by part, that are sent to every task.
BROADCAST_KEYS = 500_000


class KeptIndex:
    """``part`` (text) and ``key`` (long) name an object; ``split`` gives a text's words. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, part: str = "source", key: str = "doc_id", buckets: int = 64, split: Callable = tokens):
        self.spark, self.path, self.part, self.key, self.buckets, self.split = spark, path, part, key, buckets, split
        self.objects = KeyedStore(spark, f"{path}/objects", [part, key], f"{part} string, {key} long, dl long, digest long, digest2 long, segment string", buckets)
        self.rows = StructType.fromDDL(f"{part} string, {key} long, token string, tf long, dl long, segment string, bucket int")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int")

    def told(self):
        """The newest refresh; none before the first one."""
        try:
            return self.spark.read.schema(_TOLD).parquet(f"{self.path}/told/*").orderBy(F.desc("number"), F.desc("name")).first()
        except AnalysisException:
            return None

    def _side(self, folder: str, names: list[str], schema: str) -> DataFrame:
        paths = [f"{self.path}/{folder}/{n}" for n in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _next(self):
        """(what was told last, the number and name of what comes next)."""
        told = self.told()
        number = (told.number if told else 0) + 1
        return told, number, f"refresh-{number}"

    def refresh(self, objects: DataFrame, most: int = 8) -> int:
        """Bring the index to ``objects(part, key, text)``: how many were new, changed or gone. Texts of null count as absent; of rows that share part and key one text counts.

        Beyond ``most`` segments all are folded into one.
        """
        told, number, name = self._next()
        text = self._one_each(objects.where("text is not null").select(F.col(self.part).cast("string").alias(self.part), F.col(self.key).cast("long").alias(self.key), "text"), f"shared/{name}")
        # two digests of 64 bits: texts are only read whole where they are new
        now = text.select(self.part, self.key, F.xxhash64("text").alias("_d1"), F.xxhash64(F.lit(1), "text").alias("_d2"))
        old = self.objects.read(before=name).toDF("_p", "_k", "dl", "digest", "digest2", "segment")
        same = F.col(self.part).eqNullSafe(F.col("_p")) & F.col(self.key).eqNullSafe(F.col("_k"))
        met = now.withColumn("_here", F.lit(True)).join(old.withColumn("_there", F.lit(True)), same, "full")
        gone = F.col("_here").isNull()
        differs = F.col("_there").isNull() | (F.col("digest") != F.col("_d1")) | (F.col("digest2") != F.col("_d2"))
        where = lambda c, o: F.when(gone, F.col(o)).otherwise(F.col(c)).alias(c)
        changes = met.where(gone | differs).select(where(self.part, "_p"), where(self.key, "_k"), "_here", "_d1", "_d2", F.col("dl").alias("was"), "segment")
        changes = self._written(changes, f"changes/{name}")
        changed = changes.count()
        if told and not changed:
            return 0
        own = F.col(self.part).eqNullSafe(F.col("_p")) & F.col(self.key).eqNullSafe(F.col("_k"))
        some = text  # at first all are new
        if told:
            fresh = changes.where("_here").select(self.part, self.key).toDF("_p", "_k")
            some = text.join(F.broadcast(fresh) if changed <= BROADCAST_KEYS else fresh, own, "left_semi")
        # each task writes its postings to their buckets: they outweigh the texts, and would once more as a shuffle
        split = row_postings(some, self.part, self.key, split=self.split).withColumn("segment", F.lit(name)).withColumn("bucket", self._bucket())
        split.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/segments/{name}")
        held = self.spark.read.schema(self.rows).parquet(f"{self.path}/segments/{name}")
        lengths = held.groupBy(F.col(self.part).alias("_p"), F.col(self.key).alias("_k")).agg(F.max("dl").alias("dl"))
        met = changes.join(lengths, own, "left").withColumn("dl", F.when(F.col("_here"), F.coalesce("dl", F.lit(0).cast("long"))))
        met = self._written(met.select(self.part, self.key, "_here", "dl", "was", "_d1", "_d2", "segment"), f"met/{name}")
        # what a part gains and loses in objects and words
        sign = F.col("_here").isNotNull().cast("long") - F.col("was").isNotNull().cast("long")
        gain = met.groupBy(self.part).agg(F.sum(sign).alias("n"), F.sum(F.coalesce("dl", F.lit(0)) - F.coalesce("was", F.lit(0))).alias("words"))
        gain.write.mode("overwrite").parquet(f"{self.path}/sizes/{name}")
        met.where("segment is not null").select(self.part, self.key, "segment").write.mode("overwrite").parquet(f"{self.path}/dead/{name}")
        rows = met.where("_here").select(self.part, self.key, "dl", F.col("_d1").alias("digest"), F.col("_d2").alias("digest2"), F.lit(name).alias("segment"))
        keys = met.select(self.part, self.key)

        def change(before: DataFrame) -> DataFrame:
            k = keys.toDF("_p", "_k")
            return before.join(k, F.col(self.part).eqNullSafe(F.col("_p")) & F.col(self.key).eqNullSafe(F.col("_k")), "left_anti").unionByName(rows)

        self.objects.rewrite(keys, change, name)
        segments = [*(told.segments if told else []), name]
        self._tell(number, name, segments, changed)
        if len(segments) > most:
            self.compact()
        return changed

    def _one_each(self, objects: DataFrame, folder: str) -> DataFrame:
        """part, key, text: one row for each object, without a shuffle of texts but those of rows that share part and key."""
        by = [F.col(self.part).alias("_p"), F.col(self.key).alias("_k")]
        shared = self._written(objects.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_p", "_k"), folder)
        n = shared.count()
        if not n:
            return objects
        shared = F.broadcast(shared) if n <= BROADCAST_KEYS else shared
        same = F.col(self.part).eqNullSafe(F.col("_p")) & F.col(self.key).eqNullSafe(F.col("_k"))
        one = objects.join(shared, same, "left_semi").groupBy(self.part, self.key).agg(F.min("text").alias("text"))
        return objects.join(shared, same, "left_anti").unionByName(one)

    def _tell(self, number: int, name: str, segments: list[str], changed: int) -> None:
        self.spark.createDataFrame([(number, name, segments, changed)], _TOLD).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/told/{name}")

    def _written(self, df: DataFrame, folder: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}")

    def postings(self, words: DataFrame | None = None) -> DataFrame:
        """part, key, token, tf, dl of all live postings, or those of ``words(token)``: then only their buckets are read."""
        told = self.told()
        names = told.segments if told else []
        found = None
        for n in names:  # few: ``compact`` makes one of them
            s = self.spark.read.schema(self.rows).parquet(f"{self.path}/segments/{n}")
            found = s if found is None else found.unionByName(s)
        if found is None:
            return self.spark.createDataFrame([], self.rows).drop("segment", "bucket")
        if words is not None:
            some = self._sent(words.select("token").distinct())
            asked = [r[0] for r in some.select(self._bucket()).distinct().collect()]  # as many as there are buckets
            found = found.where(F.col("bucket").isin(asked)).join(some, "token", "left_semi")
        dead = self._side("dead", names, f"{self.part} string, {self.key} long, segment string").toDF("_p", "_k", "_s")
        dead = F.broadcast(dead) if dead.count() <= BROADCAST_DEAD else dead
        live = found.join(dead, (F.col("segment") == F.col("_s")) & F.col(self.part).eqNullSafe(F.col("_p")) & F.col(self.key).eqNullSafe(F.col("_k")), "left_anti")
        return live.select(self.part, self.key, "token", "tf", "dl")

    def sizes(self) -> DataFrame:
        """part, n_objects, words: sums of what the refreshes brought."""
        told = self.told()
        gain = self._side("sizes", told.segments if told else [], f"{self.part} string, n long, words long")
        return gain.groupBy(self.part).agg(F.sum("n").alias("n_objects"), F.sum("words").alias("words")).where("n_objects > 0")

    def bm25(self, asked: DataFrame, query: str = "item_id") -> DataFrame:
        """query, part, key, score for ``asked(query, token)``, as ``search.bm25`` gives them for the objects of the last refresh."""
        hits = self.postings(asked)
        size = self.sizes().select(F.col(self.part).alias("_p"), "n_objects", (F.col("words") / F.col("n_objects")).alias("avgdl"))
        df = self._sent(hits.groupBy(self.part, "token").agg(F.count(F.lit(1)).alias("df")).toDF("_p2", "_t", "df"))
        scored = hits.join(df, F.col(self.part).eqNullSafe(F.col("_p2")) & (F.col("token") == F.col("_t"))).join(F.broadcast(size) if size.count() <= 100_000 else size, F.col(self.part).eqNullSafe(F.col("_p")))
        idf = F.greatest(F.lit(1e-6), F.log((F.col("n_objects") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        # an object's hits are brought together once; what queries make of them stays there
        scored = scored.select(self.part, self.key, "token", weight.alias("weight")).repartition(self.part, self.key)
        return scored.join(self._sent(asked), "token").groupBy(query, self.part, self.key).agg(F.round(F.sum("weight"), 6).alias("score"))

    def _sent(self, df: DataFrame) -> DataFrame:
        """``df`` written down, and sent to every task if its count allows it."""
        path = shared_folder(self.spark)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        return F.broadcast(kept) if kept.count() <= BROADCAST_KEYS else kept

    def compact(self) -> None:
        """Make one segment of all, without dead postings."""
        told, number, name = self._next()
        if not told or len(told.segments) < 2:
            return
        self.postings().withColumn("segment", F.lit(name)).withColumn("bucket", self._bucket()).select(*self.rows.names).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/segments/{name}")
        self.sizes().select(self.part, F.col("n_objects").alias("n"), "words").write.mode("overwrite").parquet(f"{self.path}/sizes/{name}")
        self._side("dead", [], f"{self.part} string, {self.key} long, segment string").write.mode("overwrite").parquet(f"{self.path}/dead/{name}")
        rows = self.objects.read(before=name)
        self.objects.rewrite(rows, lambda old: old.withColumn("segment", F.lit(name)), name)
        self._tell(number, name, [name], 0)

    def vacuum(self) -> None:
        """Delete what the newest refresh doesn't need."""
        told = self.told()
        for folder in ("segments", "sizes", "dead", "changes", "met", "shared"):
            for n in children(self.spark, f"{self.path}/{folder}"):
                if n not in told.segments or folder in ("changes", "met", "shared"):
                    remove(self.spark, f"{self.path}/{folder}/{n}")
        self.objects.vacuum()
