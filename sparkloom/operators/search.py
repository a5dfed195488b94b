"""Lexical search: an inverted index with statistics of its own for each partition, BM25, and re-ranking for diversity."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import tokens
from sparkloom.operators.evidence import phrase_links
from sparkloom.sources.files import shared_folder

K1, B = 1.2, 0.75


def postings(objects: DataFrame, part: str, key: str, text: str = "text", split: Callable = tokens, stem: Callable | None = None) -> DataFrame:
    """part, key, token, tf, dl: one row for each token of each object; counted before the shuffle, and before words are stemmed."""
    words = objects.select(part, key, split(F.col(text)).alias("w")).withColumn("dl", F.size("w"))
    found = words.select(part, key, "dl", F.explode("w").alias("token")).groupBy(part, key, "dl", "token").agg(F.count(F.lit(1)).alias("tf"))
    if stem is None:
        return found
    return found.withColumn("token", stem(F.col("token"))).groupBy(part, key, "dl", "token").agg(F.sum("tf").alias("tf"))


#: Postings that are given back at once.
_GIVEN = 100_000


def _counted(names: list[str]):
    def given(batch, rows, token, tf, dl):
        own = [c.take(pa.array(rows, pa.int32())) for c in batch.columns[:-1]]
        return pa.RecordBatch.from_arrays([*own, pa.array(token, pa.string()), pa.array(tf, pa.int64()), pa.array(dl, pa.int64())], [*names, "token", "tf", "dl"])

    def counted(batches):
        for batch in batches:
            held = [], [], [], []
            for i in range(batch.num_rows):
                w = batch.column("w")[i].as_py() or []
                n = Counter(w)
                for c, more in zip(held, ([i] * len(n), n, n.values(), [len(w)] * len(n))):
                    c.extend(more)
                if len(held[0]) >= _GIVEN:
                    yield given(batch, *held)
                    held = [], [], [], []
            yield given(batch, *held)

    return counted


def row_postings(objects: DataFrame, part: str, key: str, text: str = "text", split: Callable = tokens) -> DataFrame:
    """``postings`` of objects that are one row each: counted row by row, without a shuffle."""
    words = objects.select(part, key, split(F.col(text)).alias("w"))  # no filter on the words: it would split texts once more, and before a join
    return words.mapInArrow(_counted([part, key]), ", ".join(f"`{c}` {words.schema[c].dataType.simpleString()}" for c in (part, key)) + ", token string, tf long, dl long")


def query_terms(queries: DataFrame, query: str, terms: int = 12, split: Callable = tokens, stem: Callable | None = None) -> DataFrame:
    """query, token: the distinct tokens among a query's first ``terms``."""
    asked = queries.select(query, F.explode(F.array_distinct(F.slice(split(F.col("text")), 1, terms))).alias("token"))
    return asked if stem is None else asked.withColumn("token", stem(F.col("token"))).distinct()


def expanded_terms(queries: DataFrame, catalog: DataFrame, query: str, terms: int = 12, most: int = 40) -> DataFrame:
    """query, token: a query's first ``terms`` tokens, then those of every phrase of the concepts that it names, ``most`` in all.

    ``catalog`` has rows (label, alias); a query names a concept where an alias occurs in it as whole tokens.
    """
    phrases = catalog.select("alias").distinct().withColumn("text", F.col("alias"))
    named = phrase_links(queries, phrases, query, "alias").join(catalog, "alias").select(query, "label").distinct()
    added = named.join(catalog, "label").groupBy(query).agg(F.flatten(F.transform(F.sort_array(F.collect_set("alias")), tokens)).alias("more"))
    own = queries.select(query, F.slice(tokens(F.col("text")), 1, terms).alias("w")).join(added, query, "left")
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(F.coalesce("w", none), F.coalesce("more", none)))
    return own.select(query, F.explode(F.slice(F.filter(every, lambda t: F.length(t) >= 2), 1, most)).alias("token"))


def bm25(objects: DataFrame, asked: DataFrame, part: str = "source", key: str = "doc_id", query: str = "item_id", split: Callable = tokens, stem: Callable | None = None) -> DataFrame:
    """query, part, key, score: the sum over the terms ``asked(query, token)``, counts and lengths taken within the part; a null part is one of its own.

    Texts are split once, into a table of each object's length and its counts of the words that are asked for. Words are stemmed as
    distinct words of the whole vocabulary, not one by one.
    """
    spark = objects.sparkSession
    words = objects.select(F.col(part).alias("p"), F.col(key).alias("k"), split(F.col("text")).alias("w")).where("w is not null")
    path = shared_folder(spark)
    if stem is None:
        wanted = asked.select("token").distinct()
        found = wanted.select(F.col("token").alias("word"), "token")
    else:
        vocabulary = objects.select(F.explode(split(F.col("text"))).alias("word")).distinct()
        wanted = asked.select("token").distinct()
        found = vocabulary.withColumn("token", stem(F.col("word"))).join(wanted, "token", "left_semi")
    # words that are asked for, with the object's length; an object without any stays as one row without a word
    told = words.select("p", "k", F.size("w").alias("dl"), F.explode_outer("w").alias("word")).join(_small(found), "word", "left")
    counted = told.groupBy("p", "k", "dl", "token").agg(F.count(F.lit(1)).alias("tf"))
    counted.write.parquet(path)
    table = spark.read.schema(counted.schema).parquet(path)
    size = table.groupBy("p", "k").agg(F.max("dl").alias("dl")).groupBy("p").agg(F.count(F.lit(1)).alias("n_objects"), F.avg("dl").alias("avgdl"))
    hits = table.where("token is not null")
    df = hits.groupBy("p", "token").agg(F.count(F.lit(1)).alias("df"))
    df, size = df.toDF("p2", "token2", "df"), size.withColumnRenamed("p", "p3")
    scored = hits.join(df, F.col("p").eqNullSafe(F.col("p2")) & (F.col("token") == F.col("token2"))).join(size, F.col("p").eqNullSafe(F.col("p3")))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n_objects") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = scored.select(F.col("p").alias(part), F.col("k").alias(key), "token", weight.alias("weight"))
    return asked.join(scored, "token").groupBy(query, part, key).agg(F.round(F.sum("weight"), 6).alias("score"))


#: Rows of a table of words that are sent to every task (some 40 bytes each).
BROADCAST_WORDS = 1_000_000


def _small(words: DataFrame) -> DataFrame:
    """``words`` written down, and broadcast if their count allows it."""
    path = shared_folder(words.sparkSession)
    words.write.parquet(path)
    kept = words.sparkSession.read.schema(words.schema).parquet(path)
    return F.broadcast(kept) if kept.count() <= BROADCAST_WORDS else kept


def top(scores: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def diverse_top(scores: DataFrame, query: str, group: str, key: str, k: int, cap: int = 4) -> DataFrame:
    """The best ``k``, where those past ``cap`` of a group come after all others."""
    inside = F.row_number().over(Window.partitionBy(query, group).orderBy(F.desc("score"), key))
    order = Window.partitionBy(query).orderBy(F.col("_in") > cap, F.desc("score"), key)
    short = scores.withColumn("_in", inside).where(F.col("_in") <= k)  # no more of a group can be among the best k
    return short.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_in")
