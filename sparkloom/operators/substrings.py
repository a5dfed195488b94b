"""Which names occur anywhere in which texts, found by the rarest run of characters of each name and then looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.files import shared_folder

#: Runs of characters that are sent to every task (some 40 bytes each).
BROADCAST_GRAMS = 1_000_000


def _runs(df: DataFrame, key: str, text: str, q: int) -> DataFrame:
    """key, gram: the distinct runs of ``q`` characters of each text."""
    signs = df.select(key, F.filter(F.split(text, ""), lambda c: c != "").alias("_c")).where(F.size("_c") >= q)
    runs = F.transform(F.sequence(F.lit(0), F.size("_c") - q), lambda i: F.concat(*[F.get(F.col("_c"), i + k) for k in range(q)]))
    return signs.select(key, F.explode(F.array_distinct(runs)).alias("gram"))


def _kept(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def substring_links(texts: DataFrame, names: DataFrame, key: str, name: str, text: str = "text", q: int = 4) -> DataFrame:
    """key, name: each pair whose text contains the name, whatever the case. ``texts(key, text)`` has one row a key; names of under ``q`` characters and nulls match nothing.

    A text that contains a name has all of its runs of ``q`` characters. So each name waits at the run that fewest texts have, only texts
    with that run are candidates, and these are looked at. No text meets all names.
    """
    given = texts.where(F.col(text).isNotNull()).select(F.col(key), F.lower(text).alias("_text"))
    asked = names.where(F.length(name) >= q).select(F.col(name), F.lower(name).alias("_name")).distinct()
    of_names = _kept(_runs(asked.select("_name").distinct(), "_name", "_name", q))
    wanted = of_names.select("gram").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_GRAMS else wanted
    found = _kept(_runs(given, key, "_text", q).join(wanted, "gram", "left_semi"))
    often = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a run that no text has rules its name out
    rarest = of_names.join(often, "gram", "left").groupBy("_name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("_name", "r.gram")
    met = found.join(rarest, "gram").select(key, "_name").join(given, key).where(F.contains("_text", F.col("_name")))
    return met.select(key, "_name").join(asked, "_name").select(key, name)
