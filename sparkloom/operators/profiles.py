"""A whole profile of a table in bounded memory: what is shuffled doesn't grow with the number of values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.tables import value_type

#: In the order of their names.
KINDS = ("date_or_datetime", "integer", "missing", "number", "text")


def _first_and_least(names: list[str], samples: int, cap: int):
    """Of each column in a task: its first ``samples`` distinct values that aren't missing, and the ``cap`` least distinct hashes."""

    def run(batches):
        first: dict[str, dict] = {n: {} for n in names}
        least = {n: np.zeros(0, np.int64) for n in names}
        for batch in batches:
            order = batch.column("at")
            for n in names:
                h = np.unique(np.concatenate([least[n], batch.column(f"h_{n}").to_numpy()]))
                least[n] = h[:cap]
                held = first[n]
                # the first rows of distinct values of this batch are enough
                table = pa.table({"v": batch.column(f"v_{n}"), "at": order}).filter(pc.invert(pc.is_null(batch.column(f"v_{n}"))))
                some = table.group_by("v").aggregate([("at", "min")]).sort_by("at_min").slice(0, samples)
                for v, at in zip(some.column("v").to_pylist(), some.column("at_min").to_pylist()):
                    if v not in held or at < held[v]:
                        held[v] = at
                first[n] = dict(sorted(held.items(), key=lambda x: x[1])[:samples])
        for n in names:
            vs, m = list(first[n].items()), len(least[n])
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(vs), pa.string()), pa.nulls(len(vs), pa.int64()), pa.array([v for v, _ in vs], pa.string()), pa.array([a for _, a in vs], pa.int64())], ["name", "h", "value", "at"])
            yield pa.RecordBatch.from_arrays([pa.array([n] * m, pa.string()), pa.array(least[n]), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64())], ["name", "h", "value", "at"])

    return run


def whole_profile(df: DataFrame, order: str, samples: int = 5, cap: int = 10_001) -> DataFrame:
    """name, row_count, type_counts (of the five kinds), missing_count, unique_count (up to ``cap``), inferred, samples: one row for each column.

    ``order`` is an integer column that says what comes first. A missing value is one of the distinct values, as an empty text; distinct values are told by
    64-bit hashes. The inferred kind is the most frequent but missing, of equal ones the one met first. Tasks pass on ``cap`` hashes and ``samples`` values a
    column at most.
    """
    names = df.columns
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names}
    kind = {c: value_type(text[c]) for c in names}
    told = df.agg(*[F.struct(*[F.count_if(kind[c] == k).alias(k) for k in KINDS], *[F.min(F.when(kind[c] == k, F.col(order))).alias(f"at_{k}") for k in KINDS]).alias(c) for c in names])
    types = told.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("t")) for c in names])).alias("x")).select("x.name", "x.t")
    best = F.array_max(F.array(*[F.when(F.col(f"t.{k}") > 0, F.struct(F.col(f"t.{k}").alias("n"), (-F.col(f"t.at_{k}")).alias("at"), F.lit(k).alias("kind"))) for k in KINDS if k != "missing"]))["kind"]
    total = sum((F.col(f"t.{k}") for k in KINDS[1:]), F.col(f"t.{KINDS[0]}"))
    types = types.select("name", total.alias("row_count"), F.struct(*[F.col(f"t.{k}").alias(k) for k in KINDS]).alias("type_counts"), F.col("t.missing").alias("missing_count"), F.coalesce(best, F.lit("unknown")).alias("inferred"))
    given = df.select(F.col(order).cast("long").alias("at"), *[F.when(kind[c] != "missing", text[c]).alias(f"v_{c}") for c in names], *[F.xxhash64(text[c]).alias(f"h_{c}") for c in names])
    seen = given.mapInArrow(_first_and_least(names, samples, cap), "name string, h long, value string, at long")
    unique = seen.where("h is not null").groupBy("name", "h").count().groupBy("name").agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("unique_count"))
    w = Window.partitionBy("name").orderBy("at")  # a few rows of each task
    first = seen.where("value is not null").groupBy("name", "value").agg(F.min("at").alias("at")).withColumn("i", F.row_number().over(w)).where(F.col("i") <= samples)
    first = first.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("samples"))
    out = types.join(unique, "name", "left").join(first, "name", "left")
    return out.select("name", "row_count", "type_counts", "missing_count", F.coalesce("unique_count", F.lit(0)).alias("unique_count"), "inferred", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))
