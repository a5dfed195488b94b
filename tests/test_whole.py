"""Queries on tables that hold more, or other rows, than the given ones, beside their SQL."""

import os

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkloom.operators.vectors import cosine_topk


def beside_sql(spark, name, folder):
    """What only the query has, and what only its SQL has."""
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}{'/*.parquet' if os.path.isdir(f'{folder}/{f}') else ''}'")
    asked = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in asked.description]
    want = sorted(map(str, asked.fetchall()))
    got = sorted(str(tuple(r)) for r in entry.queries()[name](spark, str(folder)).select(*columns).collect())
    return [r for r in got if r not in want], [r for r in want if r not in got], len(got) - len(want)


def test_a_column_of_many_cells(spark, tmp_path):
    spark.range(1, 260_001).selectExpr("id AS c_custkey", "concat('c', id) AS c_name", "cast(id % 25 AS int) AS c_nationkey", "id % 7 - 1.5D AS c_acctbal", "'m' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    assert beside_sql(spark, "reference_evidence", tmp_path) == ([], [], 0)


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_hashed_texts_on_other_rows(spark, tmp_path):
    # texts without words (no number is their score), two rows of one key, a null key, copies, a score of exactly 1/128
    texts = {1: "the cat the hat", 2: "", 3: None, 4: "?!", 5: "a cat, a_hat", 6: "The Cat THE hat", 7: "hat_the the"}
    rows = [*texts.items(), (5, "a second text of five"), (5, ""), (None, "the hat"), (None, "of none"), (2, None), (9, "ÄÖ ß 12 x²"), (10, " ".join(f"w{i}" for i in range(3000)))]
    written(spark, tmp_path, "documents", rows, "doc_id long, text string")
    written(spark, tmp_path, "benchmark", [(1, "the cat"), (2, "--"), (3, "second hat"), (None, "cat"), (4, "of five"), (4, "and none")], "item_id long, text string")
    for name in ("hash_embed_docs", "hash_embed_similarity"):
        assert beside_sql(spark, name, tmp_path) == ([], [], 0)


def test_nearest_of_many_blocks(spark, tmp_path):
    # copies that tie, zero rows and queries, keys that come twice, blocks smaller than what ties; queries sent to all tasks or dealt to them
    rng = np.random.default_rng(5)
    v = np.zeros((700, 64), dtype=np.float32)
    v[:, :4] = np.round(rng.normal(size=(700, 4)), 1)
    v[100:400] = v[0]
    v[[50, 450, 451]] = 0
    rows = [(i if i != 600 else 599, [float(x) for x in r]) for i, r in enumerate(v)]
    written(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>")
    for name in ("cosine_topk", "cosine_topk_excluding", "overfetch_filter_context"):
        assert beside_sql(spark, name, tmp_path) == ([], [], 0)
    e = spark.read.parquet(f"{tmp_path}/embeddings.parquet").withColumn("part", F.col("vec_id") % 3).repartition(5)
    asked = e.where("vec_id % 50 = 0")
    for how in ({}, {"exclude_self": True, "undefined": True}, {"part": "part"}):
        found = [sorted(map(str, cosine_topk(asked, e, 7, **how, **small).collect())) for small in ({}, {"rows": 9}, {"rows": 9, "broadcast": 2000})]
        assert found[0] == found[1] == found[2] and len(found[0]) > 70
