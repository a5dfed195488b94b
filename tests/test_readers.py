"""Readers on files that the tests write, imports in several runs, and vectors on awkward rows."""

import json

from pyspark.sql import functions as F

from sparkloom.operators import evidence as E
from sparkloom.operators.vectors import cosine_topk
from sparkloom.sources.files import read_csv, read_notebooks
from sparkloom.streaming.imports import import_new


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date;price;return\n2024-01-02;1.5;\n2024-01-03;2\n")
    rows = [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv")).collect()]
    assert rows == [("2024-01-02", "1.5", ""), ("2024-01-03", "2", "")]


def test_notebooks(spark, tmp_path):
    outputs = [{"output_type": "stream", "text": ["a\n", "b"]}, {"output_type": "error", "ename": "E", "evalue": "no"}, {"output_type": "display_data", "data": {"text/plain": "shown"}}]
    cells = [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": "1 + 1", "outputs": outputs}]
    (tmp_path / "a.ipynb").write_text(json.dumps({"cells": cells}))
    (tmp_path / "b.ipynb").write_text("broken")
    got = [(r.cell, r.source, r.output, r.output_text) for r in read_notebooks(spark, str(tmp_path)).orderBy("cell", "output").collect()]
    assert got == [(0, "# T\nx", None, None), (1, "1 + 1", 0, "a\nb"), (1, "1 + 1", 1, "E: no"), (1, "1 + 1", 2, "shown")]


def test_import_resumes(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, "k int, t int, v string").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        source = spark.readStream.schema("k int, t int, v string").parquet(f"{tmp_path}/in/*")
        return sorted(tuple(r) for r in import_new(source, f"{tmp_path}/out", ["k"], ["t"]).select("k", "t", "v").collect())

    put("a", [(1, 2, "b"), (1, 1, "a"), (2, 1, "c")])
    assert run() == [(1, 1, "a"), (2, 1, "c")]
    put("b", [(1, 0, "late"), (3, 1, "d")])
    assert run() == run() == [(1, 1, "a"), (2, 1, "c"), (3, 1, "d")]


def test_cosine(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in cosine_topk(v.where("vec_id < 2"), v, 3, dim=2, rows=2).collect()}
    assert got == {(0, 1): (0, 1.0), (0, 2): (2, 1.0), (0, 3): (1, 0.0)}
    assert cosine_topk(v.limit(0), v, 3, dim=2).count() == 0


def test_phrases(spark):
    d = spark.createDataFrame([(1, "say the Old word, now"), (2, "the older word"), (3, None), (4, "")], "doc_id long, text string")
    p = spark.createDataFrame([(1, "OLD word"), (2, ""), (3, "the"), (4, "say the old word now yes")], "item_id long, text string")
    assert sorted(tuple(r) for r in E.phrase_links(d, p, "doc_id", "item_id").collect()) == [(1, 1), (1, 3), (2, 3)]
    assert E.phrase_links(d, p.limit(0), "doc_id", "item_id").count() == 0


def test_purpose(spark):
    rows = [("x/data.CSV", "homework"), ("a", "Homework 1"), ("l3/a", ""), ("a.pdf", None), (None, "syllabus"), (None, None)]
    got = spark.createDataFrame(rows, "u string, t string").select(E.purpose(F.col("u"), F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == ["dataset", "assignment", "lecture", "lecture", "reference", "unknown"]
