"""Nulls along paths, two writers, dropped parts and null keys of a stream's work."""

from pyspark.sql import functions as F

from sparkloom.operators import store as K
from sparkloom.operators.tables import versions
from sparkloom.sources.files import shared_root
from sparkloom.sources.keyed import children
from sparkloom.streaming.progress import failed, process, unfinished


def test_null_contents_are_one_version(spark):
    rows = [(1, None), (2, None), (3, "a"), (4, "a"), (5, None), (6, "b")]
    df = spark.createDataFrame([("p", i, c) for i, c in rows], "path string, i int, content string")
    got = [(r.version, r.unchanged) for r in versions(df, ["path"], ["i"], "content").orderBy("i").collect()]
    assert got == [(1, False), (1, True), (2, False), (2, True), (3, False), (4, False)]


def test_publishing(spark, tmp_path, monkeypatch):
    frame = lambda n: spark.range(n)
    path = f"{tmp_path}/t"
    for n in (1, 2, 3, 4):
        K.publish(frame(n), path)
        assert K.published(spark, path).count() == n
    assert len(children(spark, f"{path}/versions")) <= 3
    # two writers that saw the same version: one of the two counts, whole
    before = K._told(spark, path)
    with monkeypatch.context() as m:
        told = K._told
        m.setattr(K, "_told", lambda s, p, held=[before]: held.pop() if held else told(s, p))
        K.publish(frame(50), path)
    with monkeypatch.context() as m:
        m.setattr(K, "_told", lambda s, p, held=[before]: held.pop() if held else told(s, p))
        K.publish(frame(60), path)
    assert K.published(spark, path).count() in (50, 60)


def test_a_dropped_part(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "v int, k string")
    K.replace_parts(df, f"{tmp_path}/t", "k")
    K.drop_part(spark, f"{tmp_path}/t", "k", "a")
    assert [r.v for r in spark.read.schema("v int, k string").parquet(f"{tmp_path}/t").collect()] == [2]


def test_null_keys_are_worked_on_once(spark, tmp_path):
    like = "a string, b int"
    source = spark.readStream.schema(like).parquet(f"{tmp_path}/in/*")
    generate = lambda d: d.withColumn("result", F.when(F.coalesce("b", F.lit(0)) < 5, F.lit("ok")))
    for k in range(2):
        spark.createDataFrame([(None, 1), ("x", None), (None, None), ("y", 7)], like).write.parquet(f"{tmp_path}/in/{k}")
        rows = process(source, f"{tmp_path}/out", ["a", "b"], generate)
    assert rows.where("result = 'ok'").count() == 3 and [tuple(r) for r in failed(rows, ["a", "b"]).collect()] == [("y", 7)]
    assert unfinished(spark.createDataFrame([(None, None), ("z", None)], like), rows, ["a", "b"]).collect() == [("z", None)]


def test_one_folder_for_an_application(spark):
    assert shared_root(spark) == shared_root(spark)
