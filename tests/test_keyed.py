"""Keyed stores and imports into them against plain versions, with nulls, runs that stop and deletions."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators.store import import_states
from sparkloom.sources.keyed import KeyedStore, children
from sparkloom.streaming.versions import ImportStore

IMPORTS = "no long, course string, path string, content string, done boolean"
OUT = ["no", "version", "status", "content_id", "supersedes", "duplicate_of"]


def rows_of(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", ["k"], "k string, v long", buckets=8)
    assert store.read().count() == 0 and store.commits() == 0
    frame = lambda held: spark.createDataFrame(held, "k string, v long")
    held = {None if i == 7 else f"k{i}": i for i in range(40)}
    store.upsert(frame(list(held.items())), "first")
    touched = store.upsert(frame([("k1", 100), (None, 200), ("new", 300)]), "second")
    held |= {"k1": 100, None: 200, "new": 300}
    assert rows_of(store.read()) == rows_of(frame(list(held.items())))
    assert len(touched) <= 3 and {c for c in children(spark, f"{tmp_path}/s/data/second") if c.startswith("bucket")} == {f"bucket={b}" for b in touched}
    assert rows_of(store.of(frame([(None, 0), ("k3", 0), ("nope", 0)]))) == rows_of(frame([(None, 200), ("k3", 3)]))
    # the same commit once more, with other rows: it replaces itself
    store.upsert(frame([("k1", 101)]), "second")
    assert store.read().where("k = 'k1'").first().v == 101 and store.read().where("k is null").first().v == 7
    assert store.read(before="second").where("k = 'k1'").first().v == 1
    store.delete(frame([(x, 0) for x in [*held, "nope"]]))
    assert store.read().count() == 0 and store.read(before=store._told().name).count() == 40
    store.upsert(frame([("z", 1)]))
    store.upsert(frame([("z", 2)]))
    assert store.vacuum() >= 2 and rows_of(store.read()) == rows_of(frame([("z", 2)]))


def imports(seed, n):
    rng = random.Random(seed)
    return [(i, rng.choice(["c", None]), rng.choice(["a", "b", "x", None]), rng.choice(["1", "2", "3", None, ""]), rng.choice([True, True, False, None])) for i in range(n)]


@pytest.mark.parametrize("stop", [None, "contents", "versions"])
def test_imports_by_batches_equal_all_at_once(spark, tmp_path, monkeypatch, stop):
    given = imports(5, 160)
    df = spark.createDataFrame(given, IMPORTS)
    store = ImportStore(spark, f"{tmp_path}/st", IMPORTS, ["course", "path"], ["no"], buckets=3)
    for i in range(4):
        df.where(F.expr(f"no div 40 = {i}")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(IMPORTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    if stop:  # the third batch is stopped before one of the two stores takes it up
        kept = getattr(store, stop)
        rewrite = kept.rewrite
        monkeypatch.setattr(kept, "rewrite", lambda k, c, name=None: (_ for _ in ()).throw(OSError("stopped")) if name == "batch-2" else rewrite(k, c, name))
        with pytest.raises(Exception, match="stopped"):
            store.run(source)
        monkeypatch.setattr(kept, "rewrite", rewrite)
    out = store.run(source)
    assert rows_of(out.select(*OUT)) == rows_of(import_states(df, ["course", "path"], ["no"], "content", F.col("done")).select(*OUT))
    versions = out.select("course", "path", "version", "hash").distinct()
    assert rows_of(store.contents.read().select("hash", "versions")) == rows_of(versions.groupBy("hash").agg(F.count(F.lit(1)).alias("versions")))
    assert rows_of(store.versions.read().select("course", "path", "version", "hash")) == rows_of(versions)
    assert store.current().count() == df.select("course", "path").distinct().count()
    # a batch that was taken up whole is passed over
    store.take(df, 3)
    assert store.outcomes().count() == 160


def test_forgetting_paths(spark, tmp_path):
    store = ImportStore(spark, f"{tmp_path}/st", IMPORTS, ["course", "path"], ["no"], buckets=4)
    store.take(spark.createDataFrame([(1, "c", "a", "only", True), (2, "c", "a", "both", True), (3, None, "b", "both", True), (4, "c", None, None, True)], IMPORTS), 0)
    only = store.contents.read().where("content = 'only'").first().hash
    chosen = spark.createDataFrame([("c", "a")], "course string, path string")
    assert [r.hash for r in store.forget(chosen, "x").collect()] == [only]
    assert store.versions.read().count() == 2 and rows_of(store.contents.read().select("content", "versions")) == rows_of(spark.createDataFrame([("both", 1), (None, 1)], "content string, versions long"))
    store.forget(chosen, "x")  # once more under its name: nothing changes
    assert store.versions.read().count() == 2 and store.contents.read().where("content = 'both'").first().versions == 1
    gone = store.forget(spark.createDataFrame([(None, "b"), ("c", None)], "course string, path string"), "y")
    assert gone.count() == 2 and store.contents.read().count() == 0 and store.versions.read().count() == 0
