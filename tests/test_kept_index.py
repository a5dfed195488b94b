"""The kept index against one that is built anew, over refreshes, deletions, folding and a stop half way."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators.kept_index import KeptIndex
from sparkloom.operators.search import bm25
from sparkloom.sources.keyed import children


def texts(seed, n):
    rng = random.Random(seed)
    return {(rng.choice(["a", "b", None]), i): " ".join(f"w{int(rng.expovariate(0.1))}" for _ in range(rng.randrange(0, 40))) for i in range(n)}


def frame(spark, held):
    return spark.createDataFrame([(p, k, t) for (p, k), t in held.items()], "source string, doc_id long, text string")


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(1, "w1"), (1, "w7"), (2, "w0"), (2, "none"), (3, "w30"), (3, "w5")], "item_id long, token string")


def same(spark, index, held, asked):
    key = lambda df: sorted(map(str, map(tuple, df.select("item_id", "source", "doc_id", "score").collect())))
    return key(index.bm25(asked)) == key(bm25(frame(spark, held).where("text is not null"), asked))


def test_refreshes(spark, tmp_path, asked):
    held = texts(1, 120)
    index = KeptIndex(spark, f"{tmp_path}/index", buckets=8)
    assert index.bm25(asked).count() == 0 and index.sizes().count() == 0
    assert index.refresh(frame(spark, held)) == 120 and same(spark, index, held, asked)
    assert index.refresh(frame(spark, held)) == 0 and len(index.told().segments) == 1
    k = next(iter(held))
    held[k] = "w1 w1 only"
    held[("c", 500)] = "w7 w30"
    held[("a", 501)] = None  # no text: not there
    del held[list(held)[3]]
    assert index.refresh(frame(spark, held)) == 3 and same(spark, index, held, asked)
    # only the new texts' postings were written, in their buckets
    second = spark.read.parquet(f"{tmp_path}/index/segments/{index.told().segments[1]}")
    assert {r[0] for r in second.select("token").collect()} == {"w1", "only", "w7", "w30"}
    assert len(children(spark, f"{tmp_path}/index/segments/{index.told().segments[1]}")) <= 5
    before = sorted(map(str, index.postings().collect()))
    index.compact()
    assert len(index.told().segments) == 1 and sorted(map(str, index.postings().collect())) == before and same(spark, index, held, asked)
    index.vacuum()
    assert children(spark, f"{tmp_path}/index/segments") == index.told().segments and same(spark, index, held, asked)
    assert index.refresh(frame(spark, {})) > 0 and index.postings().count() == 0 and index.sizes().count() == 0


def test_a_refresh_that_stopped(spark, tmp_path, asked, monkeypatch):
    held = texts(2, 60)
    index = KeptIndex(spark, f"{tmp_path}/index", buckets=4)
    index.refresh(frame(spark, held))
    before = dict(held)
    held |= texts(3, 20)

    def stop(*_):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(index, "_tell", stop)
        with pytest.raises(OSError):
            index.refresh(frame(spark, held))
    assert same(spark, index, before, asked)  # what was told last still holds
    index.refresh(frame(spark, held))
    assert same(spark, index, held, asked)


def test_many_refreshes_fold(spark, tmp_path, asked):
    index, held = KeptIndex(spark, f"{tmp_path}/index", buckets=2), {}
    for i in range(4):
        held |= {("a", i): f"w{i} w1", ("b", i): "w7"}
        index.refresh(frame(spark, held), most=2)
    assert len(index.told().segments) < 4 and same(spark, index, held, asked)
    words = {r.token for r in index.postings(spark.createDataFrame([("w2",)], "token string")).collect()}
    assert words == {"w2"}


def test_a_refresh_shuffles_no_postings(spark, tmp_path, asked):
    # rows that share their key count as one text; each task writes what it counted
    held = texts(4, 300)
    more = [("a", 900, "w7 w7 w2"), ("a", 900, "w1 w5 w5"), (None, 901, "w1"), (None, 901, None), ("b", None, "w5"), ("b", None, "w30")]
    held = held | {("a", 900): "w1 w5 w5", (None, 901): "w1", ("b", None): "w30"}
    rows = spark.createDataFrame([(p, k, t) for (p, k), t in held.items() if k not in (900, 901, None)] + more, "source string, doc_id long, text string").repartition(6)
    index = KeptIndex(spark, f"{tmp_path}/index", buckets=2)
    assert index.refresh(rows) == len(held) and same(spark, index, held, asked)
    parts = spark.read.parquet(f"{tmp_path}/index/segments/refresh-1").select("bucket", F.input_file_name().alias("f")).distinct().groupBy("bucket").count()
    assert {r["count"] for r in parts.collect()} != {1}  # not dealt out by bucket first
    rows = rows.where("coalesce(doc_id, 0) <> 900")
    assert index.refresh(rows) == 1
    del held[("a", 900)]
    assert same(spark, index, held, asked)
