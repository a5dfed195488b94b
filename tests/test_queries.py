"""Every registered query of the library proper against DuckDB, and the text functions on awkward strings."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import sparkloom.plans.cells  # noqa: F401  each registers its queries, as do the modules that it imports
import sparkloom.plans.context  # noqa: F401
import sparkloom.plans.kept  # noqa: F401
import sparkloom.plans.store  # noqa: F401
import sparkloom.plans.texts  # noqa: F401
from sparkloom.functions import text as T
from sparkloom.operators.tables import value_type
from sparkloom.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    found = con.execute(ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda rows: sorted((tuple(plain(v) for v in r) for r in rows), key=str)
    assert key(df.select(*names).collect()) == key(found.fetchall())


def test_fingerprint_over_levels(spark, tmp_path):
    # ids over more than 1,024 squared, so that all three levels have ranges; null texts and a null source
    rows = [(i * 7919, f"text {i}" if i % 7 else None, ["a", "b", None][i % 3]) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["index_fingerprint"](spark, str(tmp_path))
    found = duckdb.connect().execute(ORACLE["index_fingerprint"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'"))
    assert sorted(map(str, map(tuple, df.select("source", "objects", "fingerprint").collect()))) == sorted(map(str, found.fetchall()))


def test_text(spark):
    rows = [(1, " a  b c "), (2, ""), (3, None), (4, "Why? No. Yes!"), (5, "x\r\n\r\n\r\n\r\ny ​z  \n"), (6, "key sk-abcdefgh12 end")]
    df = spark.createDataFrame(rows, "i int, t string").select("i", T.truncate_words(F.col("t"), 2).alias("short"), T.first_sentence(F.col("t")).alias("first"), T.slug(F.col("t")).alias("slug"), T.normalise(F.col("t")).alias("normal"), T.scrub(F.col("t")).alias("clean"), T.tokens(F.col("t")).alias("w"))
    got = {r.i: r for r in df.collect()}
    assert got[1].short == "a b [...]" and got[2].slug == "course" and got[3].short is None
    assert got[4].first == "Why? No." and got[5].normal == "x\n\ny z" and got[6].clean == "key sk-***REDACTED*** end"


def test_value_type(spark):
    cases = {"": "missing", " 12 ": "integer", "-1.5e3": "number", "nan": "number", "2024-1-02x": "date_or_datetime", "1d": "text", None: "missing"}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.t for r in df.select("v", value_type(F.col("v")).alias("t")).collect()} == cases
