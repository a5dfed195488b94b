"""Readers for delimited text and notebooks, and the folder for tables that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CELL = "struct<cell_type:string, source:{s}, outputs:array<struct<output_type:string, text:{s}, ename:string, evalue:string, data:map<string,string>>>>"


#: The temporary folder of each local application that names none.
_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one, the same for a whole application, only for a local master that names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.sparkContext.applicationId
    if own not in _OWN:
        _OWN[own] = tempfile.mkdtemp(prefix="spark-")
    return _OWN[own]


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def delimiter(spark: SparkSession, path: str, head: int = 8192) -> str:
    """Of comma, tab, semicolon and bar the one most frequent in the first line of ``path``; else comma."""
    first = spark.read.text(path).limit(1).select(F.left("value", F.lit(head)).alias("v")).collect()
    counts = [(first[0].v.count(s), -i, s) for i, s in enumerate(",\t;|")] if first else []
    return max(counts)[2] if counts and max(counts)[0] else ","


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text; missing cells at the end are empty, surplus cells are ignored."""
    out = spark.read.csv(path, header=True, sep=delimiter(spark, path), encoding=encoding, mode="PERMISSIVE", escape='"', multiLine=True)
    return out.na.fill("")


def read_notebooks(spark: SparkSession, path: str) -> DataFrame:
    """path, cell (its place, from 0), cell_type, source, output (its place or null), output_type, output_text; broken files give no rows."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    # a source is text or a list of lines: read as JSON text first
    joined = lambda c: F.when(c.startswith("["), F.array_join(F.from_json(c, "array<string>"), "")).otherwise(c)
    cells = raw.select("path", F.posexplode(F.from_json("value", f"struct<cells:array<{_CELL.format(s='string')}>>")["cells"]).alias("cell", "c")).where("c is not null")
    each = cells.select("path", "cell", "c.cell_type", joined(F.col("c.source")).alias("source"), F.posexplode_outer("c.outputs").alias("output", "o"))
    text = F.coalesce(joined(F.col("o.text")), joined(F.col("o.data")["text/plain"]), F.concat_ws(": ", "o.ename", "o.evalue"))
    return each.select("path", "cell", "cell_type", "source", "output", F.col("o.output_type").alias("output_type"), F.when(F.col("o").isNotNull(), text).alias("output_text"))
