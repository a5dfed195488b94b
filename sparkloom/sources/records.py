"""Stored records: JSON lines read with a tolerant schema, pages and texts of a folder, embedded media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes that are taken up, and their kinds.
# fixed values
KINDS = {"pdf": "pdf", "pptx": "pptx", "ppt": "pptx", "potx": "pptx", "docx": "docx", "xlsx": "xlsx", "csv": "csv", "ipynb": "ipynb"}
#: Media that may be shown, with the bytes they begin with.
# fixed values
MEDIA = {"image/png": "89504E470D0A1A0A", "image/jpeg": "FFD8FF", "image/gif": "47494638", "image/webp": "52494646"}


def kind_of(path: Column) -> Column:
    """The kind of a file by its suffix; null if it isn't taken up."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.lit(None).cast("string")
    for name, kind in KINDS.items():
        out = F.when(suffix == name, kind).otherwise(out)
    return out


def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """path (within ``folder``), kind, size: files below it that are taken up; hidden ones, those in hidden folders, and lock files are not."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")  # contents aren't read
    inside = F.regexp_replace("path", "^.*?" + "/".join(["", *folder.split("://")[-1].strip("/").split("/")[-1:], ""]), "")
    named = raw.select(inside.alias("path"), F.col("length").alias("size")).withColumn("kind", kind_of(F.col("path")))
    return named.where("kind is not null").where(~F.col("path").rlike(r"(^|/)(\.|~\$)"))


def field(record: Column, name: str, kind: str) -> Column:
    """A field of a parsed record (variant) if it has the kind ("string", "long", "double", "boolean" or "array<long>"), else its default.

    True and false are no numbers; lists of numbers lose what is none, repeats and order.
    """
    inner = F.try_variant_get(record, f"$.{name}", "variant")
    told = F.schema_of_variant(inner)
    if kind == "array<long>":
        held = F.try_variant_get(record, f"$.{name}", "array<variant>")
        numbers = F.transform(F.filter(held, lambda x: F.schema_of_variant(x) == "BIGINT"), lambda x: F.try_variant_get(x, "$", "long"))
        return F.coalesce(F.array_sort(F.array_distinct(numbers)), F.array().cast("array<bigint>"))
    fits = {"string": told == "STRING", "long": told == "BIGINT", "double": (told == "BIGINT") | (told == "DOUBLE") | told.startswith("DECIMAL"), "boolean": told == "BOOLEAN"}[kind]
    default = {"string": "", "long": 0, "double": 0.0, "boolean": False}[kind]
    return F.coalesce(F.when(fits, F.try_variant_get(record, f"$.{name}", kind)), F.lit(default))


def decoded(lines: DataFrame, text: str, fields: dict[str, str], needed: tuple[str, ...] = ()) -> DataFrame:
    """The ``fields`` of JSON texts, with the other columns; texts that are no JSON object, or lack a needed field, give no row."""
    parsed = lines.withColumn("_record", F.try_parse_json(text)).where(F.schema_of_variant("_record").startswith("OBJECT"))
    out = parsed.select(*[c for c in lines.columns if c != text], *[field(F.col("_record"), name, kind).alias(name) for name, kind in fields.items()])
    for name in needed:
        out = out.where(F.col(name) != "")
    return out


def read_records(spark: SparkSession, path: str, fields: dict[str, str], needed: tuple[str, ...] = ()) -> DataFrame:
    """Records of JSON lines, with the file they are from."""
    return decoded(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value"), "value", fields, needed)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """index (from 0), text: pages that have a picture or a text, page-0001 and on; no text file is an empty text."""
    raw = spark.read.format("binaryFile").load(folder).select("path", "content").where(F.col("path").rlike(r"page-\d{4,}\.(png|txt)$"))
    index = F.regexp_extract("path", r"page-(\d{4,})\.", 1).cast("long") - 1
    text = F.when(F.col("path").endswith(".txt"), F.col("content").cast("string"))
    return raw.groupBy(index.alias("index")).agg(F.coalesce(F.max(text), F.lit("")).alias("text"))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """file_id (the name without suffix), text: one row for each text file."""
    raw = spark.read.text(f"{folder}/*.txt", wholetext=True)
    return raw.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.txt$", 1).alias("file_id"), F.col("value").alias("text"))


def media(encoded: Column, kind: Column, most: int = 32 << 20) -> Column:
    """The bytes of embedded media: null if the kind isn't shown, the text is no base64, it is too large, or its first bytes tell another kind."""
    data = F.try_to_binary(F.when(encoded.rlike(r"\A[A-Za-z0-9+/\s]*={0,2}\s*\z"), encoded), F.lit("base64"))
    begins = F.lit(False)
    for name, magic in MEDIA.items():
        begins = begins | ((kind == name) & F.hex(F.substring(data, 1, len(magic) // 2)).eqNullSafe(F.lit(magic)))
    return F.when(begins & (F.octet_length(data) <= most), data)


def lookup(df: DataFrame, **key) -> DataFrame:
    """The row with this key; an error if there is none."""
    found = df
    for name, value in key.items():
        found = found.where(F.col(name).eqNullSafe(F.lit(value)))
    found = found.limit(1)
    if found.isEmpty():
        raise KeyError(f"no such row: {key}")
    return found


def read_courses(spark: SparkSession, root: str) -> DataFrame:
    """id, title, created_at: the course of each folder under ``root`` that isn't hidden and has a course.json, the folder's name for a lacking id; by age and id. Broken files give no row."""
    raw = spark.read.option("recursiveFileLookup", False).text(f"{root}/*/course.json", wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/course\.json$", 1).alias("folder"))
    found = decoded(raw.where(~F.col("folder").startswith(".")), "value", {"id": "string", "title": "string", "created_at": "double"})
    return found.select(F.when(F.col("id") == "", F.col("folder")).otherwise(F.col("id")).alias("id"), "title", "created_at").orderBy("created_at", "id")


#: Fields of a stored artifact; the first three are needed.
ARTIFACT = {
    "id": "string", "content_hash": "string", "kind": "string", "filename": "string", "source_path": "string", "purpose": "string", "order": "long",
    "duplicate_of": "string", "supersedes": "string", "version": "long", "extraction_status": "string", "object_count": "long",
}


def read_artifacts(spark: SparkSession, root: str, include_superseded: bool = False) -> DataFrame:
    """course (its folder) and the fields of ``ARTIFACT``: the records of each course's artifacts.json, without those that another one supersedes, by course, order, path and version.

    Records that lack a needed field, and files that hold no list, give no rows; a lacking purpose is unknown, a lacking version 1, a lacking status done.
    """
    raw = spark.read.text(f"{root}/*/artifacts.json", wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/artifacts\.json$", 1).alias("course"))
    each = raw.select("course", F.explode(F.from_json("value", "array<string>")).alias("value"))
    rows = decoded(each, "value", ARTIFACT, ("id", "content_hash", "kind"))
    plain = lambda c, none: F.when(F.col(c) == F.lit("" if isinstance(none, str) else 0), F.lit(none)).otherwise(F.col(c))
    rows = rows.withColumn("purpose", plain("purpose", "unknown")).withColumn("version", plain("version", 1)).withColumn("extraction_status", plain("extraction_status", "done"))
    if not include_superseded:
        gone = rows.where("supersedes <> ''").select(F.col("course").alias("_course"), F.col("supersedes").alias("_id")).distinct()
        rows = rows.join(gone, (F.col("course") == F.col("_course")) & (F.col("id") == F.col("_id")), "left_anti")
    return rows.orderBy("course", "order", "source_path", "version")
