"""Tables that are replaced, grown and deleted from as a whole: imports and their states, organisation, derived indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sparkloom.functions.text import collapse, slug
from sparkloom.operators.ranks import running
from sparkloom.operators.tables import free_slugs
from sparkloom.sources.keyed import remove


def publish(df: DataFrame, path: str) -> None:
    """Replace the table at ``path``: a new version is written beside the old one and counts once it is told. Versions before the last two are deleted.

    A version has a name of its own, so two writers don't touch each other's files; of two that tell the same number the greater name counts.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    told = _told(spark, path)
    df.write.parquet(f"{path}/versions/{name}")
    spark.createDataFrame([((told[0].number if told else 0) + 1, name)], _TOLD).coalesce(1).write.mode("append").parquet(f"{path}/told")
    kept = {r.name for r in _told(spark, path)[:2]}
    for old in told[1:]:
        if old.name not in kept:
            remove(spark, f"{path}/versions/{old.name}")


def published(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that has been told; one that is being written isn't seen."""
    return spark.read.parquet(f"{path}/versions/{_told(spark, path)[0].name}")


_TOLD = "number long, name string"


def _told(spark: SparkSession, path: str) -> list:
    """Versions, the newest first: a short row for each."""
    try:
        return spark.read.schema(_TOLD).parquet(f"{path}/told").orderBy(F.desc("number"), F.desc("name")).collect()
    except AnalysisException:  # nothing there yet
        return []


def drop_part(spark: SparkSession, path: str, by: str, value: str) -> None:
    """Delete the part ``by=value`` of the table at ``path``; no other file is touched. ``value`` as its folder spells it."""
    remove(spark, f"{path}/{by}={value}")


def replace_parts(df: DataFrame, path: str, by: str) -> None:
    """Replace those parts of the table at ``path`` that ``df`` holds; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert_last(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``old`` and ``new`` with place (from 0): a row of ``new`` replaces that of its key and moves to the end, in the order of ``order``; of rows that repeat the last counts."""
    rows = old.withColumn("_late", F.lit(0)).unionByName(new.withColumn("_late", F.lit(1)))
    rest = [c for c in old.columns if c != key]
    last = rows.groupBy(key).agg(F.max(F.struct("_late", order, *[c for c in rest if c != order])).alias("r")).select(key, "r.*")
    return running(last, ["_late", order, key], out="place").drop("_late")


def import_states(log: DataFrame, path: list[str], order: list[str], content: str, done: Column) -> DataFrame:
    """``log`` with version, status, content_id, supersedes and duplicate_of.

    Along a path, equal contents in a row are one version. Once such a version is extracted (``done``) its further imports are unchanged; before that they are
    retries. Another content is superseding, the first one new; one that fails is failed. ``supersedes`` is the content before at the path,
    ``duplicate_of`` the path that brought the content first, if that is another one. A null content is a content of its own.
    """
    w = Window.partitionBy(*path).orderBy(*order)
    changed = F.coalesce(~F.col(content).eqNullSafe(F.lag(content).over(w)) | F.lag(F.lit(1)).over(w).isNull(), F.lit(True))
    hashed = F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")).cast("binary"), 256)
    out = log.withColumn("_new", changed).withColumn("_done", F.coalesce(done, F.lit(False))).withColumn("_hash", hashed).withColumn("_path", F.concat_ws("/", *path))
    out = out.withColumn("_id", F.substring(F.sha2(F.concat("_hash", F.lit("\0"), "_path").cast("binary"), 256), 1, 24))
    out = out.withColumn("version", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*path, "version").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.max(F.col("_done").cast("int")).over(inside), F.lit(0)) == 1
    status = F.when(earlier, "unchanged").when(~F.col("_done"), "failed").when(~F.col("_new"), "retried").when(F.col("version") > 1, "superseding").otherwise("new")
    heads = out.where("_new").select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(path)], (F.col("version") + 1).alias("_v"), F.col("_id").alias("supersedes"))
    same = F.col("version") == F.col("_v")
    for i, c in enumerate(path):
        same &= F.col(c).eqNullSafe(F.col(f"_p{i}"))
    own = F.when(F.col(content).isNull(), F.lit("null")).otherwise(F.col("_hash"))
    first = out.groupBy(own.alias("_h")).agg(F.min(F.struct(*order, "_path")).alias("_f")).select("_h", F.col("_f")["_path"].alias("_first"))
    out = out.withColumn("status", status).join(heads, same, "left").join(first, own == F.col("_h"))
    out = out.withColumn("content_id", F.col("_id")).withColumn("duplicate_of", F.when(F.col("_first") != F.col("_path"), F.col("_first")))
    return out.drop("_new", "_done", "_hash", "_path", "_id", "_v", "_h", "_first", *[f"_p{i}" for i in range(len(path))])


def current_only(artifacts: DataFrame, key: str, supersedes: str) -> DataFrame:
    """Artifacts that no other one supersedes."""
    gone = artifacts.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias("_gone")).distinct()
    return artifacts.join(gone, F.col(key) == F.col("_gone"), "left_anti")


def delete_paths(rows: DataFrame, chosen: DataFrame, path: list[str], content: str) -> tuple[DataFrame, DataFrame]:
    """(``rows`` without any version at the paths of ``chosen``, contents that then no row holds)."""
    left = rows.join(chosen.select(*path).distinct(), path, "left_anti")
    gone = rows.join(chosen.select(*path).distinct(), path, "left_semi").select(content).distinct()
    return left, gone.join(left.select(content).distinct(), content, "left_anti")


def digests(objects: DataFrame, part: str, key: str, hashed: Column, width: int = 1024) -> DataFrame:
    """part, objects, fingerprint: digests of ranges of ``width`` integer keys, then of ranges of these, then of all: no row holds more than ``width`` of the first two. Null digests are passed over."""
    level = objects.select(part, F.col(key).cast("long").alias("at"), hashed.alias("h"), F.lit(1).cast("long").alias("n"))
    for step in (width, width, None):
        own = F.array_sort(F.collect_list(F.struct("at", "h")))
        up = F.expr(f"at div {step}") if step else F.lit(0).cast("long")
        level = level.groupBy(part, up.alias("up")).agg(own.alias("all"), F.sum("n").alias("n"))
        known = F.filter(F.transform("all", lambda x: x["h"]), lambda h: h.isNotNull())
        level = level.select(part, F.col("up").alias("at"), F.when(F.size(known) > 0, F.sha2(F.array_join(known, "").cast("binary"), 256)).alias("h"), "n")
    return level.select(part, F.col("n").alias("objects"), F.col("h").alias("fingerprint"))


def index_status(now: DataFrame, stored: DataFrame, part: str, schema: int) -> DataFrame:
    """part, ready, reasons: what ``now(part, fingerprint)`` has against ``stored(part, schema, fingerprint)`` of a derived index."""
    s = stored.select(F.col(part).alias("_part"), F.col("schema").alias("_schema"), F.col("fingerprint").alias("_stored"))
    reasons = F.concat_ws("; ", F.when(F.col("_part").isNull(), "index has not been built"), F.when(F.col("_schema") != schema, "index schema changed"), F.when(F.col("_stored") != F.col("fingerprint"), "source versions changed"))
    return now.join(s, F.col(part).eqNullSafe(F.col("_part")), "left").select(part, (reasons == "").alias("ready"), reasons.alias("reasons"))


def refreshed(now: DataFrame, stored: DataFrame, part: str, schema: int) -> DataFrame:
    """part, schema, fingerprint, rebuilt: what is stored once every part that isn't ready has been built again."""
    status = index_status(now, stored, part, schema)
    return now.join(status.select(F.col(part).alias("_part"), "ready"), F.col(part).eqNullSafe(F.col("_part"))).select(part, F.lit(schema).alias("schema"), "fingerprint", (~F.col("ready")).alias("rebuilt"))


def assigned(folders: DataFrame, known: DataFrame, key: str, order: list[str], reason_chars: int = 240) -> tuple[DataFrame, DataFrame]:
    """(key, folder: of the proposed ``folders(folder, ids, reason)`` the first one that lists a known id; folder, reason of the folders in use)."""
    listed = folders.where("folder <> ''").select("folder", *order, F.posexplode("ids").alias("_at", key)).join(known.select(key), key, "left_semi")
    first = listed.groupBy(key).agg(F.min(F.struct(*order, "_at", "folder")).alias("f")).select(key, "f.folder")
    reason = F.left(collapse(F.coalesce("reason", F.lit(""))), F.lit(reason_chars))
    last = folders.where(reason != "").groupBy("folder").agg(F.max(F.struct(*order, reason.alias("reason"))).alias("r")).select("folder", "r.reason")
    return first, last.join(first.select("folder").distinct(), "folder", "left_semi")


def unknown_ids(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Ids that are asked for and not known."""
    return asked.select(key).distinct().join(known.select(key), key, "left_anti")


def filed(artifacts: DataFrame, assignments: DataFrame, reasons: DataFrame, key: str) -> DataFrame:
    """``artifacts`` with folder and folder_reason, empty if there is none."""
    out = artifacts.join(assignments, key, "left").join(reasons, "folder", "left")
    return out.withColumn("folder", F.coalesce("folder", F.lit(""))).withColumn("folder_reason", F.coalesce("reason", F.lit(""))).drop("reason")


def folder_overview(files: DataFrame, key: str) -> DataFrame:
    """folder, files, reason (of its first file that has one), place: by name, files without a folder as "Unfiled" at the end."""
    name = F.when(F.trim("folder") == "", "Unfiled").otherwise(F.trim("folder"))
    g = files.withColumn("folder", name).groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.min_by("folder_reason", F.when(F.col("folder_reason") != "", F.col(key))), F.lit("")).alias("reason"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.col("folder") == "Unfiled", "folder")))  # a row for each folder


def shared_prefix_groups(files: DataFrame, name: str, least: int = 4) -> DataFrame:
    """``files`` with group (the shared prefix, or the whole name of a file that shares none): names that begin alike for ``least`` characters or more, blanks at the ends left aside.

    Sharing so many first characters is an equivalence, so the groups come from one key, without comparing names with each other.
    """
    stem = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.col(name), r"(?<=[^.])\.[^.]+$", ""), r"[_\-\s]+", " ")))
    keyed = files.withColumn("_stem", stem).withColumn("_key", F.regexp_extract("_stem", rf"^(.{{{least - 1},}}?\S)", 1))
    keyed = keyed.withColumn("_key", F.when(F.col("_key") == "", F.concat(F.lit("\0"), name)).otherwise(F.col("_key")))
    ends = keyed.groupBy("_key").agg(F.min("_stem").alias("_a"), F.max("_stem").alias("_b"), F.count(F.lit(1)).alias("_n"))
    # what the least and the greatest name share, all share
    shared = F.expr("aggregate(sequence(1, greatest(length(_a), 1)), 0, (s, i) -> if(s = i - 1 and left(_a, i) = left(_b, i), i, s))")
    ends = ends.withColumn("group", F.when(F.col("_n") > 1, F.rtrim(F.left("_a", shared)))).select(F.col("_key").alias("_k"), "group")
    return keyed.join(ends, F.col("_key") == F.col("_k")).withColumn("group", F.coalesce("group", F.col(name))).drop("_stem", "_key", "_k")


def course_code(name: Column) -> Column:
    """Two to six letters and three to five digits with perhaps a letter, upper case without blanks; null if a name has none."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_extract(name, "([^/]*)$", 1), r"(?<=[^.])\.[^.]+$", ""), r"[_\-]+", " ")
    code = r"\b([A-Za-z]{2,6})\s*[-_ ]?\s*(\d{3,5}[A-Za-z]?)\b"
    found = F.concat(F.regexp_extract(plain, code, 1), F.regexp_extract(plain, code, 2))
    return F.nullif(F.upper(found), F.lit(""))


def shown_state(running: Column, stored: Column, n: Column, explained: Column) -> Column:
    """running, paused, error, done, partial or idle: counts decide where the stored state can't know."""
    return F.when(running, "running").when(stored.isin("paused", "error"), stored).when((n > 0) & (explained >= n), "done").when(explained > 0, "partial").otherwise("idle")


def fallback_overview(decks: DataFrame, by: str, title: Column, n_slides: str, order: list[str]) -> DataFrame:
    """by, overview: what is said of a course without a syllabus: its decks in order and how many slides they have."""
    g = decks.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(n_slides).alias("slides"), F.array_sort(F.collect_list(F.struct(*order, title.alias("t")))).alias("d"))  # a course's decks
    names = F.array_join(F.transform("d", lambda x: x["t"]), ", ")
    # fixed values
    text = F.concat(F.lit("No syllabus or programme document was provided for "), F.col(by).cast("string"), F.lit(", so this description is drawn from the imported material alone. The course holds "), F.col("n").cast("string"), F.lit(" decks and about "), F.col("slides").cast("string"), F.lit(" slides, in this order: "), names, F.lit(". Drop the syllabus in and it can be described properly."))
    return g.select(by, text.alias("overview"))


def courses_of(groups: DataFrame, courses: DataFrame, title: str) -> DataFrame:
    """``groups`` with course and created: the known course of that title, whatever its case, else a new one with a free slug."""
    known = courses.groupBy(F.lower(F.trim("title")).alias("_t")).agg(F.min("id").alias("_id"))
    met = groups.join(known, F.lower(F.trim(title)) == F.col("_t"), "left")
    fresh = met.where("_id is null").groupBy(F.lower(F.trim(title)).alias("_new")).agg(F.min(title).alias("_title")).withColumn("_slug", slug(F.col("_title")))
    fresh = free_slugs(fresh.withColumn("_key", F.xxhash64("_new")), "_slug", "_key", courses.select("id")).select("_new", F.col("id").alias("_made"))
    out = met.join(fresh, F.lower(F.trim(title)) == F.col("_new"), "left")
    return out.withColumn("course", F.coalesce("_id", "_made")).withColumn("created", F.col("_id").isNull()).drop("_t", "_id", "_new", "_made")


def folder_tree(files: DataFrame, by: str, path: str) -> DataFrame:
    """``files`` with group and reason, from the folders that the files of a selection ``by`` lie in; both null where folders don't tell.

    A selection counts if all its files lie under one root folder. Files straight in the root, no folders below it, or folders that are all
    units of a course (week 3, lec 2) make the root the group, unless its name says that it holds courses; else each folder below is a group.
    """
    parts = F.split(F.col(path), "/")
    rows = files.withColumn("_p", parts)
    child = F.when(F.size("_p") >= 3, F.col("_p")[1])
    # fixed values: folders that stand for a unit, and roots that hold courses
    unit = F.lower(F.trim(child)).rlike(r"^(?:l|lec|lecture|week|wk|module|unit|chapter)\s*\d+$")
    generic = F.lower(F.trim("_root")).isin("courses", "course", "course materials", "course_materials")
    g = rows.groupBy(F.col(by).alias("_by")).agg(
        F.min(F.size("_p")).alias("_least"), F.min(F.col("_p")[0]).alias("_root"), F.max(F.col("_p")[0]).alias("_last"), F.min(child).alias("_c1"), F.max(child).alias("_c2"), F.coalesce(F.bool_and(unit), F.lit(True)).alias("_units")
    )
    one_root = (F.col("_least") >= 2) & (F.col("_root") == F.col("_last"))
    whole = (F.col("_least") == 2) | F.col("_c1").isNull() | (~generic & F.col("_units"))
    several = generic | (F.col("_c1") != F.col("_c2"))
    g = g.withColumn("_kind", F.when(one_root & whole, "root").when(one_root & several, "folder")).select("_by", "_root", "_kind")
    out = rows.join(g, F.col(by).eqNullSafe(F.col("_by")))
    group = F.when(F.col("_kind") == "root", F.col("_root")).when(F.col("_kind") == "folder", F.col("_p")[1])
    said = F.when(F.col("_kind") == "root", "files were selected from the folder ").when(F.col("_kind") == "folder", "files were selected from the course folder ")
    return out.withColumn("group", group).withColumn("reason", F.concat(said, F.lit('"'), F.col("group"), F.lit('"'))).drop("_p", "_by", "_root", "_kind")


def relative_members(files: DataFrame, by: str, path: str, title: str) -> DataFrame:
    """``files`` with relative: the path below the folder that bears the group's ``title``, if all files of a group ``by`` lie in one, else below the folders that all of them share."""
    rows = files.withColumn("_p", F.split(F.col(path), "/")).withColumn("_dirs", F.slice("_p", F.lit(1), F.size("_p") - 1))
    at = F.array_position(F.transform("_dirs", lambda x: F.lower(x)), F.lower(F.trim(title)))
    rows = rows.withColumn("_at", at)
    # what the least and the greatest list of folders share, all share
    g = rows.groupBy(F.col(by).alias("_by")).agg(F.min("_at").alias("_titled"), F.min("_dirs").alias("_a"), F.max("_dirs").alias("_b"))
    shared = F.expr("aggregate(sequence(1, greatest(size(_a), 1)), 0, (s, i) -> if(s = i - 1 and i <= size(_a) and i <= size(_b) and _a[i - 1] = _b[i - 1], i, s))")
    out = rows.join(g.withColumn("_shared", shared), F.col(by).eqNullSafe(F.col("_by")))
    cut = F.when(F.col("_titled") > 0, F.col("_at")).otherwise(F.col("_shared")).cast("int")
    return out.withColumn("relative", F.array_join(F.slice("_p", cut + 1, F.size("_p")), "/")).drop("_p", "_dirs", "_at", "_by", "_titled", "_a", "_b", "_shared")


def free_hues(ids: DataFrame, key: str, hue: Column, hues: int) -> DataFrame:
    """key, hue: the ids of a set, in their order, each at its own ``hue`` (from 0) or the next one that is free; once all ``hues`` are taken, at its own.

    Each id takes a free hue while there is one, so only the first ``hues`` ids of the order can be moved: these are placed one after the other, the others keep their own.
    """
    given = ids.select(key).distinct().withColumn("hue", hue.cast("int"))
    first = given.orderBy(key).limit(hues)
    listed = first.agg(F.array_sort(F.collect_list(F.struct(key, "hue"))).alias("l"))  # ``hues`` rows
    none = F.array().cast("array<int>")

    def placed(taken: Column, one: Column) -> Column:
        tried = F.transform(F.sequence(F.lit(0), F.lit(hues - 1)), lambda s: (one["hue"] + s) % hues)
        return F.concat(taken, F.array(F.get(F.filter(tried, lambda p: ~F.array_contains(taken, p)), F.lit(0))))

    picks = listed.select(F.explode(F.arrays_zip(F.col("l"), F.aggregate("l", none, placed).alias("p"))).alias("x")).select(F.col(f"x.l.{key}").alias("_k"), F.col("x.p").alias("_p"))
    out = given.join(F.broadcast(picks), F.col(key).eqNullSafe(F.col("_k")), "left")
    return out.select(key, F.coalesce("_p", "hue").alias("hue"))
