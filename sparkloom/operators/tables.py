"""Profiles, versions, sheet functions, budgets and reading order over tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.ranks import medians
from sparkloom.sources.files import shared_folder


def value_type(text: Column) -> Column:
    """missing, integer, number, date_or_datetime or text, by pattern."""
    t = F.trim(text)
    number = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
    return F.when(t.isNull() | (t == ""), "missing").when(t.rlike(r"^[+-]?\d+$"), "integer").when(t.rlike(number) | F.lower(t).rlike("^[+-]?(nan|inf|infinity)$"), "number").when(t.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}"), "date_or_datetime").otherwise("text")


def profile(df: DataFrame, cap: int = 10_001) -> DataFrame:
    """For each column: rows, missing, distinct values (saturating at ``cap``) and the most frequent type but missing."""
    names = df.columns
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in names])).alias("c")).select("c.*")
    values = cells.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("type", value_type(F.col("value")))
    types = values.groupBy("name", "type").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct"))
    best = F.max_by("type", F.when(F.col("type") != "missing", F.struct("n", "type")))
    return types.groupBy("name").agg(F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(F.col("type") == "missing", F.col("n"))), F.lit(0)).alias("missing"), F.least(F.sum("distinct"), F.lit(cap)).alias("unique_count"), F.coalesce(best, F.lit("unknown")).alias("inferred"))


def criterion(value: Column, rule: str) -> Column:
    """A spreadsheet criterion on a numeric column, as in ``>=10``."""
    for sign in ("<=", ">=", "<>", "=", "<", ">"):
        if rule.startswith(sign):
            x = F.lit(float(rule[len(sign) :]))
            return {"<=": value <= x, ">=": value >= x, "<>": value != x, "=": value == x, "<": value < x, ">": value > x}[sign]
    return value == F.lit(float(rule))


def countifs_sumifs(df: DataFrame, by: str, total: str, rules: list[tuple[str, str]]) -> DataFrame:
    met = reduce(lambda a, b: a & b, [criterion(F.col(c), r) for c, r in rules])
    return df.groupBy(by).agg(F.count_if(met).alias("countifs"), F.round(F.coalesce(F.sum(F.when(met, F.col(total))), F.lit(0.0)), 2).alias("sumifs"))


def sheet_aggregates(df: DataFrame, by: str, value: str) -> DataFrame:
    v = F.col(value)
    out = df.groupBy(by).agg(F.round(F.sum(v), 2).alias("sum"), F.round(F.avg(v), 6).alias("average"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count"), F.round(F.stddev_samp(v), 6).alias("stdev"))
    middle = medians(df, by, value).select(F.col(by).alias("_by"), F.round("median", 6).alias("median"))
    return out.join(middle, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: one aggregate of structs, no sort of whole groups."""
    rest = [c for c in df.columns if c not in key and c not in order]
    return df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*key, "r.*")


def insert_if_absent(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key is not in it, the first of each."""
    rest = [c for c in new.columns if c not in key and c not in order]
    first = new.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("r")).select(*key, "r.*").select(*old.columns)
    stored = old.select(*[F.col(c).alias(f"stored_{i}") for i, c in enumerate(key)])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"stored_{i}")) for i, c in enumerate(key)])
    return old.unionByName(first.join(stored, same, "left_anti"))  # a null key is a key: it comes in once


def duplicates(df: DataFrame, key: str, content: str) -> DataFrame:
    """key, content_hash, duplicate_of (the smallest key of equal contents, null on itself)."""
    hashed = df.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min(key).alias("first"))
    # a null content is no copy of anything, and its row stays
    return hashed.join(first.where("content_hash is not null"), "content_hash", "left").select(key, "content_hash", F.when(F.col("first") != F.col(key), F.col("first")).alias("duplicate_of"))


def versions(imports: DataFrame, path: list[str], order: list[str], content: str) -> DataFrame:
    """Version number along each path: a row whose content equals the one before it, or is null like that one, keeps the version."""
    w = Window.partitionBy(*path).orderBy(*order)
    same = F.lag(F.lit(True)).over(w) & F.col(content).eqNullSafe(F.lag(content).over(w))
    changed = (~F.coalesce(same, F.lit(False))).cast("int")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return imports.withColumn("_new", changed).withColumn("version", F.sum("_new").over(run)).withColumn("unchanged", F.col("_new") == 0).drop("_new")


def reading_order(df: DataFrame, deck: str, order: list[str], told: str, out: str, width: int = 1024) -> DataFrame:
    """Columns position (from 0, over all rows by an integer ``deck`` and ``order``) and ``out``: ``told`` of the row before, across decks; nulls come first.

    Rows before a deck come from sums over decks, in ranges of ``width`` of them; windows hold one deck or one range. A deck's first row looks at
    the last row of the deck before, found in the same way.
    """
    own = Window.partitionBy(deck).orderBy(*order)
    last = F.max_by(F.struct(F.col(told).alias("told")), F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order]))
    sizes = df.groupBy(deck).agg(F.count(F.lit(1)).alias("n"), last.alias("last")).withColumn("b", F.floor(F.col(deck) / width))
    blocks = sizes.groupBy("b").agg(F.sum("n").alias("bn"), F.max_by("last", F.struct(F.col(deck).isNotNull(), F.col(deck))).alias("tail"))
    line = Window.orderBy(F.col("b").asc_nulls_first())
    blocks = blocks.select(F.col("b").alias("of"), F.coalesce(F.sum("bn").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lag("tail").over(line).alias("entry"))
    inside = Window.partitionBy("b").orderBy(F.col(deck).asc_nulls_first())
    start = sizes.join(blocks, F.col("b").eqNullSafe(F.col("of"))).select(F.col(deck).alias("_deck"), (F.col("before") + F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_start"), F.coalesce(F.lag("last").over(inside), F.col("entry")).alias("_before"))
    rows = df.withColumn("_i", F.row_number().over(own)).withColumn("_own", F.lag(F.struct(F.col(told).alias("told"))).over(own)).join(start, F.col(deck).eqNullSafe(F.col("_deck")))
    return rows.withColumn("position", F.col("_start") + F.col("_i") - 1).withColumn(out, F.coalesce("_own", "_before")["told"]).drop("_i", "_own", "_deck", "_start", "_before")


def budget_prefix(df: DataFrame, by: str, order: list[str], size: str, total: int, each: int) -> DataFrame:
    """How much of each row fits a budget, in order; the last one is cut."""
    one = F.least(F.col(size), F.lit(each))
    before = F.coalesce(F.sum(one).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = df.withColumn("used_before", before).withColumn("taken", F.least(one, F.lit(total) - F.col("used_before")))
    return out.where("taken > 0")


def round_robin(df: DataFrame, by: str, group: str, order: str, size: str, most: int, rows: int, total: int, each: int) -> DataFrame:
    """The first of each group, then the second of each, up to ``most`` a group and ``rows`` in all, within a word budget."""
    turn = F.row_number().over(Window.partitionBy(by, group).orderBy(order))
    seat = F.row_number().over(Window.partitionBy(by).orderBy("turn", group, order))
    seated = df.withColumn("turn", turn).where(F.col("turn") <= most).withColumn("seat", seat).where(F.col("seat") <= rows)
    return budget_prefix(seated, by, ["seat"], size, total, each)


def first_rows(df: DataFrame, by: list[str], order: list, n: int, salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each group: of each salt first, then of these, so no window holds a whole large group."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    few = df.withColumn("_salt", salt).withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))).where(F.col("_i") <= n)
    return few.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_i") <= n).drop("_salt", "_i")


def close(a: Column, b: Column) -> Column:
    """Equal to nine digits, or within a billionth."""
    return F.abs(a - b) <= F.greatest(1e-9 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-9))


def audit(df: DataFrame, by: str, stored: Column, computed: Column) -> DataFrame:
    """by, total, verified, mismatch, unknown: stored values against computed ones."""
    same = close(stored.cast("double"), computed.cast("double"))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(same).alias("verified"), F.count_if(~same).alias("mismatch"), F.count_if(same.isNull()).alias("unknown"))


def text_criterion(value: Column, rule: str) -> Column:
    """A spreadsheet criterion on any column: numbers compare where both sides are numbers, else texts.

    With ``*`` or ``?`` a text is matched from its start, whatever its case; then any sign but ``<>`` means equal. Plain texts
    compare by case; null is the empty text.
    """
    sign = next((s for s in ("<=", ">=", "<>", "=", "<", ">") if rule.startswith(s)), "")
    want, text = rule[len(sign) :], F.coalesce(value.cast("string"), F.lit(""))
    if "*" in want or "?" in want:
        pattern = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in want)
        met = text.rlike(f"(?is)^{pattern}$")
        return ~met if sign == "<>" else met
    compare = {"<=": Column.__le__, ">=": Column.__ge__, "<>": Column.__ne__, "<": Column.__lt__, ">": Column.__gt__}.get(sign, Column.__eq__)
    as_text = compare(text, F.lit(want))
    try:
        number = float(want)
    except ValueError:
        return as_text
    is_number = value_type(text).isin("integer", "number")
    return F.when(is_number, compare(text.try_cast("double"), F.lit(number))).otherwise(as_text)


def numbered(df: DataFrame, by: str, key: str, width: int = 65_536, out: str = "n") -> DataFrame:
    """1, 2, ... within each group by an integer key: counts of key ranges first, so that a window holds one range of a group."""
    df = df.withColumn("_range", F.floor(F.col(key) / width))
    sizes = df.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(by).alias("_by"), F.col("_range").alias("_of"), before.alias("_before"))
    joined = df.join(sizes, F.col(by).eqNullSafe(F.col("_by")) & F.col("_range").eqNullSafe(F.col("_of")))
    own = F.row_number().over(Window.partitionBy(by, "_range").orderBy(key))
    return joined.withColumn(out, F.col("_before") + own).drop("_range", "_by", "_of", "_before")


def free_slugs(df: DataFrame, slug: str, key: str, taken: DataFrame | None = None) -> DataFrame:
    """Column id: in the order of ``key`` (unique) each row's first free one of slug, slug-2, slug-3 and so on; ``taken(id)`` are not free.

    A slug hands its numbers out in rising order, so its rows only have to pass over some. An id can be wanted by two slugs at most: by b for its number N,
    and by the slug b-N for its first row. Whichever row is earlier has it, and the other slug passes over that number. Which row of b wants N hangs on
    the numbers below N alone, so a few rounds settle all.
    """
    path = shared_folder(df.sparkSession)
    numbered(df, slug, key, out="rank").write.parquet(path)
    ranked = df.sparkSession.read.parquet(path)
    first = ranked.where("rank = 1").select(F.col(slug).alias("c"), F.col(key).alias("m"))
    suffixed = r"^(.+)-([2-9]|[1-9][0-9]{1,8})$"
    split = lambda c: [F.regexp_extract(c, suffixed, 1).alias("b"), F.regexp_extract(c, suffixed, 2).try_cast("long").alias("n")]
    pairs = first.select("c", "m", *split("c")).join(first.select(F.col("c").alias("b")), "b", "left_semi")
    always = df.select(F.col(slug).alias("b"), F.lit(1).cast("long").alias("n")).limit(0)
    if taken is not None:
        held = taken.select("id").distinct()
        always = held.select(F.col("id").alias("b"), F.lit(1).cast("long").alias("n")).unionByName(held.select(*split("id"))).join(first.select(F.col("c").alias("b")), "b", "left_semi")
    skip = _written(always)
    pairs = _written(pairs.join(always, ["b", "n"], "left_anti"))
    while not pairs.isEmpty():
        below = pairs.join(skip.select(F.col("b").alias("of"), F.col("n").alias("x")), (F.col("b") == F.col("of")) & (F.col("x") < F.col("n")), "left").groupBy("b", "n", "c", "m").agg((F.col("n") - F.count("x")).alias("rank"))
        wanted = below.join(ranked.select(F.col(slug).alias("b"), "rank", F.col(key).alias("k")), ["b", "rank"])
        lost = wanted.select(F.when(F.col("m") < F.col("k"), F.struct("b", "n")).otherwise(F.struct(F.col("c").alias("b"), F.lit(1).cast("long").alias("n"))).alias("s")).select("s.*")
        now = _written(always.unionByName(lost).distinct())
        settled = now.count() == skip.distinct().count() == now.join(skip, ["b", "n"], "left_semi").count()
        skip = now
        if settled:
            break
    passed = skip.groupBy("b").agg(F.sort_array(F.collect_set("n")).alias("skip"))
    number = F.aggregate(F.coalesce("skip", F.array().cast("array<bigint>")), F.col("rank").cast("long"), lambda n, x: F.when(x <= n, n + 1).otherwise(n))
    made = ranked.join(passed, F.col(slug) == F.col("b"), "left").withColumn("number", number)
    name = F.when(F.col("number") == 1, F.col(slug)).otherwise(F.concat_ws("-", F.col(slug), F.col("number").cast("string")))
    return made.withColumn("id", name).drop("rank", "b", "skip", "number")


def _written(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
