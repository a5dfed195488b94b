"""Sheets as long tables of cells: references, the evidence behind them, charts, rules, units, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.files import shared_folder


def column_number(letters: Column) -> Column:
    """A = 1, Z = 26, AA = 27; null for no letters."""
    signs = F.filter(F.split(F.upper(letters), ""), lambda c: c != "")
    number = F.aggregate(signs, F.lit(0).cast("long"), lambda n, c: n * 26 + F.ascii(c) - 64)
    return F.when(F.coalesce(letters, F.lit("")) != "", number)


def reference(text: Column, sheet: Column) -> Column:
    """sheet, min_col, min_row, max_col, max_row of a reference such as 'My Sheet'!$B$2:D9, B2 or C:C; open ends are null, and all is null if it is none."""
    plain = F.trim(text)
    at = F.length(plain) - F.locate("!", F.reverse(plain)) + 1  # the last exclamation mark
    named = F.contains(plain, F.lit("!"))
    own = F.substring(plain, F.lit(1), at - 1)
    quoted = own.startswith("'") & own.endswith("'") & (F.length(own) > 1)
    own = F.when(quoted, F.replace(F.substring(own, F.lit(2), F.length(own) - 2), F.lit("''"), F.lit("'"))).otherwise(own)
    where = F.replace(F.when(named, F.substring(plain, at + 1, F.length(plain))).otherwise(plain), F.lit("$"), F.lit(""))
    pattern = r"^([A-Za-z]{0,3})(\d*)(?::([A-Za-z]{0,3})(\d*))?$"
    part = lambda i: F.nullif(F.regexp_extract(where, pattern, i), F.lit(""))
    single = ~F.contains(where, F.lit(":"))
    row, last_row = part(2).cast("long"), F.when(single, part(2)).otherwise(part(4)).cast("long")
    col, last_col = column_number(part(1)), column_number(F.when(single, part(1)).otherwise(part(3)))
    known = where.rlike(pattern) & (where != "") & (where != ":")
    return F.when(known, F.struct(F.when(named, own).otherwise(sheet).alias("sheet"), col.alias("min_col"), row.alias("min_row"), last_col.alias("max_col"), last_row.alias("max_row")))


def table_reference(refs: DataFrame, tables: DataFrame, text: str = "text") -> DataFrame:
    """``refs`` with ref, as ``reference`` gives it, for texts such as Sales[Amount]: the data rows of a table's column; null for other texts and unknown tables or columns.

    ``tables(name, sheet, min_col, min_row, max_row, headers, totals)``: the first row holds the headers, with ``totals`` the last one holds no data.
    Of tables that share a name the first by sheet and place counts.
    """
    pattern = r"^([^\[]+)\[([^\]]+)\]$"
    first = tables.groupBy(F.col("name").alias("_t")).agg(F.min_by(F.struct("sheet", "min_col", "min_row", "max_row", "headers", "totals"), F.struct("sheet", "min_row", "min_col")).alias("_at"))
    named = refs.withColumn("_name", F.regexp_extract(F.trim(text), pattern, 1)).withColumn("_column", F.regexp_extract(F.trim(text), pattern, 2))
    met = named.join(first, F.col("_name") == F.col("_t"), "left")
    place = F.array_position("_at.headers", F.col("_column"))
    col = F.col("_at.min_col").cast("long") + place - 1
    last = F.col("_at.max_row").cast("long") - F.coalesce(F.col("_at.totals"), F.lit(False)).cast("long")
    found = F.struct(F.col("_at.sheet").alias("sheet"), col.alias("min_col"), (F.col("_at.min_row").cast("long") + 1).alias("min_row"), col.alias("max_col"), last.alias("max_row"))
    return met.withColumn("ref", F.when((F.col("_name") != "") & (place > 0), found)).drop("_name", "_column", "_t", "_at")


#: Blocks of rows that are sent to every task (some 2 KB each at most).
BROADCAST_BLOCKS = 20_000


def _blocks(cells: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(sheet, col, block, before, places: how many cells a column holds before a block of ``rows``, and where in it they lie; the cells with their number in their column)."""
    spark, given = cells.sparkSession, cells.where("value is not null").select("sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value")
    held = given.groupBy("sheet", "col", F.expr(f"row div {rows}").alias("block")).agg(F.sort_array(F.collect_list("row")).alias("places"))  # ``rows`` numbers at most
    path = shared_folder(spark)
    held.write.parquet(path)
    held = spark.read.schema(held.schema).parquet(path)
    # blocks without cells too, so that any row has its block
    spans = held.groupBy("sheet", "col").agg(F.max("block").alias("m")).select("sheet", "col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("block"))
    every = spans.join(held, ["sheet", "col", "block"], "left")
    w = Window.partitionBy("sheet", "col").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of a column
    n = F.coalesce(F.size("places"), F.lit(0))
    counts = every.select("sheet", "col", "block", F.when(F.col("places").isNotNull(), n).otherwise(0).cast("long").alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    blocks = counts.join(held, ["sheet", "col", "block"], "left").select("sheet", "col", "block", "before", "n", F.coalesce("places", F.array().cast("array<bigint>")).alias("places"))
    inside = F.row_number().over(Window.partitionBy("sheet", "col", "block").orderBy("row"))
    numbered = given.withColumn("block", F.expr(f"row div {rows}")).withColumn("i", inside).join(counts.select("sheet", "col", "block", "before"), ["sheet", "col", "block"])
    return blocks, numbered.select("sheet", "col", (F.col("before") + F.col("i")).alias("number"), "row", "value")


def resolved(refs: DataFrame, cells: DataFrame, key: str, most: int | None = 250_000, sample: int = 8, rows: int = 1024) -> DataFrame:
    """key, error, cell_count, nonblank_count, sample (the first values that are not null, row by row), first (its first cell): evidence for ``refs(key, ref)``.

    ``cells(sheet, row, col, value)``, each cell once. Open ends reach to the sheet's last row or column. A reference to more than ``most`` cells is an error (None: never).
    Ranges are met by blocks of ``rows``: a column holds as many cells in a range as stand before its end less those before its beginning,
    each told by one block; the sample's cells are looked up by their number in the column. So a reference costs a few rows for each column that
    holds anything, however many cells lie in it.
    """
    ends = cells.groupBy("sheet").agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    r = refs.select(key, "ref.*").join(ends.withColumnRenamed("sheet", "_s"), F.col("sheet") == F.col("_s"), "left")
    r = r.select(key, "sheet", F.col("_s").isNull().alias("unknown"), F.coalesce("min_row", F.lit(1)).alias("r1"), F.coalesce("max_row", "rows").alias("r2"), F.coalesce("min_col", F.lit(1)).alias("c1"), F.coalesce("max_col", "cols").alias("c2"))
    size = (F.col("r2") - F.col("r1") + 1) * (F.col("c2") - F.col("c1") + 1)
    error = F.when(F.col("sheet").isNull(), "unsupported reference").when(F.col("unknown"), "unknown sheet")
    error = error if most is None else error.when(size > most, "too many cells")
    r = r.withColumn("error", error).withColumn("cell_count", F.when(error.isNull(), size))
    blocks, numbered = _blocks(cells, rows)
    columns = blocks.groupBy(F.col("sheet").alias("_s"), F.col("col")).agg(F.max("block").alias("last"))
    # columns that hold something: a sheet's, of which a reference takes those between its ends
    of_sheet = columns.groupBy("_s").agg(F.sort_array(F.collect_list(F.struct("col", "last"))).alias("held"))
    wide = r.where("error is null").join(of_sheet, F.col("sheet") == F.col("_s")).select(key, "sheet", "r1", "r2", F.explode(F.filter("held", lambda x: x["col"].between(F.col("c1"), F.col("c2")))).alias("h"))
    wide = wide.where("r1 <= r2").select(key, "sheet", F.col("h.col").alias("col"), "r1", "r2", F.explode(F.array(F.struct(F.lit(True).alias("start"), (F.col("r1") - 1).alias("row")), F.struct(F.lit(False).alias("start"), F.col("r2").alias("row")))).alias("p"), F.col("h.last").alias("last"))
    points = wide.select(key, "sheet", "col", "r1", "p.*", F.least(F.expr(f"p.row div {rows}"), "last").alias("block"))
    told = F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks
    points = points.join(told, ["sheet", "col", "block"]).withColumn("upto", F.col("before") + F.size(F.filter("places", lambda x: x <= F.col("row"))))
    counted = points.groupBy(key, "sheet", "col").agg(F.max(F.when(F.col("start"), F.col("upto"))).alias("a"), F.max(F.when(~F.col("start"), F.col("upto"))).alias("b")).where("b > a")
    wanted = counted.select(key, "sheet", "col", F.explode(F.expr(f"sequence(a + 1, least(a + {sample}, b))")).alias("number"))
    seen = wanted.join(numbered, ["sheet", "col", "number"]).groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("row", "col", "value"))), 1, sample).alias("s"))  # ``sample`` a column
    total = counted.groupBy(key).agg(F.sum(F.col("b") - F.col("a")).alias("nonblank_count"))
    held = total.join(seen, key).select(key, "nonblank_count", F.transform("s", lambda x: x["value"]).alias("sample"))
    out = r.join(held, key, "left")
    none = F.array().cast("array<string>")
    return out.select(key, "error", "cell_count", F.when(F.col("error").isNull(), F.coalesce("nonblank_count", F.lit(0))).alias("nonblank_count"), F.coalesce("sample", none).alias("sample"), F.when(F.col("error").isNull(), F.struct("sheet", F.col("r1").alias("row"), F.col("c1").alias("col"))).alias("first"))


def provenance(evidence: DataFrame, key: str, first: str, cells: DataFrame) -> DataFrame:
    """``evidence`` with object_id of its first cell (empty if unknown) and whether that cell holds a formula itself; ``cells(sheet, row, col, object_id, is_formula)``."""
    c = cells.select(F.struct("sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).alias("_at"), "object_id", "is_formula")
    out = evidence.join(c, F.col(first) == F.col("_at"), "left")
    state = F.when(F.coalesce("is_formula", F.lit(False)), "verified_using_cached_precedents").otherwise("verified")
    return out.withColumn("object_id", F.coalesce("object_id", F.lit(""))).withColumn("state", state).drop("_at", "is_formula")


def chart_findings(series: DataFrame, chart: str, number: str) -> DataFrame:
    """chart, severity, message: what is wrong with each chart, or that nothing is.

    ``series(chart, number, title, chart_type, val_error, cat_error, val_cells, cat_cells, cat_present)``: an error for a range that can't be read and for lengths
    that differ, a warning for a chart without a title of its own and for one with more series than categories.
    """
    n = F.col(number).cast("string")
    say = lambda severity, text: F.struct(F.lit(severity).alias("severity"), text.alias("message"))
    unread = lambda c, name: F.when(F.col(c).isNotNull(), say("error", F.concat(F.lit("Series "), n, F.lit(f" has an unresolved {name} range: "), F.col(c), F.lit("."))))
    uneven = F.when(F.col("val_error").isNull() & F.col("cat_error").isNull() & (F.col("val_cells") != F.col("cat_cells")), say("error", F.concat(F.lit("Series "), n, F.lit(" has different value and category range lengths."))))
    own = series.select(chart, F.explode(F.array_compact(F.array(unread("val_error", "val"), unread("cat_error", "cat"), uneven))).alias("f")).select(chart, "f.*")
    whole = series.groupBy(chart).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("cat_error").isNull(), F.col("cat_present"))).alias("categories"), F.max("title").alias("title"), F.max("chart_type").alias("chart_type"))
    title = F.coalesce("title", F.lit(""))
    bare = F.when((title == "") | title.startswith("Chart "), say("warning", F.lit("The chart has no descriptive source title.")))
    turned = F.when((F.col("n") > F.col("categories")) & F.col("chart_type").isin("LineChart", "BarChart"), say("warning", F.concat(F.lit("The chart has "), F.col("n").cast("string"), F.lit(" series but only "), F.col("categories").cast("string"), F.lit(" category values. If categories are time periods, inspect Switch Row/Column orientation."))))
    found = own.unionByName(whole.select(chart, F.explode(F.array_compact(F.array(bare, turned))).alias("f")).select(chart, "f.*"))
    fine = series.select(chart).distinct().join(found, chart, "left_anti").select(chart, say("info", F.lit("Every inspected series has resolvable source ranges with aligned value and category lengths.")).alias("f")).select(chart, "f.*")
    return found.unionByName(fine)


def structure_inventory(rules: DataFrame, filters: DataFrame, sheets: DataFrame) -> DataFrame:
    """kind, sheet, cell_range, detail: formatting rules, filters, and sheets that are hidden or hide rows or columns."""
    a = rules.select(F.lit("conditional_formatting").alias("kind"), "sheet", "cell_range", F.concat_ws(" ", "rule_type", "operator").alias("detail"))
    b = filters.where("cell_range <> ''").select(F.lit("auto_filter").alias("kind"), "sheet", "cell_range", F.lit("").alias("detail"))
    hides = (F.col("state") != "visible") | (F.size("hidden_rows") > 0) | (F.size("hidden_columns") > 0)
    c = sheets.where(hides).select(F.lit("hidden_structure").alias("kind"), "sheet", "cell_range", "state")
    return a.unionByName(b).unionByName(c.withColumnRenamed("state", "detail"))


def labels_near(formulas: DataFrame, refs: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """key, labels: the texts that tell what the formula in a cell counts, on one line, for each of ``formulas(key, sheet, row, col)``.

    They are the cell above (in the first row, the cell itself), the three to the left, and for each of ``refs(key, place, ref)`` in their places the cell above its first one
    and the first three cells, row by row. ``cells(sheet, row, col, value, is_text)``: only texts count. Each place asks for its cell, so no range is gone through.
    """
    spot = lambda n, sheet, row, col: F.struct(n.alias("n"), sheet.alias("sheet"), row.cast("long").alias("row"), col.cast("long").alias("col"))
    sheet, row, col = F.col("sheet"), F.col("row"), F.col("col")
    first = F.array(F.lit(-1).cast("long"), F.lit(0).cast("long"))
    near = [spot(F.concat(first, F.array(F.lit(0).cast("long"))), sheet, F.greatest(F.lit(1), row - 1), col)]
    near += [F.when(col - k >= 1, spot(F.concat(first, F.array(F.lit(4 - k).cast("long"))), sheet, row, col - k)) for k in (3, 2, 1)]
    own = formulas.select(key, F.explode(F.array_compact(F.array(*near))).alias("s"))
    ends = cells.groupBy(F.col("sheet").alias("_s")).agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    r = refs.select(key, F.col("place").cast("long").alias("place"), "ref.*").join(ends, F.col("sheet") == F.col("_s"))
    r = r.select(key, "place", "sheet", F.coalesce("min_row", F.lit(1)).alias("r1"), F.coalesce("max_row", "rows").alias("r2"), F.coalesce("min_col", F.lit(1)).alias("c1"), F.coalesce("max_col", "cols").alias("c2")).where("c1 <= c2")
    at = lambda i: F.array(F.col("place"), F.lit(i).cast("long"), F.lit(0).cast("long"))
    width = F.col("c2") - F.col("c1") + 1
    told = [F.when(F.col("r1") > 1, spot(at(0), F.col("sheet"), F.col("r1") - 1, F.col("c1")))]
    told += [F.when(F.col("r1") + F.floor(F.lit(i) / width) <= F.col("r2"), spot(at(i + 1), F.col("sheet"), F.col("r1") + F.floor(F.lit(i) / width), F.col("c1") + F.lit(i) % width)) for i in range(3)]
    asked = own.unionByName(r.select(key, F.explode(F.array_compact(F.array(*told))).alias("s"))).select(key, "s.*")
    met = asked.join(cells.where("is_text and value is not null").select("sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value"), ["sheet", "row", "col"])
    held = met.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("l"))  # four for the cell, and four for each reference
    return formulas.select(key).join(held, key, "left").select(key, F.coalesce(F.array_join(F.transform("l", lambda x: x["value"]), " "), F.lit("")).alias("labels"))


def unit(number_format: Column, formula: Column, labels: Column, is_date: Column) -> Column:
    """What a formula's result counts, from its format, the formula and the labels near it; the first rule that fits."""
    form, hay = F.coalesce(number_format, F.lit("")), F.lower(F.concat_ws(" ", formula, labels))
    # fixed values
    rules = (
        (F.contains(form, F.lit("%")) | hay.rlike("percent|percentage|rate|ratio|share"), "percentage"),
        (hay.rlike(r"hk\$'?000"), "HKD thousands"),
        (F.upper(formula).rlike(r"^=(COUNT|COUNTA|COUNTIF|COUNTIFS)\b"), "count"),
        (hay.rlike(r"\bminutes?\b|\(min\)"), "minutes"),
        (form.rlike("[$£€¥]") | hay.rlike("revenue|price|wage|income|cost|sales"), "currency or monetary amount"),
        (is_date | hay.rlike("date|month|year|time"), "date or time"),
        (hay.rlike("frequency|number of"), "count"),
    )
    out = F.lit("not identified")
    for rule, name in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def grid(cells: DataFrame, by: str, ref: str, value: str) -> DataFrame:
    """by, row, cells (column and value, in order): one row for each row of a sheet; cells whose reference can't be read have row null."""
    at = F.when(F.upper(ref).rlike(r"^[A-Z]+\d+$"), F.upper(ref))
    placed = cells.select(by, F.regexp_extract(at, r"(\d+)$", 1).cast("long").alias("row"), column_number(F.regexp_extract(at, "^([A-Z]+)", 1)).alias("column"), F.col(value).alias("value"))
    return placed.groupBy(by, "row").agg(F.array_sort(F.collect_list(F.struct("column", "value"))).alias("cells"))  # a sheet's row
