"""Places, medians and ranges against plain versions, with nulls, ties, huge groups and open ends."""

import random
import statistics

from pyspark.sql import functions as F

from sparkloom.operators import cells as C
from sparkloom.operators.ranks import medians, running
from sparkloom.operators.store import upsert_last


def test_running(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50), i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long, i long, n long")
    got = {r.i: r.before for r in running(df, ["k", "v", "i"], "n", rows=200).collect()}
    total = 0
    for _, _, i, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        assert got[i] == total
        total += n
    assert running(df.limit(0), ["k"]).count() == 0


def test_medians(spark):
    rng = random.Random(2)
    rows = [("hot", float(rng.choice([1, 1, 1, 2, rng.random()]))) for _ in range(4001)] + [("odd", 3.0)] * 5 + [(None, 1.5), (None, -2.5), ("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.median for r in medians(df, "k", "v", rows=100).collect()}
    want = {k: statistics.median(v for x, v in rows if x == k and v is not None) for k in ("hot", "odd", None)}
    assert got == want
    # no task of the ranking holds more than its range: values are distinct within a group by then
    assert medians(df.where("k = 'none'"), "k", "v").count() == 0


def test_upsert_to_the_end(spark):
    old = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2), (None, 5)], "k string, at long")
    new = spark.createDataFrame([("b", 9), ("d", 4), ("b", 7)], "k string, at long")
    got = sorted((r.place, r.k, r["at"]) for r in upsert_last(old, new, "k", "at").collect())
    assert got == [(0, "c", 2), (1, "a", 3), (2, None, 5), (3, "d", 4), (4, "b", 9)]


def plain(refs, cells, most, sample=8):
    out = {}
    for k, r in refs:
        sheet_cells = {(row, col): v for s, row, col, v in cells if r and s == r[0]}
        if not r:
            out[k] = ("unsupported reference", None, None, [])
            continue
        if not sheet_cells:
            out[k] = ("unknown sheet", None, None, [])
            continue
        c1, r1, c2, r2 = r[1] or 1, r[2] or 1, r[3] or max(c for _, c in sheet_cells), r[4] or max(x for x, _ in sheet_cells)
        if most is not None and (r2 - r1 + 1) * (c2 - c1 + 1) > most:
            out[k] = ("too many cells", None, None, [])
            continue
        met = [v for (row, col), v in sorted(sheet_cells.items()) if r1 <= row <= r2 and c1 <= col <= c2 and v is not None]
        out[k] = (None, (r2 - r1 + 1) * (c2 - c1 + 1), len(met), met[:sample])
    return out


def test_ranges_meet_cells_by_blocks(spark):
    rng = random.Random(3)
    places = sorted({(rng.choice(["S", "T"]), rng.choice([1, 2, 7, 8, 9, 16, 17, rng.randrange(1, 200)]), rng.randrange(1, 6)) for _ in range(500)})
    cells = [(s, row, col, rng.choice([f"v{row}.{col}", f"v{row}.{col}", None])) for s, row, col in places]
    refs = [(0, None), (1, ("U", 1, 1, 1, 1)), (2, ("S", 1, 1, 5, 900)), (3, ("S", 9, 3, 9, 5)), (4, ("T", None, 3, None, 3)), (5, ("T", 2, None, 3, None)), (6, ("S", 2, 8, 4, 7))]
    for k in range(7, 120):
        a, b = sorted(rng.randrange(1, 7) for _ in "ab")
        x, y = sorted(rng.randrange(1, 210) for _ in "ab")
        refs.append((k, (rng.choice("ST"), a, x, b, y)))
    df = spark.createDataFrame(refs, "k long, ref struct<sheet:string,min_col:long,min_row:long,max_col:long,max_row:long>")
    table = spark.createDataFrame(cells, "sheet string, row long, col long, value string")
    for rows, most in ((8, 250), (1024, None), (1, 250_000)):
        got = {r.k: (r.error, r.cell_count, r.nonblank_count, list(r.sample)) for r in C.resolved(df, table, "k", most, rows=rows).collect()}
        assert got == plain(refs, cells, most)


def test_many_references_to_a_long_column(spark):
    # as many as would meet a thousand million cells one by one
    cells = spark.range(100_000).select(F.lit("S").alias("sheet"), (F.col("id") + 1).alias("row"), F.lit(1).alias("col"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("value"))
    refs = spark.range(20_000).select(F.col("id").alias("k"), F.struct(F.lit("S").alias("sheet"), F.lit(1).alias("min_col"), (F.col("id") + 1).alias("min_row"), F.lit(1).alias("max_col"), (F.col("id") + 50_000).alias("max_row")).alias("ref"))
    got = C.resolved(refs, cells, "k")
    bad = got.where((F.col("cell_count") != 50_000) | (F.abs(F.col("nonblank_count") - 33_333) > 1) | (F.size("sample") != 8) | ~(F.try_element_at("sample", F.lit(1)).cast("long") - F.col("k")).between(0, 1))
    assert got.count() == 20_000 and bad.count() == 0


def test_table_references(spark):
    tables = spark.createDataFrame([("Sales", "S", 2, 3, 9, ["Region", "Amount"], True), ("Sales", "Z", 1, 1, 2, ["Amount"], False), ("Old", "S", 1, 20, 22, ["Amount"], None)], "name string, sheet string, min_col int, min_row int, max_row int, headers array<string>, totals boolean")
    texts = [" Sales[Amount] ", "Sales[Region]", "Old[Amount]", "Sales[Nope]", "None[Amount]", "A1:B2", None, "Sales[]"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r.k: r.ref and tuple(r.ref) for r in C.table_reference(df, tables).collect()}
    assert got == {0: ("S", 3, 4, 3, 8), 1: ("S", 2, 4, 2, 8), 2: ("S", 1, 21, 1, 22), 3: None, 4: None, 5: None, 6: None, 7: None}
