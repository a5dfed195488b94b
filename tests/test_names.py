"""Titles, folder trees and whole profiles on their own cases."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.text import deck_label
from sparkloom.operators.profiles import whole_profile
from sparkloom.operators.store import folder_tree, free_hues, relative_members

TITLES = {
    "Lec01_Data_and_Vibe_Coding_FINAL.pptx": "Lec01 Data and Vibe Coding", "lecture 3 - regression.pptx": "Lecture 3 Regression", "Lecture___4.pptx": "Lecture 4",
    "ADVANCED_TOPICS.pptx": "Advanced Topics", "INTRO.pptx": "Intro", "  week 2  ": "Week 2", "final.pdf": "Final", "notes_final2_v3_draft": "Notes", "THE END OF THE WEEK": "The End of the Week",
    "iPhone_sales v": "iPhone Sales", "2024-05": "2024 05", "a.b.pdf": "A.b", "copy-copy-copy": "Copy", "": "", "   ": "", None: None, "x.toolong123": "X.toolong123",
}


def test_deck_labels(spark):
    df = spark.createDataFrame([(t,) for t in TITLES], "t string")
    got = {r.t: r.label for r in df.select("t", deck_label(F.col("t")).alias("label")).collect()}
    assert got == TITLES
    again = df.select(deck_label(F.col("t")).alias("a")).select("a", deck_label(F.col("a")).alias("b")).collect()
    assert all(r.a == r.b for r in again if "." not in (r.a or ""))  # a full stop left inside may look like another ending


TREES = {
    "units": (["C/Week 1/a.pdf", "C/lec2/b.pdf", "C/L 3/x/c.pdf"], ["C"] * 3),
    "direct": (["C/a.pdf", "C/Algebra/b.pdf"], ["C"] * 2),
    "courses": (["Courses/Week 1/a.pdf", "Courses/Law/b.pdf"], ["Week 1", "Law"]),
    "generic": (["course materials/Only/a.pdf"], ["Only"]),
    "folders": (["C/Law/a.pdf", "C/Biology/b.pdf", "C/week 1/c.pdf"], ["Law", "Biology", "week 1"]),
    "single": (["C/Law/a.pdf", "C/Law/b.pdf"], [None] * 2),
    "roots": (["C/Law/a.pdf", "D/Law/b.pdf"], [None] * 2),
    "bare": (["C/Law/a.pdf", "b.pdf"], [None] * 2),
    None: (["C/Week 1/a.pdf"], ["C"]),
}


def test_folder_trees(spark):
    rows = [(k, p, g) for k, (paths, groups) in TREES.items() for p, g in zip(paths, groups)]
    out = folder_tree(spark.createDataFrame(rows, "k string, path string, want string"), "k", "path").collect()
    assert len(out) == len(rows) and all(r.group == r.want for r in out)
    assert all((r.reason is None) == (r.group is None) and (r.group is None or f'"{r.group}"' in r.reason) for r in out)


def test_relative_members(spark):
    rows = [("a", "Up/Law/L1/x.pdf", "LAW ", "L1/x.pdf"), ("a", "Law/y.pdf", "LAW ", "y.pdf"), ("b", "R/S/1/x.pdf", "none", "1/x.pdf"), ("b", "R/S/y.pdf", "none", "y.pdf"), ("c", "q.pdf", "q.pdf", "q.pdf"), (None, "A/B/c.pdf", "x", "c.pdf")]
    out = relative_members(spark.createDataFrame(rows, "k string, path string, title string, want string"), "k", "path", "title").collect()
    assert len(out) == 6 and all(r.relative == r.want for r in out)


@pytest.mark.parametrize("cap", [10_001, 50])
def test_whole_profile(spark, cap):
    rng = random.Random(1)
    value = lambda: rng.choice([None, "", " ", "1", "2.5", "x", "2024-01-02", str(rng.randrange(300))])
    rows = [(i, value(), None, "same", float(i % 7) if i % 3 else None) for i in rng.sample(range(1000), 1000)]
    df = spark.createDataFrame(rows, "i long, a string, b string, c string, d double").repartition(5)
    got = {r.name: r for r in whole_profile(df, "i", cap=cap).collect()}
    rows.sort()
    kinds = lambda v: "missing" if not v.strip() else "integer" if v.isdigit() else "number" if v.replace(".", "", 1).isdigit() else "date_or_datetime" if v.startswith("2024-") else "text"
    for name, at in (("i", 0), ("a", 1), ("b", 2), ("c", 3), ("d", 4)):
        values = ["" if r[at] is None else str(r[at]) for r in rows]
        seen = [kinds(v) for v in values]
        r = got[name]
        assert r.row_count == 1000 and r.missing_count == seen.count("missing") and r.unique_count == min(cap, len(set(values)))
        assert r.type_counts.asDict() == {k: seen.count(k) for k in ("date_or_datetime", "integer", "missing", "number", "text")}
        assert list(r.samples) == list(dict.fromkeys(v for v, k in zip(values, seen) if k != "missing"))[:5]
        real = [k for k in seen if k != "missing"]
        assert r.inferred == (max(dict.fromkeys(real), key=real.count) if real else "unknown")
    none = {r.name: r for r in whole_profile(df.limit(0), "i").collect()}
    assert none["a"].row_count == 0 and none["a"].inferred == "unknown" and none["a"].unique_count == 0 and list(none["a"].samples) == []


def test_free_hues(spark):
    for seed in range(6):
        rng = random.Random(seed)
        own = {f"c{rng.randrange(1000)}": rng.randrange(3 if seed % 2 else 6) for _ in range(rng.choice([0, 3, 6, 40]))}
        taken, want = set(), {}
        for k in sorted(own):
            free = [(own[k] + s) % 6 for s in range(6) if (own[k] + s) % 6 not in taken]
            want[k] = free[0] if free else own[k]
            taken.add(want[k])
        df = spark.createDataFrame([(k, h) for k, h in own.items()] * 2, "id string, h int")
        hue = F.element_at(F.create_map(*[x for k, h in own.items() for x in (F.lit(k), F.lit(h))]), F.col("id")) if own else F.lit(0)
        assert {r.id: r.hue for r in free_hues(df, "id", hue, 6).collect()} == want
