"""Stored courses and artifacts, broken ones and their order; labels around formulas at a sheet's edges."""

import json

from sparkloom.operators.cells import labels_near
from sparkloom.sources.records import read_artifacts, read_courses


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_courses_by_age(spark, tmp_path):
    for name, value in {"b": {"id": "b", "title": "B", "created_at": 5}, "a": {"id": "a", "title": "A", "created_at": 5.0}, "new": {"title": "N", "created_at": 9}, "old": {"id": "x", "created_at": None}, "broken": "{", "list": [1], ".hidden": {"id": "h"}}.items():
        put(tmp_path / name / "course.json", value)
    put(tmp_path / "none" / "other.json", {})
    assert [(r.id, r.title) for r in read_courses(spark, str(tmp_path)).collect()] == [("x", ""), ("a", "A"), ("b", "B"), ("new", "N")]


def test_artifacts_in_order(spark, tmp_path):
    one = lambda i, **more: {"id": i, "content_hash": "h", "kind": "pdf", **more}
    put(tmp_path / "c" / "artifacts.json", [one("2", order=1, source_path="b", version=2, supersedes="1"), one("1", order=1, source_path="b"), one("3", order=1, source_path="a"), one("4", order=0, source_path="z", purpose="lecture"), {"id": "5"}, "text", None, one("")])
    put(tmp_path / "d" / "artifacts.json", [one("1", supersedes="none")])
    put(tmp_path / "e" / "artifacts.json", {"id": "no list"})
    rows = read_artifacts(spark, str(tmp_path)).collect()
    assert [(r.course, r.id) for r in rows] == [("c", "4"), ("c", "3"), ("c", "2"), ("d", "1")]
    assert (rows[0].purpose, rows[1].purpose, rows[1].version, rows[1].extraction_status) == ("lecture", "unknown", 1, "done")
    assert [r.id for r in read_artifacts(spark, str(tmp_path), include_superseded=True).where("course = 'c'").collect()] == ["4", "3", "1", "2"]


def test_labels_at_the_edges(spark):
    cells = spark.createDataFrame([("S", 1, 1, "top", True), ("S", 1, 2, "right", True), ("S", 2, 1, "9", False), ("S", 3, 2, "deep", True), ("T", 5, 5, "head", True), ("T", 6, 5, None, True), ("T", 6, 6, "v2", True), ("T", 7, 5, "v3", True)], "sheet string, row long, col long, value string, is_text boolean")
    formulas = spark.createDataFrame([(1, "S", 1, 1), (2, "S", 2, 2), (3, "S", 3, 5), (4, "U", 1, 1)], "k long, sheet string, row long, col long")
    box = "struct<sheet:string,min_col:long,min_row:long,max_col:long,max_row:long>"
    refs = spark.createDataFrame([(2, 0, ("T", 5, 6, 6, 7)), (2, 1, ("S", 1, 1, 1, None)), (3, 0, ("T", 5, 6, 5, 6)), (4, 0, ("nope", 1, 1, 1, 1)), (4, 1, None)], f"k long, place int, ref {box}")
    got = {r.k: r.labels for r in labels_near(formulas, refs, cells, "k").collect()}
    assert got == {1: "top", 2: "right head v2 v3 top", 3: "deep head", 4: ""}
