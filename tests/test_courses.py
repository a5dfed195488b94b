"""The stateful stream against a plain run over all items, with pauses, resumes and kills at every batch."""

import random
import shutil

import pytest

import sparkloom.streaming.courses as C

ITEMS = "course string, at long, text string"


def plain(batches, most=3, keep=15):
    """Outcomes of all batches, one course and item after the other."""
    held, out = {}, []
    for number, batch in enumerate(batches):
        for course in sorted({c for c, _, _ in batch}, key=str):
            s = held.setdefault(course, {"state": "idle", "bad": 0, "gists": [], "done": set(), "waiting": []})
            items = sorted(((a, t) for c, a, t in batch if c == course and a is not None), key=lambda x: x[0])
            if any(a is None and t == "resume" for c, a, t in batch if c == course):
                s["state"], s["bad"], items, s["waiting"] = "idle", 0, sorted(s["waiting"] + items, key=lambda x: x[0]), []
            for at, text in items:
                if at in s["done"]:
                    continue
                if s["state"] == "paused":
                    s["waiting"].append((at, text))
                    out.append((course, at, "waiting", None, None, "paused", s["bad"], number))
                    continue
                before = list(s["gists"])
                if not (text or "").strip():
                    s["bad"] += 1
                    s["state"] = "paused" if s["bad"] >= most else s["state"]
                    out.append((course, at, "failed", None, before, s["state"], s["bad"], number))
                else:
                    s["bad"], s["gists"] = 0, [*before, text.strip()][-keep:]
                    s["done"].add(at)
                    out.append((course, at, "done", text, before, s["state"], 0, number))
    return sorted(out, key=str)


def batches(seed):
    rng = random.Random(seed)
    out, at = [], 0
    for _ in range(4):
        rows = []
        for course in ("a", "b", None):
            for i in range(rng.randrange(3, 14)):
                rows.append((course, at + i, rng.choice([f"t{i} ", f"u{i}", "", None, " "]) if course != "b" else f"b{at + i}"))
            if out and rng.random() < 0.6:
                rows.append((course, None, "resume"))
                rows.append((course, rng.randrange(at), "again"))
        out.append(rows)
        at += 20
    return out


def outcomes(df):
    return sorted((tuple(list(x) if isinstance(x, list) else x for x in r) for r in df.collect()), key=str)


def add(spark, folder, k, rows):
    spark.createDataFrame(rows, ITEMS).coalesce(1).write.parquet(f"{folder}/in/{k}")


@pytest.mark.parametrize("killed", [None, 1, 2])
def test_a_killed_run_goes_on(spark, tmp_path, monkeypatch, killed):
    given = batches(3)
    source = spark.readStream.schema(ITEMS).parquet(f"{tmp_path}/in/*")
    for k, rows in enumerate(given):
        add(spark, tmp_path, k, rows)
        if k == killed:  # once before a batch's outcomes are written, once after
            keep = C._keep
            for early in (True, False):

                def stop(batch, number, sink, early=early):
                    if not early:
                        keep(batch, number, sink)
                    raise OSError("killed")

                with monkeypatch.context() as m:
                    m.setattr(C, "_keep", stop)
                    with pytest.raises(Exception, match="killed"):
                        C.run_courses(source, f"{tmp_path}/run")
        got = C.run_courses(source, f"{tmp_path}/run")
        assert outcomes(got) == plain(given[: k + 1])
    assert {r[2] for r in plain(given)} == {"done", "failed", "waiting"}
    # another driver, which has nothing but the folder
    shutil.copytree(f"{tmp_path}/run", f"{tmp_path}/moved")
    assert outcomes(C.outcomes(spark, f"{tmp_path}/moved")) == plain(given)


def test_three_failures_over_batches_pause(spark, tmp_path):
    source = spark.readStream.schema(ITEMS).parquet(f"{tmp_path}/in/*")
    for k, rows in enumerate(([("a", 0, "x"), ("a", 1, "")], [("a", 2, None)], [("a", 3, " ")], [("a", 4, "y")], [("a", None, "resume"), ("a", 3, "mended")])):
        add(spark, tmp_path, k, rows)
        got = C.run_courses(source, f"{tmp_path}/run")
    by_batch = {r.batch: (r.at, r.status, r.state) for r in got.orderBy("batch", "at").collect()}
    assert by_batch[2] == (3, "failed", "paused") and by_batch[3] == (4, "waiting", "paused") and by_batch[4] == (4, "done", "idle")
    assert [list(r.gists) for r in got.where("batch = 4").orderBy("at").collect()] == [["x"], ["x", "mended"]]


def test_the_last_gists_are_kept(spark, tmp_path):
    source = spark.readStream.schema(ITEMS).parquet(f"{tmp_path}/in/*")
    add(spark, tmp_path, 0, [("a", i, f"t{i}") for i in range(20)])
    run = C.CourseRun(generate=lambda text, gists: f"{text} after {len(gists)}", gist=lambda r: r.split()[0])
    got = {r["at"]: r for r in C.run_courses(source, f"{tmp_path}/run", run).collect()}
    assert got[19].result == "t19 after 15" and list(got[19].gists) == [f"t{i}" for i in range(4, 19)] and got[2].result == "t2 after 2"
