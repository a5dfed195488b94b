"""Ordered work on the items of many courses as they come: each course keeps its state between batches, and a run may be killed anywhere.

A course remembers what is done, its last gists, how many items failed in a row and, once it has paused, the items that wait. Every item is
generated from the gists before it, so a course's items are worked on one after the other; courses are spread over the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloom.streaming.imports import stored_rows

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "course string, at long, status string, result string, gists array<string>, state string, failures int"


def as_given(text: str | None, gists: list[str]) -> str | None:
    """A generator for items whose text is their result already."""
    return text


class CourseRun(StatefulProcessor):
    """``generate(text, gists)`` gives an item's result; null and blank ones are failures. After ``most`` failures in a row a course pauses, until an item with the text ``resume`` and no place comes."""

    def __init__(self, generate: Callable[[str | None, list[str]], str | None] = as_given, gist: Callable[[str], str] = str.strip, most: int = 3, keep: int = 15):
        self.generate, self.gist, self.most, self.keep = generate, gist, most, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "state string, failures int, gists array<string>")
        self.done = handle.getMapState("done", "at long", "was boolean")
        self.waiting = handle.getListState("waiting", "at long, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))  # a batch's items of one course
        state, failures, gists = self.now.get() if self.now.exists() else ("idle", 0, [])
        gists = list(gists)
        resumed = bool((came["at"].isna() & (came["text"] == "resume")).any())
        items = came[came["at"].notna()].sort_values("at", kind="stable")
        queue = [(int(a), None if pd.isna(t) else t) for a, t in zip(items["at"], items["text"])]
        if resumed:
            state, failures = "idle", 0
            queue = sorted([(int(a), t) for a, t in self.waiting.get()] + queue, key=lambda x: x[0])
            self.waiting.clear()
        out = []
        for at, text in queue:
            if self.done.containsKey((at,)):
                continue
            if state == "paused":
                self.waiting.appendValue((at, text))
                out.append((key[0], at, "waiting", None, None, state, failures))
                continue
            before = list(gists)
            result = self.generate(text, before)
            if result is None or not result.strip():
                failures += 1
                state = "paused" if failures >= self.most else state
                out.append((key[0], at, "failed", None, before, state, failures))
                continue
            failures = 0
            gists = [*gists, self.gist(result)][-self.keep :]
            self.done.updateValue((at,), (True,))
            out.append((key[0], at, "done", result, before, state, failures))
        self.now.update((state, failures, gists))
        yield pd.DataFrame(out, columns=["course", "at", "status", "result", "gists", "state", "failures"])

    def close(self) -> None:
        pass


def _keep(batch: DataFrame, batch_id: int, sink: str) -> None:
    batch.write.mode("overwrite").parquet(f"{sink}/rows/batch={batch_id}")  # a batch that is run again writes the same folder


def run_courses(source: DataFrame, sink: str, run: CourseRun | None = None) -> DataFrame:
    """Work on what the stream ``source(course, at, text)`` has now; all outcomes so far, with their batch. Call it again to go on.

    State and progress lie under ``sink``, in the shared folder: another driver goes on from them.
    """
    spark = source.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        made = source.select("course", "at", "text").groupBy("course").transformWithStateInPandas(run or CourseRun(), OUT, "Append", "None")
        query = made.writeStream.foreachBatch(lambda b, i: _keep(b, i, sink)).option("checkpointLocation", f"{sink}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return outcomes(spark, sink)


def outcomes(spark: SparkSession, sink: str) -> DataFrame:
    return stored_rows(spark, sink, spark.createDataFrame([], OUT))
