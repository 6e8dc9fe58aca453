"""Watched folders, and patterns planted in series."""

from __future__ import annotations

import math
import os
import time

import pytest
from pyspark.sql import functions as F

from siltstone.sources import watch
from siltstone.streaming import signals


def found(spark, out, look):
    return {(os.path.basename(r.path), r.change, r.content) for r in watch.changes(spark, str(out)).where(F.col("look") == look).collect()}


def test_looks(spark, tmp_path):
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    assert watch.changes(spark, out).count() == 0
    (folder / "a.md").write_text("one")
    (folder / "b.md").write_text("two é")
    watch.look(spark, f"file://{folder}", out, 0)
    assert found(spark, out, 0) == {("a.md", "new", "one"), ("b.md", "new", "two é")}
    watch.look(spark, f"file://{folder}", out, 1)
    assert found(spark, out, 1) == set()
    # changed, touched, new and gone between two looks
    (folder / "a.md").write_text("three")
    os.utime(folder / "b.md", (time.time() + 5, time.time() + 5))
    (folder / "c.md").write_text("c")
    (folder / "empty.md").write_text("")
    watch.look(spark, f"file://{folder}", out, 2)
    assert found(spark, out, 2) == {("a.md", "changed", "three"), ("c.md", "new", "c")}
    os.remove(folder / "c.md")
    watch.look(spark, f"file://{folder}", out, 3)
    assert found(spark, out, 3) == {("c.md", "removed", None)}
    # a look that is done again finds the same, and the next nothing
    watch.look(spark, f"file://{folder}", out, 3)
    assert found(spark, out, 3) == {("c.md", "removed", None)}
    watch.look(spark, f"file://{folder}", out, 4)
    assert found(spark, out, 4) == set()


def test_watch_goes_on_after_a_restart(spark, tmp_path):
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    (folder / "a.md").write_text("one")

    def run(until):
        q = watch.watch(spark, f"file://{folder}", out, "1 second")
        try:
            for _ in range(240):
                if until():
                    break
                assert q.exception() is None
                time.sleep(0.25)
        finally:
            q.stop()

    def seen():
        return sorted((os.path.basename(r.path), r.change, r.content) for r in watch.changes(spark, out).collect())

    run(lambda: len(seen()) == 1)
    (folder / "a.md").write_text("two!")
    (folder / "b.md").write_text("b")
    looks = len(watch.numbers(spark, out))
    run(lambda: len(seen()) >= 3 and len(watch.numbers(spark, out)) >= looks + 2)
    assert seen() == [("a.md", "changed", "two!"), ("a.md", "new", "one"), ("b.md", "new", "b")]


def noise(i):
    return (i * 7919 % 13) / 13


SERIES = {
    "trend": [20 + i + 3 * noise(i) for i in range(96)], "spike": [20 + 4 * noise(i) + (60 if i == 50 else 0) for i in range(96)], "drop": [50 + 4 * noise(i) - (30 if i == 40 else 0) for i in range(96)],
    "stall": [30 + 4 * noise(i) if not 60 <= i < 63 else 0 for i in range(96)], "seasonality": [40 + 20 * math.sin(i * math.pi / 12) + noise(i) for i in range(96)], "recurrence": [20 + 3 * noise(i) + (50 if i % 16 == 5 else 0) for i in range(96)],
    "flat": [9] * 96,
}


@pytest.fixture(scope="module")
def planted(spark):
    rows = [(kind, 3600 * (500_000 + i), int(n)) for kind, values in SERIES.items() for i, n in enumerate(values) if int(n)]
    windows = spark.createDataFrame(rows, "event_type string, at long, n long").select("event_type", F.struct(F.timestamp_seconds("at").alias("start")).alias("window"), "n")
    return signals.patterns(windows).collect()


@pytest.mark.parametrize("kind", [k for k in SERIES if k != "flat"])
def test_planted_patterns(planted, kind):
    own = [r for r in planted if r.event_type == kind and r.pattern == kind]
    assert own and all(0 < r.strength <= 1 and 0 < r.confidence <= 1 and r.grade in ("clear", "likely", "possible") for r in own)
    hours = {(r.first_hour - 500_000, r.last_hour - 500_000) for r in own}
    expected = {"spike": {(50, 50)}, "drop": {(40, 40)}, "stall": {(60, 60), (61, 61), (62, 62)}, "recurrence": {(5, 85)}}
    assert hours == expected.get(kind, {(0, 95)})


def test_other_patterns(planted):
    by = {(r.event_type, r.pattern) for r in planted}
    assert ("spike", "anomaly") in by and not any(k == "flat" for k, _ in by)
    assert not {(k, "trend") for k in ("spike", "drop", "recurrence")} & by and not {(k, "recurrence") for k in ("trend", "spike", "drop", "stall", "seasonality")} & by
