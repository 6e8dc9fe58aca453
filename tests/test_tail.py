"""Growing files as a data source, in byte ranges and in a stream, and lines of metrics."""

from __future__ import annotations

import math

import pytest

from siltstone.sources import normalise, tail


def test_ranges_give_each_line_once(spark, tmp_path):
    tail.register(spark)
    texts = ["", "a", "né" * 40, "", "last without an end"]
    (tmp_path / "a.log").write_text("\n".join(texts), encoding="utf-8")
    (tmp_path / "b.log").write_text("x\r\ny\n")
    (tmp_path / "_hidden").write_text("no\n")
    (tmp_path / "empty.log").write_text("")
    for size in (1, 7, 1 << 20):
        rows = spark.read.format("tailed_lines").option("splitBytes", size).load(f"file://{tmp_path}").collect()
        assert [r.value for r in sorted(rows, key=lambda r: r.offset) if r.path.endswith("a.log")] == texts
        assert sorted(r.value for r in rows if r.path.endswith("b.log")) == ["x", "y"] and len(rows) == 7
    with pytest.raises(Exception, match="nothing-here"):
        spark.read.format("tailed_lines").load(f"{tmp_path}/nothing-here").collect()


def test_appended_lines_come_once(spark, tmp_path):
    tail.register(spark)
    data, out, state = tmp_path / "data", tmp_path / "out", tmp_path / "state"
    data.mkdir()
    sha = ["a" * 40, "b" * 40, "c" * 40]

    def turn():
        x = normalise.commits(spark.readStream.format("tailed_lines").load(str(data)))
        x.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start().awaitTermination(60)
        return sorted(r.sha[0] + " " + r.content for r in spark.read.parquet(str(out)).collect())

    log = data / "log.txt"
    log.write_text(f"{sha[0]}\tann\t2024-01-02\tone\n{sha[1]}\tbo\t2024-01-03\ttw")
    assert turn() == ["a one"]
    with log.open("a") as f:
        f.write(f"o\nnothing\n{sha[2]}\tcy\t2024-01-04\tthree\n")
    assert turn() == ["a one", "b two", "c three"] and turn() == ["a one", "b two", "c three"]


def test_metrics(spark):
    said = ["# HELP x y", "up 1", 'rate{job="a",path="b\\\\n\\"c\\n,d"} 2.5e3 1700000000', "low -Inf", "none NaN", "bad{ 3", "word abc", "", 'open{a="1",} +4']
    rows = {r.name: (r.labels, r.number) for r in tail.metrics(spark.createDataFrame([(x,) for x in said], "value string")).collect()}
    assert rows["up"] == ({}, 1.0) and rows["rate"] == ({"job": "a", "path": 'b\\n"c\n,d'}, 2500.0) and rows["open"] == ({"a": "1"}, 4.0)
    assert rows["low"][1] == -math.inf and math.isnan(rows["none"][1]) and len(rows) == 5
