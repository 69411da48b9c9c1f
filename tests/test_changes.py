"""Ingest of a folder whose files are added, edited and deleted, with runs that are cut off."""

import os
import time

import pytest
from pyspark.sql import functions as F

from siltstone.operators.lines import explode_lines
from siltstone.streaming import changes


def work(docs):
    return {"lines": explode_lines(docs).select("source_file", "line_no", "raw"), "sizes": docs.select("source_file", F.length("text").alias("size"))}


def write(folder, name, text, at):
    path = folder / name
    path.write_text(text)
    os.utime(path, (at, at))


def rows(spark, target):
    lines = {}
    for r in changes.table(spark, target, "lines").orderBy("source_file", "line_no").collect():
        lines.setdefault(r.source_file, []).append(r.raw)
    sizes = {r.source_file: r["size"] for r in changes.table(spark, target, "sizes").collect()}
    return lines, sizes


def holds(spark, target, **texts):
    assert rows(spark, target) == ({f"{k}.md": t.split("\n") for k, t in texts.items()}, {f"{k}.md": len(t) for k, t in texts.items()})


def test_edits_deletions_and_restarts(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for name in "abc":
        write(folder, f"{name}.md", f"{name}\none", 1000)
    sync = lambda do=work: changes.sync_folder(spark, str(folder), do, target)
    assert sync() == 1 and sync() == 1
    holds(spark, target, a="a\none", b="b\none", c="c\none")
    reader = changes.table(spark, target, "sizes")

    write(folder, "a.md", "a\ntwo\nthree", 2000)
    write(folder, "d.md", "d", 2000)
    (folder / "b.md").unlink()
    asked = []

    def fails(docs):
        asked.extend(r.source_file for r in docs.collect())
        return {"lines": work(docs)["lines"], "sizes": docs.select("source_file", F.raise_error(F.lit("lost")).cast("int").alias("size"))}

    with pytest.raises(Exception, match="lost"):
        sync(fails)
    assert sorted(asked) == ["a.md", "d.md"]
    holds(spark, target, a="a\none", b="b\none", c="c\none")
    assert sync() == 2
    holds(spark, target, a="a\ntwo\nthree", c="c\none", d="d")
    assert sorted(r.source_file for r in reader.collect()) == ["a.md", "b.md", "c.md"]  # one that began before keeps its version

    assert changes.compact(spark, target, ("lines", "sizes")) == 3
    holds(spark, target, a="a\ntwo\nthree", c="c\none", d="d")
    assert {r.since for r in changes.sources(spark, target).collect()} == {3}

    (folder / "c.md").unlink()
    assert sync() == 4
    holds(spark, target, a="a\ntwo\nthree", d="d")
    for name in "ad":
        (folder / f"{name}.md").unlink()
    assert sync() == 5
    assert rows(spark, target) == ({}, {})


def test_odd_sources(spark, tmp_path):
    target = str(tmp_path / "out")
    seen = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", None), (None, "1")], "source_file string, stamp string")
    load = lambda changed: changed.withColumn("text", F.lit("x"))
    assert changes.sync(seen.limit(0), load, work, target) == 1
    assert changes.sync(seen, load, work, target) == 2 == changes.sync(seen, load, work, target)
    assert rows(spark, target)[1] == {"a": 1, "b": 1}


def test_follows(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    write(folder, "a.md", "a", 1000)
    query = changes.follow(spark, str(folder), work, target, str(tmp_path / "state"), every="1 second")
    try:
        for text, at in (("a", 1000), ("b", 2000)):
            write(folder, "a.md", text, at)
            until = time.time() + 90
            while time.time() < until and changes.latest(spark, target) < at / 1000:
                time.sleep(1)
            holds(spark, target, a=text)
    finally:
        query.stop()
