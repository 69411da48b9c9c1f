"""Work that grows with the input is dealt to tasks that stay bounded."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.config import Settings
from siltstone.functions import text as tx
from siltstone.operators import lines, outline, roles


def test_rows_are_dealt_to_as_many_tasks_as_they_need(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc"))
    assert lines.dealt(rows, 5 * lines.ROWS_A_TASK, "doc").rdd.getNumPartitions() == 5
    assert lines.dealt(rows, 50 * lines.ROWS_A_TASK, "doc").rdd.getNumPartitions() == 50
    assert lines.dealt(rows, 10, "doc").rdd.getNumPartitions() == 1


def test_cuts_by_a_fold_over_stretches():
    settings = Settings(block_max=5)
    # a block of level 1 with two sections, the second with two parts; a small block stays
    found = outline._pieces([1, 2, 2, 3, 3, 1], [2, 4, 2, 6, 8, 2], [0, 0, 0, 0, 0, 1], [1, 1, 1, 1, 1, 1], settings)
    assert found == [[0, 0], [1, 1, 1], [2, 2, 2], [3, 3, 2, 3], [4, 4, 2, 4], [5, 5]]


def test_a_split_sorts_lines_once_for_all_rounds(spark):
    raw = spark.createDataFrame([("d", n + 1, x) for n, x in enumerate(["# a", "one two three", "### b", "four five six", "### c", "seven"])], "source_file string, line_no int, raw string")
    parsed = lines.parse(raw)
    plan = outline.split_oversized(parsed, outline.measured_blocks(parsed), settings=Settings(block_max=3))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Window [") < 24
    got = [(r.title, r.start_line, r.end_line, list(r.breadcrumb)) for r in plan.orderBy("block_no").collect()]
    assert got == [("a", 1, 2, ["a"]), ("b", 3, 4, ["a", "b"]), ("c", 5, 6, ["a", "c"])]


def test_heading_candidates(spark):
    rows = [("# 1.2.3 deep", 3, "1.2.3 deep"), ("#none", 0, ""), ("12 parts", 0, ""), ("3.4 Sort", 2, "3.4 Sort"), ("0.4 Sort", 0, ""), ("一、x", 1, "一、x"), ("（二）y", 2, "（二）y"), ("## （二）y", 2, "（二）y"), ("", 0, "")]
    got = spark.createDataFrame([(x,) for x, _, _ in rows], "x string").select("x", tx.heading(F.col("x")).alias("h")).collect()
    assert [(r.x, r.h.level, r.h.title) for r in got] == rows


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_are_worked_out_once(spark):
    docs = spark.createDataFrame([("a", "h\nthe step", "src1"), ("b", "", None)], "chunk_id string, content string, heading_path string")
    words = [("sop", "body", "step", 3), ("notice", "heading", "src1", 2)]
    assert _plan(roles.scores(docs, words)).count("RLIKE") <= _plan(roles.scored(docs, words)).count("RLIKE")
    got = {(r.chunk_id, r.role): r.score for r in roles.scores(docs, words).collect()}
    assert (got["a", "sop"], got["a", "notice"], got["b", "junk"], len(got)) == (3, 4, 20, 18)


def test_low_margins_come_from_a_staged_table(spark):
    docs = spark.createDataFrame([("a", "h\nthe step of a long enough text", ""), ("b", "h\nnothing at all in this long text", "")], "chunk_id string, content string, heading_path string")
    low = roles.low_margin(roles.argmax(roles.scored(docs, [("sop", "body", "step", 3)])))
    assert "RLIKE" not in _plan(low)
    assert [(r.chunk_id, r.custom_id) for r in low.collect()] == [("b", 0)]
