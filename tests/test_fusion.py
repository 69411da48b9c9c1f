import random

import pytest
from pyspark.sql import functions as F

from siltstone.config import Settings
from siltstone.operators import fusion, search
from siltstone.plans import retrieve


def test_rrf_value(spark):
    dense = spark.createDataFrame([(1, "r", "a", 1)], "query_id int, role string, chunk_id string, rank int")
    bm25 = spark.createDataFrame([(1, "r", "a", 4), (1, "r", "b", 1)], "query_id int, role string, chunk_id string, rank int")
    got = {r.chunk_id: r.score for r in fusion.fuse(dense, bm25).collect()}
    assert got["a"] == pytest.approx(0.015932, abs=1e-6) and got["b"] == pytest.approx(0.6 / 61, abs=1e-8)


def test_best_takes_each_chunk_once(spark):
    rows = [(1, "a", "x", 1, None, 0.5), (1, "b", "x", 2, None, 0.4), (1, "a", "y", None, 1, 0.5), (1, "b", "z", 1, None, 0.5)]
    hits = spark.createDataFrame(rows, "query_id int, role string, chunk_id string, dense_rank int, bm25_rank int, score double")
    assert [r.chunk_id for r in fusion.best(hits, 2).orderBy("rank").collect()] == ["x", "y"]


def chunks_of(spark):
    rows = [("b1", f"c{k}", "sop", k, "H", "word " * n, n + 1) for k, n in enumerate((50, 60, 70))] + [("b2", "d0", "sop", 0, "H", "x", 2), ("b2", "d1", "notice", 1, "H", "y", 2), ("b3", "e0", "sop", 0, "H", "H\nz", 3)]
    return spark.createDataFrame(rows, "block_id string, chunk_id string, role string, chunk_idx int, heading_path string, content string, token_estimate int").withColumn("start_line", F.lit(1)).withColumn("source_file", F.lit("f"))


def test_promote_budget_and_context(spark):
    chunks = chunks_of(spark)
    hits = spark.createDataFrame([(1, 1, "c1", 0.9), (1, 2, "c0", 0.8), (1, 3, "d0", 0.7), (1, 4, "e0", 0.6)], "query_id int, rank int, chunk_id string, score double")
    got = fusion.promote(hits, chunks).orderBy("rank").collect()
    assert [(r.chunk_id, r.promoted, r.chunk_ids) for r in got] == [("c1", True, ["c0", "c1", "c2"]), ("d0", False, ["d0"]), ("e0", False, ["e0"])]
    assert got[0].tokens == 181 and got[0].original_tokens == 61
    small = fusion.within_budget(fusion.promote(hits, chunks), Settings(context_budget=66)).orderBy("rank").collect()
    assert [(r.chunk_id, r.demoted, r.tokens) for r in small] == [("c1", True, 61), ("d0", False, 2), ("e0", False, 3)]
    context = retrieve.passages(hits, chunks).first()
    assert context.context.startswith("[1] H (f)\n") and context.sources == ["c0", "c1", "c2", "d0", "e0"]


def test_budget_against_a_walk(spark):
    rng = random.Random(8)
    rows, expected = [], {}
    for q in range(30):
        used, taken = 0, []
        for rank in range(1, rng.randint(2, 25)):
            promoted = rng.random() < 0.5
            tokens = rng.randint(1, 4000)
            original = rng.randint(1, tokens) if promoted else tokens
            rows.append((q, rank, tokens, original, promoted))
            for size, demoted in ((tokens, False), (original, True)) if promoted else ((tokens, False),):
                if used + size <= 10000:
                    used += size
                    taken.append((rank, size, demoted))
                    break
        expected[q] = taken
    got = fusion.budget(spark.createDataFrame(rows, "query_id int, rank int, tokens long, original_tokens long, promoted boolean")).collect()
    for q, taken in expected.items():
        assert sorted((r.rank, r.tokens, r.demoted) for r in got if r.query_id == q) == taken


def test_repeated_headings_may_go(spark):
    rows = [("b", "a", "sop", 0, "H", "H\nx", 2), ("b", "c", "sop", 1, "H", "H\n\ny", 2)]
    chunks = spark.createDataFrame(rows, "block_id string, chunk_id string, role string, chunk_idx int, heading_path string, content string, token_estimate int").withColumn("start_line", F.lit(1))
    hits = spark.createDataFrame([(1, 1, "a", 0.9)], "query_id int, rank int, chunk_id string, score double")
    assert fusion.promote(hits, chunks, Settings(strip_repeated_heading=True)).first().content == "H\nx\n\ny"
    assert fusion.promote(hits, chunks).first().content == "H\nx\n\nH\n\ny"


def test_scores_are_dealt_by_text(spark, monkeypatch):
    """More scores than tasks should hold get more tasks, with the same hits."""
    docs = spark.createDataFrame([(k, f"a b{k % 3}", "r") for k in range(40)], "chunk_id long, text string, role string")
    queries = spark.createDataFrame([(1, "a b1"), (2, "a b2")], "query_id long, text string")
    run = lambda: search.bm25(docs, queries, 3, role="role")
    usual = sorted(map(tuple, run().collect()))
    monkeypatch.setattr(search, "PAIRS", 10)
    found = run()
    assert "hashpartitioning(chunk_id" in found._jdf.queryExecution().executedPlan().toString() and search.tasks_for(105, docs) == 11
    assert sorted(map(tuple, found.collect())) == usual and len(usual) == 6
