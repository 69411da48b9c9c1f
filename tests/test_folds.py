"""Folds against plain loops, and on groups of very many items."""

import random
import time

from pyspark.sql import functions as F

from siltstone.config import Settings
from siltstone.operators import chunks, folds, fusion, tables


def test_runs_and_numbers():
    assert folds.filled_runs([], 128) == [] and folds.filled_runs([2, 2, 2, 900, 2], 3) == [[0, 1], [2, 3], [4, 4]]
    assert folds.fitting_runs([], 3) == [] and folds.fitting_runs([9, 2, 2, 2], 3) == [[0, 0], [1, 2], [3, 3]]
    assert folds.bin_numbers([70, 10, 50, 1], 60) == [0, 1, 1, 2] and folds.group_numbers([1, 5, 2, 2], 3) == [0, 0, 1, 1]
    assert folds.choices([5, 9, 9, 4], [1, 4, 4, 4], [False, True, False, True], 10) == [1, 2, 0, 0]


def greedy(halves, least):
    out, half = [], None
    for x in halves:
        if half is not None and half // 2 + 1 < least:
            out[-1].append(x)
            half += x
        else:
            out.append([x])
            half = x
    return [sum(x) for x in out]


def many(spark, n, words=1):
    text = F.concat_ws(" ", F.array_repeat(F.lit("word"), words))
    row = lambda i: chunks._chunk(F.concat(F.lit("t"), i.cast("string")), text, i, i, F.lit(1), F.lit(2 * words).cast("long"))
    return spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), row).alias("chunks"))


def seconds(df):
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def test_large_documents_take_linear_time(spark):
    settings = Settings(chunk_min=16, chunk_max=48)
    merged = lambda n: many(spark, n, 5).select(chunks.merge_small(F.col("chunks"), settings).alias("chunks"))
    # one chunk of n paragraphs
    whole = lambda n: many(spark, n, 5).select(F.array(chunks._chunk(F.lit("t"), F.array_join("chunks.content", "\n\n"), F.lit(0), F.lit(n), F.lit(1), F.lit(10 * n))).alias("chunks"))
    split = lambda n: whole(n).select(chunks.split_large(F.col("chunks"), settings).alias("chunks"))
    bins = lambda n: many(spark, n, 5).select(chunks.bins_in_order(F.col("chunks.half"), 100).alias("bins"))
    rows = lambda n: spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.array(F.when(i % 4 == 1, "k").otherwise(""), i.cast("string"), F.lit(""))).alias("rows"))
    joined = lambda n: rows(n).select(tables.join_continuations(F.col("rows")).alias("rows"))
    n = 200_000
    assert merged(n).select(F.size("chunks")).first()[0] == n / 3 // 1 + 1
    assert split(n).select(F.size("chunks")).first()[0] == -(-n // 9)
    assert bins(n).select(F.array_max("bins")).first()[0] == n / 10 - 1
    assert joined(n).select(F.size("rows")).first()[0] == n / 4
    for work in (merged, split, bins, joined):
        work(1000).collect()
        small, large = seconds(work(n // 8)), seconds(work(n))
        # eight times the items: with the square of them it would be 64 times
        assert large < 24 * max(small, 0.5), (work, small, large)


def test_merge_and_split_keep_every_word(spark):
    rng = random.Random(2)
    rows = []
    for k in range(40):
        halves = [rng.randrange(1, 60) * 2 for _ in range(rng.randrange(0, 40))]
        rows.append((k, [(f"t{i}", " ".join(["w"] * (h // 2)), i, i, 1, h) for i, h in enumerate(halves)]))
    frame = spark.createDataFrame(rows, f"k int, chunks array<{chunks.CHUNK}>")
    for r in frame.select("k", "chunks", chunks.merge_small(F.col("chunks"), Settings(chunk_min=50)).alias("merged")).collect():
        assert [c.half for c in r.merged] == greedy([c.half for c in r.chunks], 50)
        assert "\n\n".join(c.content for c in r.merged) == "\n\n".join(c.content for c in r.chunks)
    for r in frame.select("chunks", chunks.split_large(F.transform("chunks", lambda c: chunks._chunk(c["title"], F.concat(c["content"], F.lit("\n\n"), c["content"]), c["start_line"], c["end_line"], c["heading_level"], 2 * c["half"])), Settings(chunk_max=50)).alias("parts")).collect():
        assert sum(c.half for c in r.parts) == 2 * sum(c.half for c in r.chunks)
        assert all(c.half // 2 + 1 <= 50 or "\n\n" not in c.content for c in r.parts)


def test_null_and_empty_groups(spark):
    frame = spark.createDataFrame([(1, None), (2, [])], f"k int, chunks array<{chunks.CHUNK}>")
    both = frame.select("k", chunks.split_large(chunks.merge_small(F.col("chunks"))).alias("c"), chunks.bins_in_order(F.col("chunks.half"), 5).alias("b"), chunks.groups_in_order(F.col("chunks.half"), 5).alias("g")).orderBy("k").collect()
    assert [tuple(r) for r in both] == [(1, None, None, None), (2, [], [], [])]
    none = spark.createDataFrame([], "query_id int, rank int, tokens int, original_tokens int, promoted boolean")
    assert fusion.budget(none).count() == 0


def test_folds_take_rows_a_stretch_at_a_time(monkeypatch):
    """Each row is folded by itself, whatever stretches a batch is cut into; null rows stay null."""
    import pyarrow as pa

    rows = [[1] * 4, [], None, [2] * 25, [3], [4] * 10, [5] * 9, None]
    monkeypatch.setattr(folds, "ITEMS", 10)
    most, concat = [], pa.concat_arrays
    monkeypatch.setattr(folds.pa, "concat_arrays", lambda parts: most.extend(parts) or concat(parts))
    got = folds.by_rows(lambda a: [len(a), sum(a)], folds.NUMBERS, pa.array(rows, pa.list_(pa.int64())))
    assert got.to_pylist() == [None if r is None else [len(r), sum(r)] for r in rows]
    assert [len(x) for x in most] == [3, 1, 1, 1, 2]
    assert folds.by_rows(len, folds.NUMBERS, pa.array([], pa.list_(pa.int64()))).to_pylist() == []
