"""Weighted Lloyd, heap counts and hard negatives against brute force, with odd inputs."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import centroids, merges, negatives

BYTES = P.path("byte_bpe_50k.json")


def clash(frame, *names):
    for name in names:
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


# ------------------------------------------------------------------ Lloyd


def lloyd(rows, k, rounds, dimensions, seed=3):
    kept = [(i, tuple(math.floor(1024 * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    middle = [list(v) for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    place = lambda v: min((far(v, c), n) for n, c in enumerate(middle))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[place(v)[1]].append(v)
        middle = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if own[n] else c for n, c in enumerate(middle)]
    placed = [(i, *place(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, d, c in placed:
        inertia[c] += d
    return sorted((repr(i), c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, middle[c])).encode()).hexdigest()) for i, d, c in placed)


def clustered(frame, **more):
    out = centroids.cluster(clash(frame, "key", "vector", "weight", "cluster", "id"), **more)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out.collect())


@pytest.mark.parametrize("kind", ["float", "double"])
def test_lloyd_against_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    narrow = lambda v: [float(np.float32(x)) for x in v]
    # a third of the rows have one vector; others are equal only once quantised
    rows = [(k, narrow(rng.normal(size=3) + (k % 4))) for k in range(200)] + [(k, [0.5, -0.25, 0.0]) for k in range(200, 320)]
    rows += [(k + 1000, [float(np.float32(x + 1e-5)) for x in v]) for k, v in rows[:50]]
    rows += [(7, rows[7][1]), (None, [1.0, 2.0, 3.0]), (900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [1.0, math.nan, 2.0]), (905, [1.0, math.inf, 2.0]), (906, [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    assert clustered(frame, dimensions=3, k=5, rounds=4) == lloyd(rows, 5, 4, 3)
    assert clustered(frame, dimensions=3) == lloyd(rows, 8, 10, 3)


def test_lloyd_floors_below_zero_and_breaks_ties(spark):
    rows = [(k, [-(k % 5) / 1024, (k % 3) / 1024 - 0.0001]) for k in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert clustered(frame, dimensions=2, k=3) == lloyd(rows, 3, 10, 2)


def test_lloyd_on_few_and_no_rows(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert clustered(frame, dimensions=2) == lloyd([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 8, 10, 2)
    assert clustered(frame.limit(0), dimensions=2) == []
    # beyond what squared distances in longs allow
    assert clustered(spark.createDataFrame([(1, [1e9, 2.0])], "vec_id long, embedding array<double>"), dimensions=2) == []


def test_lloyd_adds_up_large_weights(spark):
    high = 2**27 / 1024
    points = spark.createDataFrame([(b"a", 2**40, [2**27, 0]), (b"b", 3, [2**27 - 2, 1])], "key binary, weight long, vector array<int>")
    got = {(r.cluster, r.at): (r.weight, int(r.total)) for r in centroids.sums(points, np.array([[0, 0]])).collect()}
    assert got == {(0, 0): (2**40 + 3, 2**67 + 3 * (2**27 - 2)), (0, 1): (2**40 + 3, 3)}
    assert clustered(spark.createDataFrame([(1, [high, -high])], "vec_id long, embedding array<double>"), dimensions=2)[0][2] == 0


# ------------------------------------------------------------------ counts


def test_heap_counts_against_the_library(spark):
    rng = random.Random(5)
    library = Tokenizer.from_file(BYTES)
    pieces = ["hello", " world", "don't", " we'LL", "'s", "  ", "\n\n", "\t", " ", "é", "漢字", "🙂", "é", "1234", " 12a", "<|endoftext|>", "<|endoftext", "|>", "ſ", "ß", "\r\n", "!!!", "a" * 70, "_-_", "　", "\x00", "日本語", "Ⅷ", "٣", "ǅ"]
    texts = [None, "", " ", "<|endoftext|>", " <|endoftext|> <|endoftext|><|endoftext|>x", "ab" * 40_000, "x " * 60_000, "🙂" * 30_000, "a1" * 50_000, "word." * 30_000 + "<|endoftext|>" + "\n" * 70_000]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(160, 0x2FF), rng.randrange(0x3040, 0x30FF)))) for _ in range(40)) for _ in range(500)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, texts[5]), (None, "null id")]
    got = merges.count_tokens(clash(spark.createDataFrame(rows, "doc_id long, text string"), "n_tokens", "__text2"), BYTES).collect()
    expected = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got), key=repr) == sorted(((*e, e[2] > 1024) for e in expected), key=repr)


def test_heap_counts_of_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    library = Tokenizer.from_file(BYTES)
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    expected = {i: len(e.ids) for i, e in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    assert {r.doc_id: r.n_tokens for r in merges.count_tokens(documents, BYTES).collect()} == expected


def test_heap_takes_the_least_rank_and_then_the_leftmost():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("ab", "c"): 2, ("a", "a"): 3, ("aa", "aa"): 4}
    assert merges.merged("abc", ranks) == 2  # a, bc
    assert merges.merged("ab", ranks) == 1
    assert merges.merged("aaaaa", ranks) == 2  # aaaa, a
    assert merges.merged("", ranks) == 0 and merges.merged("xyz", ranks) == 3
    assert merges.merged("a" * 300_001, ranks) == 75_001


def test_heap_counts_refuse_other_files(spark):
    with pytest.raises(ValueError, match="byte-level"):
        merges.Counting(P.path("word_bpe_49k.json"))
    assert merges.count_tokens(spark.createDataFrame([], "doc_id long, text string"), BYTES).count() == 0


# ------------------------------------------------------------------ negatives


def mined(rows, every=100, positives=5, k=10, low=30, high=90):
    kept = {(i, y, tuple(math.floor(256 * float(x)) for x in v)) for i, y, v in rows if None not in (i, y, v) and len(v) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, y, v in kept:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, z, w in kept if j != i and len(w) == len(v))
            for p, j, _ in [s for s in scored if s[2] == y][:positives]:
                inside = [(n, m) for n, m, z in scored if z != y and low * -p <= 100 * -n <= high * -p][:k]
                out += [(i, j, r, m, -p, -n) for r, (n, m) in enumerate(inside, 1)]
    return sorted(out)


def got_negatives(frame, **more):
    return sorted(tuple(r) for r in negatives.mine(clash(frame, "part", "which", "cells", "id", "score", "side"), **more).collect())


@pytest.mark.parametrize("part_bytes", [negatives.PART_BYTES, 3000])
def test_negatives_against_brute_force(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(negatives, "PART_BYTES", part_bytes)
    rng = np.random.default_rng(6)
    rows = [(k, int(rng.integers(0, 4)), [float(x) for x in rng.normal(size=5) + 0.5]) for k in range(400)]
    # one vector for a third of the rows, ties and rows that repeat
    rows += [(k, k % 3, [0.5, 0.5, 0.25, 0.0, 1.0]) for k in range(400, 600)]
    rows += [(0, 2, [1.0, 1.0, 1.0, 1.0, 1.0]), (100, 1, [0.0] * 5), rows[150], rows[150], (700, 1, [-1.0, -1.0, -1.0, -1.0, -1.0]), (800, 9, [1.0] * 5)]
    rows += [(900, None, [1.0] * 5), (None, 1, [1.0] * 5), (1000, 1, None), (1100, 1, []), (1200, 1, [1.0, None, 1.0, 1.0, 1.0]), (1300, 1, [math.nan] * 5), (1400, 1, [math.inf] * 5)]
    rows += [(k, k % 2, [1.0, float(k % 7) / 7]) for k in range(2000, 2060)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    expected = mined(rows)
    assert len(expected) > 100 and got_negatives(frame) == expected
    assert got_negatives(frame, every=50, positives=2, k=3, low=50, high=99) == mined(rows, 50, 2, 3, 50, 99)


def test_negatives_on_few_and_no_rows(spark):
    frame = spark.createDataFrame([(0, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 0, [0.5, 0.5])], "vec_id long, label int, embedding array<float>")
    assert got_negatives(frame) == [(0, 1, 1, 2, 131072, 65536)]
    assert got_negatives(frame.where("vec_id <> 1")) == [] and got_negatives(frame.where("vec_id <> 2")) == [] and got_negatives(frame.limit(0)) == []


def test_bounds_hold_and_leave_most_out():
    rng = np.random.default_rng(7)
    vectors = np.floor(256 * rng.normal(size=(5000, 64))).astype(np.int32)
    vectors[:, 3] = 5  # one value only
    cells, marks = negatives.approximate(vectors)
    part = negatives.Part(negatives.pd.DataFrame({"label": np.arange(5000) % 10, "vec_id": np.arange(5000), "vector": list(vectors), "cells": [c.tobytes() for c in cells], "marks": [marks.tobytes()] + [None] * 4999}))
    anchor = np.floor(256 * rng.normal(size=64)).astype(np.int64)
    lower, upper = part.bounds(anchor, slice(0, 5000))
    scores = part.scores(anchor, np.arange(5000))
    assert (lower <= scores).all() and (scores <= upper).all()
    assert (upper >= negatives.kth_largest(lower, 5, 0)).sum() < 50
