"""The index of postings against the search over texts, role order, and look-ups by rare stretches and characters."""

import itertools
import random
import uuid
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from siltstone.config import Settings
from siltstone.operators import catalog, postings, search
from siltstone.plans import retrieve

WORDS = ["the", "of", "alpha", "beta", "gamma", "delta", "epsilon", "zeta"]


@pytest.fixture
def index(spark, tmp_path):
    name = f"index_{uuid.uuid4().hex}"
    postings.create(spark, name, path=str(tmp_path / name))
    yield name
    postings.drop(spark, name)


def chunks_of(spark, n, seed=1, first=0):
    rng = random.Random(seed)
    # two words in nearly every chunk, the others ever rarer
    text = lambda: " ".join(rng.choices(WORDS, [40, 30, 12, 8, 5, 3, 1.5, 0.5], k=rng.randrange(1, 30)))
    rows = [(f"c{first + k:04d}", text(), rng.choice(["a", "b", "c"])) for k in range(n)]
    return spark.createDataFrame(rows, "chunk_id string, text string, role string")


def found(df):
    return sorted((r.query_id, r.role, r.rank, r.chunk_id, r.score) for r in df.collect())


@pytest.mark.parametrize("group", [8, 128])
def test_index_gives_what_the_texts_give(spark, index, monkeypatch, group):
    monkeypatch.setattr(postings, "GROUP", group)
    parts = [chunks_of(spark, 150, 1), chunks_of(spark, 80, 2, 1000), spark.createDataFrame([("e1", "", "a"), ("e2", None, "b"), ("e3", "the the the zeta", "c")], "chunk_id string, text string, role string")]
    queries = spark.createDataFrame([(1, "zeta the"), (2, "of the the OF"), (3, "epsilon, delta! gamma"), (4, "unknown"), (5, ""), (6, None), (7, "beta")], "query_id int, text string")
    asked = spark.createDataFrame([(q, r) for q in range(1, 8) for r in ("c", "a")], "query_id int, role string")
    every = None
    for k, part in enumerate(parts):
        postings.insert(part, index, f"part{k}")
        every = part if every is None else every.unionByName(part)
        assert found(postings.search(queries, index, 5, asked=asked)) == found(search.bm25(every, queries, 5, role="role", asked=asked))
    whole = lambda df: sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in df.collect())
    assert whole(postings.search(queries, index, 7)) == whole(search.bm25(every, queries, 7))
    assert whole(postings.search(queries.limit(0), index, 7)) == []


def test_insert_counts_once_and_whole(spark, index, monkeypatch):
    part = chunks_of(spark, 40)
    queries = spark.createDataFrame([(1, "alpha the")], "query_id int, text string")
    # an insert that breaks off after its postings: nothing of it is seen
    with monkeypatch.context() as broken:
        broken.setattr(type(spark), "createDataFrame", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            postings.insert(part, index, "k")
    assert spark.table(f"{index}_postings").count() > 0 and found(postings.search(queries, index, 50)) == []
    for _ in range(2):
        assert postings.insert(part, index, "k") == "k"
    assert found(postings.search(queries, index, 50)) == sorted((r.query_id, r.role, r.rank, r.chunk_id, r.score) for r in search.bm25(part, queries, 50).join(part.select("chunk_id", "role"), "chunk_id").collect())


def test_search_opens_the_folders_of_its_terms_only(spark, index):
    postings.insert(chunks_of(spark, 60), index)
    rows = spark.table(f"{index}_postings")
    one = spark.createDataFrame([(1, "zeta")], "query_id int, term string")
    opened = postings._wanted(rows, one)
    folders = {r.bucket for r in rows.select("bucket").distinct().collect()}
    assert len(folders) > 3 and {f.split("bucket=")[1].split("/")[0] for f in opened.select("term").inputFiles()} <= {str(b) for b in folders}
    assert "PartitionFilters: [isnotnull(bucket" in opened._jdf.queryExecution().toString() and {r.term for r in opened.collect()} == {"zeta"}


def test_ties_go_by_the_order_of_the_roles_asked(spark):
    chunks = spark.createDataFrame([("x1", "alpha", "emergency"), ("x2", "alpha", "sop"), ("x3", "alpha beta", "notice")], "chunk_id string, text string, role string")
    vectors = spark.createDataFrame([("x1", [1.0, 0.0], "emergency"), ("x2", [1.0, 0.0], "sop"), ("x3", [0.0, 1.0], "notice")], "chunk_id string, vector array<double>, role string")
    asks = [["sop", "emergency"], ["emergency", "sop"], ["notice", "sop", "emergency", "sop"], ["none"], [], None]
    queries = spark.createDataFrame([(k, "alpha", r) for k, r in enumerate(asks)], "query_id int, text string, roles array<string>")
    targets = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(6)], "query_id int, vector array<double>")
    got = {}
    for r in retrieve.hybrid(chunks, vectors, queries, targets, Settings(roles=("notice", "emergency"))).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {0: ["x2", "x1"], 1: ["x1", "x2"], 2: ["x3", "x2", "x1"], 4: ["x3", "x1"], 5: ["x3", "x1"]}


def test_dense_compares_only_the_asked_roles_on_both_ways(spark, monkeypatch):
    rng = random.Random(3)
    vectors = spark.createDataFrame([(k, [rng.random(), rng.random()], "abc"[k % 3]) for k in range(60)], "chunk_id int, vector array<double>, role string")
    queries = vectors.where("chunk_id < 4").select(F.col("chunk_id").alias("query_id"), "vector")
    asked = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (2, "z")], "query_id int, role string")
    one = found(search.dense(vectors, queries, 5, role="role", asked=asked))
    assert {(q, r) for q, r, *_ in one} == {(0, "a"), (1, "b"), (1, "c")} and len(one) == 15
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    assert found(search.dense(vectors, queries, 5, role="role", asked=asked)) == one


@pytest.mark.parametrize("bound, cells", [(1 << 24, 1 << 22), (1 << 24, 300), (4000, 1 << 22), (3000, 50)])
def test_dense_in_blocks_against_all_pairs(spark, monkeypatch, bound, cells):
    """Blocks of queries and of cells, ties, copies, odd vectors."""
    monkeypatch.setattr(search, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(search, "CELLS", cells)
    rng = random.Random(8)
    vectors = [[float(rng.randint(-2, 2)) for _ in range(3 if k % 9 else 4)] for k in range(150)] + [None, [], [0.0, 0.0, 0.0], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]]
    rows = spark.createDataFrame(list(enumerate(vectors)), "chunk_id int, vector array<double>").repartition(5)
    got = {}
    for r in search.dense(rows, rows.where("chunk_id % 3 = 0").withColumnRenamed("chunk_id", "query_id"), 7).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.chunk_id, round(r.score, 6))
    length = lambda v: sum(x * x for x in v) ** 0.5
    for q in range(0, len(vectors), 3):
        a = vectors[q]
        scored = [(round(sum(x * y for x, y in zip(a, b, strict=True)) / length(a) / length(b), 9), k) for k, b in enumerate(vectors) if a and b and len(a) == len(b) and length(a) and length(b)]
        best = sorted(scored, key=lambda x: (-x[0], x[1]))[:7]
        assert got.get(q, {}) == {n + 1: (k, round(s, 6)) for n, (s, k) in enumerate(best)}


# ------------------------------------------------------------------ look-ups


def test_containment_by_rare_stretches(spark):
    rng = random.Random(4)
    strings = lambda n, most: sorted({"".join(rng.choices("abc漢 ", k=rng.randrange(1, most))) for _ in range(n)})
    parts, wholes = strings(120, 8), strings(120, 30) + ["", "a" * 3000]
    one = spark.createDataFrame([(p,) for p in parts], "part string")
    other = spark.createDataFrame([(w,) for w in wholes], "whole string")
    got = sorted((r.part, r.whole) for r in catalog._within(one, other).collect())
    assert got == sorted((p, w) for p, w in itertools.product(parts, wholes) if p in w)
    assert catalog._within(one.limit(0), other).count() == 0 and catalog._within(one, other.limit(0)).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.6, 0.9])
def test_similar_pairs_are_all_candidates(spark, least):
    rng = random.Random(5)
    base = ["".join(rng.choices("etaoinshrdlu", [12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3], k=rng.randrange(3, 14))) for _ in range(60)]
    change = lambda s: "".join(rng.choice("xyz") if rng.random() < 0.15 else c for c in s)
    asked, entries = sorted({change(s) for s in base} | {"", "漢字"}), sorted({*base, "漢字かな"})
    a, e = spark.createDataFrame([(x,) for x in asked], "asked string"), spark.createDataFrame([(x,) for x in entries], "entry string")
    met = {(r.asked, r.entry) for r in catalog.alike_candidates(a, e, least).collect()}
    wanted = {(x, y) for x, y in itertools.product(asked, entries) if x and y and SequenceMatcher(None, x, y).ratio() >= least}
    assert wanted <= met
    if least == 0.9:
        assert len(met) < 0.1 * len(asked) * len(entries)
    got = {(r.asked, r.entry) for r in catalog._alike(a, e, least).collect()}
    assert got == wanted


def test_texts_move_once(spark):
    """Texts are dealt to their groups before anything is counted: the counts need no shuffle of their own, and all occurrences are in the lists."""
    docs = spark.createDataFrame([(k, f"a b{k % 3} a c{k}" if k % 5 else None, "r" if k % 2 else None) for k in range(40)], "chunk_id long, text string, role string")
    found = postings.grouped(docs, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    rows = found.collect()
    assert sum(sum(r.tfs) for r in rows) == 32 * 4 and {r.chunks for r in rows} == {0, 1, 2}
    assert sum(r.n for r in rows if r.term == "a") == 32 and all(r.most_tf == 2 and r.least_dl == 4 for r in rows if r.term == "a")
    assert all(len(r.ids) == len(r.tfs) == len(r.dls) == r.n and list(r.ids) == sorted(r.ids) for r in rows)


def test_terms_run_no_lambda(spark):
    """Empty pieces go by a function that Spark compiles; the terms are those of a plain split."""
    texts = ["", None, "--", " A-b  c", "İx 漢字、b_c", "x"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select("text", search.terms(F.col("text")).alias("t"))
    assert "lambdafunction" not in frame._jdf.queryExecution().optimizedPlan().toString()
    got = {r.text: r.t for r in frame.collect()}
    assert got == {"": [], None: [], "--": [], " A-b  c": ["a", "b", "c"], "İx 漢字、b_c": ["i", "x", "漢字", "b", "c"], "x": ["x"]}
