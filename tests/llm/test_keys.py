"""Keys of sets as arrays of numbers: few rows, and the same links as from a row for each key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import jaccard, quality
from siltstone.llm.components import components

RULE = jaccard.Rule(words=2, num=80, den=100)


def _texts(n: int) -> list[str]:
    rng = np.random.default_rng(4)
    base = [[f"w{x}" for x in rng.integers(0, 500, 60)] for _ in range(n)]
    near = [[*x[:20], "changed", *x[21:]] for x in base[: n // 2]]
    return [" ".join(x) for x in base + near] + ["", "one", "two words"]


def test_keys_come_as_few_rows_and_join_what_shares_one(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "KEYS_AT_ONCE", 700)
    texts = _texts(80)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    with np.errstate(over="ignore"):
        sets = [jaccard.shingles(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 2)[0] for t in texts if t]
        plan = jaccard.Plan(RULE)
        keys = [(int(k), np.uint64(jaccard._short(jaccard.set_digest(x))).astype(np.int64).item()) for x in sets for k in plan.keys(x)]
    rows = jaccard._listed(df, RULE, 5, "text").agg(F.count("*"), F.sum(F.octet_length("keys") / 8)).first()
    # a key that a batch has several times goes on once
    assert rows[0] < len(keys) / 10 and rows[1] <= len(keys)
    by_key: dict[int, set[int]] = {}
    for k, own in keys:
        by_key.setdefault(k, set()).add(own)
    root = {own: own for _, own in keys}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for owners in by_key.values():
        first, *others = owners
        for o in others:
            root[find(o)] = find(first)
    groups: dict[int, set[int]] = {}
    for own in root:
        groups.setdefault(find(own), set()).add(own)
    got: dict[int, set[int]] = {}
    for r in components(jaccard._edges(df, RULE, 5, "text")).collect():
        got.setdefault(r.component, set()).add(r.node)
    expected = {frozenset(g) for g in groups.values() if len(g) > 1}
    assert {frozenset(g) for g in got.values()} == expected and len(expected) >= 30


def test_firsts():
    keys, owners, edges = jaccard._firsts(np.array([5, 3, 5, 3, 9], np.uint64), np.array([1, 2, 1, 4, 1], np.uint64))
    assert keys.tolist() == [3, 5, 9] and owners[1:].tolist() == [1, 1] and sorted(edges[0].tolist()) == [2, 4] and len(edges) == 1
    assert [len(x) for x in jaccard._firsts(*2 * [np.zeros(0, np.uint64)])] == [0, 0, 0]


def test_windows_are_not_taken_out_one_by_one(spark, monkeypatch):
    text = "a b c d e f g a b c d e x y a b c d e"
    for words in (3, 5, 8):
        monkeypatch.setattr(quality, "WINDOW_WORDS", words)
        out = quality.statistics(spark.createDataFrame([(text,), ("a b",), (" ".join("abcdefghij" * 2),)], "text string"))
        given = [text.split(), ["a", "b"], list("abcdefghij" * 2)]
        expected = []
        for w in given:
            windows = [tuple(w[i : i + words]) for i in range(len(w) - words + 1)]
            expected.append(len({i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(words)}))
        assert [r.n_repeat_words for r in out.collect()] == expected
        assert "sequence(1" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
