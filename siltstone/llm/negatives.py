"""Hard negatives by a vector-approximation file: score bounds from a byte a component decide which vectors are scored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, release, stage

SCALE = 256
CELLS = 256
#: Bytes of a part's vectors and cells: what a task holds, whatever the table's size. Small tables have smaller parts, for all cores.
PART_BYTES = 32 << 20
LEAST_BYTES = 1 << 20
PARTS_OF_SMALL = 8
#: Anchors that a task takes from its stream at a time.
ANCHORS = 256


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x in double precision; null for null and empty vectors, nulls and what isn't finite, and for vectors so long that a score might not be a long."""
    whole = lambda x: F.floor(x.cast("double") * scale)
    bound = F.least(F.sqrt(F.lit(2.0**62) / F.size(vector)), F.lit(2.0**30))
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) + 1 <= bound))
    return F.when(F.coalesce((F.size(vector) > 0) & fits, F.lit(False)), F.transform(vector, lambda x: whole(x).cast("int")))


def approximate(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each component (a byte), and of each dimension's cells the least and the largest value (dimensions, cells, 2). Cells hold about equally many values; those that none falls into keep zeros."""
    n, width = vectors.shape
    cells, marks = np.zeros((n, width), np.uint8), np.zeros((width, CELLS, 2), np.int64)
    for j in range(width):
        order = np.sort(vectors[:, j])
        edges = np.unique(order[(np.arange(1, CELLS) * n) // CELLS])
        cells[:, j] = at = np.searchsorted(edges, vectors[:, j], "right")
        there, first = np.unique(np.sort(at), return_index=True)
        marks[j, there, 0] = order[first]
        marks[j, there, 1] = order[np.append(first[1:], n) - 1]
    return cells, marks


def build_file(rows: DataFrame) -> DataFrame:
    """part, dimension, label, vec_id, vector, cells, marks: the vectors and their approximations. A part is dealt by a hash of the row; the first row of each dimension in a part carries the marks of its cells."""
    size = rows.agg(F.sum(5 * F.size("vector") + 32)).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES), min(PARTS_OF_SMALL, -(-size // LEAST_BYTES)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat([*batches, pd.DataFrame({"part": [], "label": [], "vec_id": [], "vector": []})])
        for dimension, own in whole.groupby(whole["vector"].map(len)):
            cells, marks = approximate(np.stack(own["vector"].to_numpy()))
            out = own.assign(dimension=dimension, cells=[row.tobytes() for row in cells], marks=[marks.tobytes(), *[None] * (len(own) - 1)])
            for k in range(0, len(out), 5000):
                yield out.iloc[k : k + 5000][["part", "dimension", "label", "vec_id", "vector", "cells", "marks"]]
        release()

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(parts)).cast("int"))
    made = dealt.repartitionById(parts, F.col("part")).select("part", "label", "vec_id", "vector")
    return stage(made.mapInPandas(run, "part int, dimension int, label bigint, vec_id bigint, vector array<int>, cells binary, marks binary"), "approximations")


class Part:
    """A part's rows of one dimension, by label."""

    def __init__(self, rows: pd.DataFrame):
        width = len(rows["vector"].iloc[0])
        marks = rows["marks"].dropna().iloc[0]
        rows = rows.sort_values("label", ignore_index=True)
        self.labels, self.ids = rows["label"].to_numpy(np.int64), rows["vec_id"].to_numpy(np.int64)
        self.vectors = np.stack(rows["vector"].to_numpy())
        self.cells = np.ascontiguousarray(np.frombuffer(b"".join(rows["cells"]), np.uint8).reshape(-1, width).T)
        self.marks = np.frombuffer(marks, np.int64).reshape(width, CELLS, 2)

    def label(self, label: int) -> slice:
        return slice(int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right")))

    def bounds(self, anchor: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the least and the largest score that its cells allow: two look-ups a component."""
        ends = anchor[:, None, None] * self.marks
        least, most = ends.min(axis=2), ends.max(axis=2)
        lower, upper = np.zeros((2, len(self.ids[at])), np.int64)
        for j, cells in enumerate(self.cells[:, at]):
            lower += least[j].take(cells)
            upper += most[j].take(cells)
        return lower, upper

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.vectors[rows].astype(np.int64) @ anchor

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places of the k first: higher scores first, ties to the smaller id."""
        return np.lexsort((self.ids[rows], -scores))[:k]


def kth_largest(values: np.ndarray, k: int, otherwise: int) -> int:
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else otherwise


def _positives(k: int) -> Callable[[Part, pd.Series], tuple[np.ndarray, np.ndarray]]:
    """Of a part the k first other rows with the anchor's label: only rows whose upper bound reaches the k-th largest lower bound are scored."""

    def find(part: Part, row: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        anchor, at = np.asarray(row["vector"], np.int64), part.label(row["label"])
        lower, upper = part.bounds(anchor, at)
        other = part.ids[at] != row["id"]
        near = np.flatnonzero(other & (upper >= kth_largest(lower[other], k, -(2**63)))) + at.start
        scores = part.scores(anchor, near)
        first = part.best(near, scores, k)
        return near[first], scores[first]

    return find


def _negatives(k: int, low: int, high: int) -> Callable[[Part, pd.Series], tuple[np.ndarray, np.ndarray]]:
    """Of a part the k first rows with other labels in each of the anchor's windows. Scored are rows that may be in a window and, where k rows surely are, may reach the k-th of them."""

    def find(part: Part, row: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        anchor, own = np.asarray(row["vector"], np.int64), part.label(row["label"])
        windows = {(-(-low * s // 100), high * s // 100) for s in map(int, row["scores"])}
        windows = [(a, b) for a, b in windows if a <= b]
        sides = (slice(0, own.start), slice(own.stop, len(part.ids)))
        lower, upper = (np.concatenate(x) for x in zip(*(part.bounds(anchor, at) for at in sides), strict=True))
        rows = np.concatenate([np.arange(at.start, at.stop) for at in sides])
        other = part.ids[rows] != row["id"]
        may = np.zeros(len(rows), bool)
        for a, b in windows:
            sure = other & (lower >= a) & (upper <= b)
            may |= other & (upper >= kth_largest(lower[sure], k, a)) & (lower <= b)
        near = rows[may]
        scores = part.scores(anchor, near)
        chosen = np.zeros(len(near), bool)
        for a, b in windows:
            inside = np.flatnonzero((scores >= a) & (scores <= b))
            chosen[inside[part.best(near[inside], scores[inside], k)]] = True
        return near[chosen], scores[chosen]

    return find


def _meet(file: DataFrame, anchors: DataFrame, find: Callable[[Part, pd.Series], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """anchor_id, which, vec_id, score: what find gives for each anchor (id, which, label, vector, scores) in each part. A part's rows come first and then the anchors, a batch at a time: a task holds one part and one batch."""
    parts = (file.agg(F.max("part")).first()[0] or 0) + 1
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.size("vector").alias("dimension"), F.lit(1).alias("side"), "id", "which", "label", "vector", "scores")
    rows = file.select("part", "dimension", F.lit(0).alias("side"), F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("which"), "label", "vector", "cells", "marks").unionByName(asked, allowMissingColumns=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given: list[pd.DataFrame] = []
        part, of = None, None
        for batch in batches:
            for (dimension, side), own in batch.groupby(["dimension", "side"]):
                if side == 0:
                    if dimension != of:
                        given, part, of = [], None, dimension
                    given.append(own.rename(columns={"id": "vec_id"}))
                elif dimension == of:
                    if part is None:
                        part, given = Part(pd.concat(given)), []
                    for a in range(0, len(own), ANCHORS):
                        out = []
                        for _, row in own.iloc[a : a + ANCHORS].iterrows():
                            at, scores = find(part, row)
                            out.append(pd.DataFrame({"anchor_id": row["id"], "which": row["which"], "vec_id": part.ids[at], "score": scores}))
                        yield pd.concat(out)
        release()

    placed = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("dimension", "side")
    names = ["dimension", "side", "id", "which", "label", "vector", "scores", "cells", "marks"]
    return placed.select(*names).mapInPandas(run, "anchor_id bigint, which bigint, vec_id bigint, score bigint")


def _first(df: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", every: int = 100, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (id divisible by `every`) and each of its first `positives` other rows of the same label, the first k rows of other labels whose score is low to high percent of the positive's.

    A score is the inner product of the quantised vectors, in whole numbers; higher ones come first, ties by the smaller id. A
    positive with a negative score has an empty window. Every anchor meets every part of the file; of most vectors only the
    bounds are worked out. The first pass gives the positives and so the windows, the second the negatives; each part returns
    at most k rows a window.

    Rows without an id, a label or a usable vector (see quantised) take no part. Rows that repeat are one row; an anchor never
    meets rows with its own id. Scores are of vectors of one length: others aren't compared. An empty table, an anchor without
    positives, and a window without rows give none."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), quantised(F.col(vector_col), scale).alias("vector")).dropna()
    file = build_file(rows.distinct())
    anchors = file.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("id"), F.xxhash64("vec_id", "label", "vector").alias("which"), "label", "vector")
    met = _meet(file, anchors.withColumn("scores", F.array().cast("array<bigint>")), _positives(positives))
    known = stage(_first(met, positives, "anchor_id", "which").select("anchor_id", "which", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = known.groupBy("which", F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("scores"))
    found = stage(_meet(file, anchors.join(windows, ["which", "id"]), _negatives(k, low, high)), "negatives")
    discard(file)
    exact = lambda name, by: F.col(name).cast("decimal(20,0)") * by
    inside = exact("score", 100).between(exact("positive_score", low), exact("positive_score", high))
    ranked = _first(known.join(found, ["anchor_id", "which"]).where(inside), k, "anchor_id", "which", "positive_id")
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
