"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard of the vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, small, stage

#: Bytes of a shard's vectors and graph: what a task holds, whatever the table's size.
SHARD_BYTES = 4 << 20
DEGREE = 28
BEAM = 64
SEARCH_BEAM = 128
ALPHA = 1.2
BATCH = 128
EXPAND = 4


def _squared(vectors: np.ndarray, ids: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of vectors[ids] (rows of several) to one vector a row."""
    d = vectors[ids] - to[:, None, :]
    return np.einsum("bcd,bcd->bc", d, d)


def beam_search(vectors: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy searches of all queries at once: the beam's nodes and squared distances, nearest first (-1 and infinity where there are fewer), and the nodes expanded on the way."""
    n, b = len(vectors), len(queries)
    ids = np.full((b, beam), -1)
    near = np.full((b, beam), np.inf, vectors.dtype)
    done = np.ones((b, beam), bool)
    seen = np.zeros((b, n), bool)
    ids[:, 0], done[:, 0], seen[:, entry] = entry, False, True
    near[:, 0] = _squared(vectors, np.full((b, 1), entry), queries)[:, 0]
    trail = []
    live = np.arange(b)
    while len(live):
        # the nearest few that aren't expanded yet; the beam is sorted
        order = np.argsort(done[live], axis=1, kind="stable")[:, :EXPAND]
        fresh = ~np.take_along_axis(done[live], order, 1)
        going = fresh.any(axis=1)
        live, order, fresh = live[going], order[going], fresh[going]
        if not len(live):
            break
        nodes = np.where(fresh, ids[live[:, None], order], -1)
        done[live[:, None], order] = True
        step = np.full((b, EXPAND), -1)
        step[live, : nodes.shape[1]] = nodes
        trail.append(step)
        found = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(len(live), -1)
        found = np.sort(found, axis=1)
        new = found >= 0
        new[:, 1:] &= found[:, 1:] != found[:, :-1]
        new &= ~seen[live[:, None], found]
        keep = int(new.sum(axis=1).max())
        found = np.take_along_axis(np.where(new, found, -1), np.argsort(~new, axis=1, kind="stable"), 1)[:, :keep]
        new = found >= 0
        row, _ = np.nonzero(new)
        seen[live[row], found[new]] = True
        far = np.where(new, _squared(vectors, found, queries[live]), np.inf).astype(vectors.dtype)
        every = np.concatenate([near[live], far], axis=1)
        best = np.argsort(every, axis=1, kind="stable")[:, :beam]
        near[live] = np.take_along_axis(every, best, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], found], axis=1), best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~new], axis=1), best, 1)
    return ids, near, np.concatenate(trail, axis=1)


def robust_prune(vectors: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most `degree` out-neighbours for each node: the nearest candidate stays and drops those that it is nearer to, by the factor alpha, than the node is; and so on."""
    near = _squared(vectors, candidates, vectors[nodes])
    near[(candidates < 0) | (candidates == nodes[:, None])] = np.inf
    order = np.argsort(near, axis=1, kind="stable")
    near, candidates = np.take_along_axis(near, order, 1), np.take_along_axis(candidates, order, 1)
    twin = np.sort(candidates, axis=1)
    if (twin[:, 1:] == twin[:, :-1]).any():
        by = np.argsort(candidates, axis=1, kind="stable")
        again = np.zeros(candidates.shape, bool)
        again[:, 1:] = twin[:, 1:] == twin[:, :-1]
        repeated = np.zeros_like(again)
        np.put_along_axis(repeated, by, again, 1)
        near[repeated] = np.inf
    points = vectors[candidates]
    size = np.einsum("bcd,bcd->bc", points, points)
    between = size[:, :, None] + size[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
    alive = np.isfinite(near)
    out = np.full((len(nodes), degree), -1)
    rows = np.arange(len(nodes))
    for k in range(degree):
        if not alive.any():
            break
        pick = alive.argmax(axis=1)
        has = alive[rows, pick]
        out[has, k] = candidates[rows, pick][has]
        alive &= (alpha * alpha * between[rows, pick] > near) & has[:, None]
        alive[rows, pick] = False
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = BATCH, seed: int = 5) -> tuple[np.ndarray, int]:
    """The graph (n rows of out-neighbours, -1 for none) and its entry, the node nearest to the mean.

    From a random graph, two rounds over all nodes in random order, the first with alpha 1: a greedy search for each node
    proposes what it met, pruning keeps diverse edges, and each edge is also proposed backward."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    entry = int(_squared(vectors, np.arange(n)[None, :], vectors.mean(axis=0)[None, :])[0].argmin())
    graph = rng.integers(0, n, (n, degree))
    graph[graph == np.arange(n)[:, None]] = -1
    for factor in (1.0, alpha):
        order = rng.permutation(n)
        for a in range(0, n, batch):
            nodes = order[a : a + batch]
            ids, _, trail = beam_search(vectors, graph, entry, vectors[nodes], beam)
            graph[nodes] = robust_prune(vectors, nodes, np.concatenate([ids, trail, graph[nodes]], axis=1), degree, factor)
            _link_back(vectors, graph, nodes, degree, factor)
    return _connect(vectors, graph, entry), entry


def _reached(graph: np.ndarray, entry: int) -> np.ndarray:
    reached = np.zeros(len(graph), bool)
    reached[entry] = True
    edge = np.array([entry])
    while len(edge):
        near = np.unique(graph[edge])
        edge = near[(near >= 0) & ~reached[near]]
        reached[edge] = True
    return reached


def _connect(vectors: np.ndarray, graph: np.ndarray, entry: int) -> np.ndarray:
    """Adds a column of edges to nodes that pruning has cut off, each from the nearest reached node that has none yet."""
    extra = np.full((len(graph), 1), -1)
    reached = _reached(graph, entry)
    for node in np.flatnonzero(~reached):
        if not reached[node]:
            free = np.flatnonzero(reached & (extra[:, 0] < 0))
            from_node = free[_squared(vectors, free[None, :], vectors[node][None, :])[0].argmin()]
            extra[from_node] = node
            reached |= _reached(np.concatenate([graph, extra], axis=1), node)
    return np.concatenate([graph, extra], axis=1)


def _link_back(vectors: np.ndarray, graph: np.ndarray, nodes: np.ndarray, degree: int, alpha: float) -> None:
    targets = graph[nodes]
    to, source = targets.ravel(), np.repeat(nodes, targets.shape[1])
    source, to = source[to >= 0], to[to >= 0]
    known = (graph[to] == source[:, None]).any(axis=1)
    source, to = source[~known], to[~known]
    order = np.argsort(to, kind="stable")
    source, to = source[order], to[order]
    unique, first, count = np.unique(to, return_index=True, return_counts=True)
    more = np.full((len(unique), int(count.max(initial=0))), -1)
    row = np.repeat(np.arange(len(unique)), count)
    more[row, np.arange(len(to)) - np.repeat(first, count)] = source
    degrees = (graph[unique] >= 0).sum(axis=1)
    for a in range(0, len(unique), BATCH):
        part = slice(a, a + BATCH)
        every = np.concatenate([graph[unique[part]], more[part]], axis=1)
        room = degrees[part] + count[part] <= degree
        if room.any():
            graph[unique[part][room]] = np.take_along_axis(every[room], np.argsort(every[room] < 0, axis=1, kind="stable"), 1)[:, :degree]
        if not room.all():
            graph[unique[part][~room]] = robust_prune(vectors, unique[part][~room], every[~room], degree, alpha)


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows, in the precision that they have."""
    return np.stack([np.asarray(v) for v in vectors])


def build_index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """part, dimension, node, vec_id, vector, neighbours, entry: every usable vector, as it is. A shard is the vectors of a dimension in a part; parts are dealt evenly by a hash of the row, as many as give shards of about shard_bytes.

    Equal vectors of a shard are one node, which the row with the least id stands for; the others carry its number and no
    neighbours. Copies of one vector are spread over all shards."""
    kind = dict(df.dtypes)[vector_col]
    kind = kind if kind == "array<float>" else "array<double>"
    rows = df.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"))
    width = 8 if kind == "array<double>" else 4
    parts = max(1, -(-(rows.agg(F.sum(width * F.size("vector") + 4 * DEGREE + 32)).first()[0] or 0) // shard_bytes))
    schema = f"part int, dimension int, node int, vec_id bigint, vector {kind}, neighbours array<int>, entry int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat([*batches, pd.DataFrame({"part": [], "vec_id": [], "vector": []})])
        for dimension, shard in whole.groupby(whole["vector"].map(len)):
            shard = shard.sort_values("vec_id", ignore_index=True)
            _, first, node = np.unique(_matrix(shard["vector"]), axis=0, return_index=True, return_inverse=True)
            graph, entry = build_graph(_matrix(shard["vector"].iloc[first]))
            neighbours: list[np.ndarray] = [np.zeros(0, np.int32)] * len(shard)
            for k, row in enumerate(first):
                neighbours[row] = graph[k][graph[k] >= 0].astype(np.int32)
            out = pd.DataFrame({"part": shard["part"], "dimension": dimension, "node": node.ravel(), "vec_id": shard["vec_id"], "vector": shard["vector"], "neighbours": neighbours, "entry": entry})
            for k in range(0, len(out), 2000):
                yield out.iloc[k : k + 2000]
        release()

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(parts)).cast("int"))
    return stage(dealt.repartitionById(parts, F.col("part")).select("part", "vec_id", "vector").mapInPandas(run, schema), "index")


class Shard:
    """A shard's vectors, graph and rows."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["node", "vec_id"], ignore_index=True)
        node = rows["node"].to_numpy(np.int64)
        self.first = np.searchsorted(node, np.arange(node[-1] + 2))
        self.vectors = _matrix(rows["vector"].iloc[self.first[:-1]])
        self.ids = rows["vec_id"].to_numpy(np.int64)
        self.entry = int(rows["entry"].iloc[0])
        self.graph = np.full((len(self.vectors), DEGREE + 1), -1)
        own = rows[rows["neighbours"].map(len) > 0]
        for at, row in zip(own["node"].astype(int), own["neighbours"], strict=True):
            self.graph[at, : len(row)] = row

    def nearest(self, query_ids: np.ndarray, which: np.ndarray, targets: np.ndarray, k: int, beam: int) -> Iterator[pd.DataFrame]:
        """The k nearest rows that a beam meets for each query; scores on the vectors as they are, in double precision."""
        for a in range(0, len(targets), BATCH):
            part = targets[a : a + BATCH]
            if len(self.vectors) <= beam:
                found = np.tile(np.arange(len(self.vectors)), (len(part), 1))
            else:
                found = beam_search(self.vectors, self.graph, self.entry, part.astype(self.vectors.dtype), beam)[0]
            for query, own, target, nodes in zip(query_ids[a : a + BATCH], which[a : a + BATCH], part.astype(np.float64), found, strict=True):
                nodes = nodes[nodes >= 0]
                score = np.sqrt(((self.vectors[nodes].astype(np.float64) - target) ** 2).sum(axis=1))
                # of each node the k + 1 least ids suffice, the query's own among them or not
                members = [self.ids[self.first[x] : min(self.first[x + 1], self.first[x] + k + 1)] for x in nodes]
                rows = pd.DataFrame({"query_id": query, "which": own, "vec_id": np.concatenate(members), "score": np.repeat(score, [len(m) for m in members])})
                yield rows[rows["vec_id"] != query].sort_values(["score", "vec_id"]).head(k)


def search(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query (query_id, vector), but its own id; by Euclidean distance in double precision, ties to the smaller id.

    Each query's beam searches each shard of its dimension. A shard's rows come first and then the queries, batch by batch: a
    task holds one shard and one batch, and the index moves once however many queries there are. What grows with both is a
    row for each query and shard, so that shards should be as large as tasks allow. Nodes stand for all rows with their
    vector. A shard no larger than the beam is scanned. Queries that aren't usable have no rows; rows with the same id and
    vector are one query."""
    kind = dict(index.dtypes)["vector"]
    queries = queries.where(usable(F.col("vector"))).select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).distinct()
    queries = queries.withColumn("which", F.xxhash64("query_id", "vector")).withColumn("vector", F.col("vector").cast(kind))
    shards = index.select("part", "dimension").distinct()
    parts = (index.agg(F.max("part")).first()[0] or 0) + 1
    asked = queries.withColumn("dimension", F.size("vector")).join(small(shards), "dimension").select("part", "dimension", F.lit(1).alias("side"), F.col("query_id").alias("id"), "which", "vector")
    rows = index.select("part", "dimension", F.lit(0).alias("side"), F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("which"), "node", "vector", "neighbours", "entry").unionByName(asked, allowMissingColumns=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given: list[pd.DataFrame] = []
        shard, of = None, None
        for batch in batches:
            for (dimension, side), part in batch.groupby(["dimension", "side"]):
                if side == 0:
                    if dimension != of:
                        given, shard, of = [], None, dimension
                    given.append(part.rename(columns={"id": "vec_id"}))
                elif dimension == of:
                    if shard is None:
                        shard, given = Shard(pd.concat(given)), []
                    out = list(shard.nearest(part["id"].to_numpy(np.int64), part["which"].to_numpy(np.int64), _matrix(part["vector"]), k, beam))
                    yield pd.concat(out)
        release()

    placed = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("dimension", "side")
    found = placed.select("dimension", "side", "id", "which", "node", "vector", "neighbours", "entry").mapInPandas(run, "query_id bigint, which bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id", "which").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Searches for the rows whose id is divisible by `every` among all others. Rows with a null id take no part."""
    queries = df.where(F.col(id_col) % every == 0).select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("vector"))
    return search(build_index(df.where(F.col(id_col).isNotNull()), id_col, vector_col, shard_bytes), queries, k)
