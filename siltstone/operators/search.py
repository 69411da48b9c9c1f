"""BM25 over postings and exact dense search for a batch of queries, and checks of vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..staging import BROADCAST_BYTES, discard, measured_bytes, small, stage

#: Cells of a matrix product in a task at most, but for one query with all rows of a batch.
CELLS = 1 << 22
#: Scores of a query and a text that a task holds and sorts, about.
PAIRS = 1 << 20


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def top(df: DataFrame, k: int, by: list[str], score: str, rank: str, tie: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.col(tie))
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def postings(docs: DataFrame, wanted: DataFrame, names: list[str]) -> DataFrame:
    """names, dl, term, tf of the wanted terms, and of every text a row with an empty term, as a staged table.

    One pass over the texts. Occurrences of other terms go in the task that makes them: what is shuffled is sums for the
    wanted terms. The empty term's rows hold all that collection statistics need."""
    marked = wanted.unionByName(wanted.sparkSession.range(1).select(F.lit("").alias("term")))
    tokens = docs.select(*names, terms(F.col("text")).alias("tokens"))
    each = tokens.select(*names, F.size("tokens").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("term"))
    return stage(each.join(small(marked), "term", "left_semi").groupBy(*names, "dl", "term").agg(F.count("*").alias("tf")), "postings")


def tasks_for(pairs: int, df: DataFrame) -> int:
    """Tasks that so many scores are dealt to: those of the session, or more where there are more scores than these should hold."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))


def bm25(docs: DataFrame, queries: DataFrame, k: int, settings: Settings = DEFAULT, role: str | None = None, asked: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, (role,) score, rank: the k best chunks (by query, and by role if named) by BM25. asked (query_id, role): only these roles are ranked.

    docs: chunk_id, text, (role); queries: query_id, text. Document counts and lengths are over the whole collection, the role
    only splits the ranking. Repeated terms of a query count once. Texts are read once, into postings of the queries' terms.

    Postings are dealt by text to tasks that score all queries: what is shuffled is postings and each task's best, not the
    scores. There are as many tasks as keep a task's scores bounded, however many texts there are."""
    k1, b = settings.bm25_k1, settings.bm25_b
    words = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    names = ["chunk_id", *([role] if role else [])]
    found = postings(docs, words.select("term").distinct(), names)
    lengths = found.where("term = ''").agg(F.sum("tf").alias("n"), (F.sum(F.col("tf") * F.col("dl")) / F.sum("tf")).alias("avgdl"))
    listed = found.where("term <> ''")
    df = listed.groupBy("term").agg(F.count("*").alias("df"))
    weights = df.crossJoin(F.broadcast(lengths)).select("term", "avgdl", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    wanted, on = stage(words.join(weights, "term"), "wanted"), ["term"]
    parts = tasks_for(wanted.agg(F.sum("df")).first()[0] or 0, docs)
    wanted = wanted.drop("df")
    if asked is not None:
        wanted, on = wanted.join(small(asked.select("query_id", F.col("role").alias(role))), "query_id"), ["term", role]
    scored = listed.repartition(parts, "chunk_id").join(small(wanted), on).groupBy("query_id", *names).agg(F.round(F.sum(part), 9).alias("score"))
    return top(scored, k, ["query_id", *names[1:]], "score", "rank", "chunk_id")


def _products(asked: pd.DataFrame, k: int, names: list[str]):
    """A task's function: cosines of a batch of vectors with all queries as matrix products, and of each query and role only those that can be among the k best of the batch, ties and what rounding may tie included."""

    def unit(vectors: pd.Series) -> np.ndarray:
        m = np.stack(vectors.to_numpy()).astype(np.float64)
        with np.errstate(invalid="ignore", divide="ignore"):
            return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]

    by_width = {w: (part["query_id"].to_numpy(), unit(part["vector"]), part.get("roles")) for w, part in asked.groupby(asked["vector"].map(len)) if w}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["vector"].notna()]
            if not len(batch):
                continue
            groups = [batch["vector"].map(len), *(batch[n].fillna("") for n in names[1:])]
            for key, part in batch.groupby(groups):
                width = key[0] if isinstance(key, tuple) else key
                if width not in by_width:
                    continue
                ids, targets, roles = by_width[width]
                if roles is not None:
                    own = roles.map(lambda r, role=key[1]: role in r).to_numpy(bool)
                    if not own.any():
                        continue
                    ids, targets = ids[own], targets[own]
                rows, best = unit(part["vector"]), min(k, len(part)) - 1
                step = max(1, CELLS // len(part))
                for at in range(0, len(ids), step):
                    cosine = rows @ targets[at : at + step].T
                    cosine = np.where(np.isfinite(cosine), cosine, -np.inf)
                    least = -np.partition(-cosine, best, axis=0)[best]
                    row, query = np.nonzero((cosine >= least - 1e-9) & np.isfinite(cosine))
                    out = part[names].iloc[row].assign(query_id=ids[at + query], score=cosine[row, query])
                    yield out[["query_id", *names, "score"]]

    return run


def dense(vectors: DataFrame, queries: DataFrame, k: int, role: str | None = None, asked: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, (role,) score, rank: the k nearest by cosine, compared exactly. vectors: chunk_id, vector, (role); queries: query_id, vector; asked (query_id, role): only these roles are compared. Null and zero vectors have no hits, nor have vectors of another length than the query.

    The stated queries meet all rows, in blocks: those of a block go to every task, which compares a batch of rows with all of
    them as matrix products, a bounded number of cells at a time, and keeps the best k before the shuffle. Queries whose measured
    bytes are within the bound are one block. More are dealt to blocks of about half of it by a hash, and the best of each block
    are written before the next begins: rows are read once a block and never shuffled, and no more than a block gets to the driver."""
    names = ["chunk_id", *([role] if role else [])]
    targets = queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    if asked is not None:
        targets = targets.join(asked.groupBy("query_id").agg(F.collect_set("role").alias("roles")), "query_id")
    every = vectors.select(*names, F.col("vector").cast("array<double>").alias("vector"))
    fields = ", ".join(f"`{n}` {dict(every.dtypes)[n]}" for n in names)

    def nearest(block: DataFrame) -> DataFrame:
        scored = every.mapInPandas(_products(block.toPandas(), k, names), f"query_id {dict(targets.dtypes)['query_id']}, {fields}, score double")
        return top(scored.withColumn("score", F.round("score", 9)), k, ["query_id", *names[1:]], "score", "rank", "chunk_id")

    size = measured_bytes(targets)
    if size <= BROADCAST_BYTES:
        return nearest(targets)
    targets = stage(targets, "targets")
    blocks = min(-(-2 * size // max(1, BROADCAST_BYTES)), targets.count())
    dealt = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    found = [stage(nearest(targets.where(dealt == b)), "nearest") for b in range(blocks)]
    discard(targets)
    return reduce(DataFrame.unionByName, found)


def vector_check(vectors: DataFrame) -> DataFrame:
    """rows, missing and empty vectors, and their dimensions."""
    return vectors.agg(F.count("*").alias("rows"), F.count_if(F.col("vector").isNull()).alias("missing"), F.count_if(F.size("vector") == 0).alias("empty"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"))
