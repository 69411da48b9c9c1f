"""A batch of queries to ranked, budgeted passages: the online pipeline as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..operators import fusion, postings, search
from ..staging import small


def asked_roles(queries: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """query_id, role, role_ord: the roles of each query (roles) in the order in which it asks them, each once; those of the settings where a query names none."""
    named = F.when(F.size("roles") > 0, F.array_distinct("roles")) if "roles" in queries.columns else F.lit(None)
    return queries.select("query_id", F.posexplode(F.coalesce(named, F.array(*map(F.lit, settings.roles)))).alias("role_ord", "role"))


def hybrid(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, settings: Settings = DEFAULT, k: int | None = None, index: str | None = None) -> DataFrame:
    """query_id, chunk_id, role, role_ord, dense_rank, bm25_rank, score, rank: per asked role dense and BM25 hits, fused by weighted reciprocal ranks, each chunk once, the k best.

    chunks: chunk_id, text, role; vectors: chunk_id, vector, role; queries: query_id, text, (roles: only these, in the order
    that decides ties; none: those of the settings); query_vectors: query_id, vector (queries without one have BM25 hits only).
    index: the name of an index of the chunks' postings, which is read instead of the texts. Only asked roles are ranked."""
    k = k or settings.top_k
    per_role = max(k, settings.per_role_k_min)
    asked = asked_roles(queries, settings)
    dense = search.dense(vectors, query_vectors, per_role, role="role", asked=asked)
    bm25 = postings.search(queries, index, per_role, settings, asked=asked) if index else search.bm25(chunks, queries, per_role, settings, role="role", asked=asked)
    return fusion.best(fusion.fuse(dense, bm25, settings).join(small(asked), ["query_id", "role"]), k)


def passages(hits: DataFrame, chunks: DataFrame, settings: Settings = DEFAULT, raw: bool = False) -> DataFrame:
    """Promotion, budget and context of hits: query_id, context, sources. chunks: as in fusion.promote, with source_file. raw: the contents alone and each hit's own chunk, for answers without a second call."""
    fitting = fusion.within_budget(fusion.promote(hits, chunks, settings), settings)
    if raw:
        return fusion.raw_context(fitting).withColumnRenamed("rag_context", "context")
    files = chunks.select("chunk_id", "source_file").join(small(hits.select("chunk_id").distinct()), "chunk_id", "left_semi")
    return fusion.context(fitting.join(files, "chunk_id"))
