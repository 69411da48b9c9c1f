"""Rank fusion, block promotion and the token budget, for a batch of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import token_estimate
from ..staging import small, stage
from . import folds


#: Fixed value: what stands between passages.
BETWEEN = "\n\n---\n\n"


def fuse(dense: DataFrame, bm25: DataFrame, settings: Settings = DEFAULT, role: str = "role") -> DataFrame:
    """Weighted reciprocal ranks by query and role: query_id, role, chunk_id, dense_rank, bm25_rank, score. A hit of one branch only counts with that branch."""
    keys = ["query_id", role, "chunk_id"]
    both = dense.select(*keys, F.col("rank").alias("dense_rank")).join(bm25.select(*keys, F.col("rank").alias("bm25_rank")), keys, "full_outer")
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (settings.rrf_k + F.col(rank)), F.lit(0.0))
    return both.withColumn("score", F.round(part(settings.dense_weight, "dense_rank") + part(settings.bm25_weight, "bm25_rank"), 9))


def best(hits: DataFrame, k: int) -> DataFrame:
    """Each chunk once a query, with its best score; then the k best of a query. Ties go by where a chunk was met first: by the place of the role among those that the query asks (role_ord; without it by the role's name), then dense rank (those without one last), BM25 rank, chunk."""
    last, place = F.lit(2**31 - 1), "role_ord" if "role_ord" in hits.columns else "role"
    first = F.min(F.struct(place, F.coalesce("dense_rank", last), F.coalesce("bm25_rank", last), "chunk_id"))
    of_chunk = Window.partitionBy("query_id", "chunk_id")
    met = hits.withColumn("__met", first.over(of_chunk)).withColumn("__n", F.row_number().over(of_chunk.orderBy(F.desc("score"), place)))
    once = met.where("__n = 1").drop("__n")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "__met"))).where(F.col("rank") <= k).drop("__met")


def promotable(chunks: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """block_id, chunk_count, roles, tokens, promotable of chunks (block_id, chunk_id, role, token_estimate): two chunks at least, one role, and within the cap."""
    out = chunks.groupBy("block_id").agg(F.count("*").alias("chunk_count"), F.count_distinct("role").alias("roles"), F.sum("token_estimate").alias("tokens"))
    return out.withColumn("promotable", (F.col("chunk_count") >= 2) & (F.col("roles") == 1) & (F.col("tokens") <= settings.promoted_block_max))


def promote(hits: DataFrame, chunks: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The first hit of a promotable block gets the whole block's content and its other hits go.

    hits: query_id, rank, chunk_id, score; chunks: block_id, chunk_id, start_line, chunk_idx, heading_path, role,
    token_estimate, content. Returns the hits with content, tokens, promoted, original_content, original_tokens, chunk_ids.

    The hits' ids go to the chunks and then their blocks' ids: contents stay where they are but those of the hits' blocks,
    which are written once, as are the hits, and read by what follows."""
    hits = stage(hits, "hits")
    wanted = chunks.select("chunk_id", "block_id").join(small(hits.select("chunk_id").distinct()), "chunk_id", "left_semi").select("block_id").distinct()
    needed = ["block_id", "chunk_id", "start_line", "chunk_idx", "heading_path", "role", "token_estimate", "content"]
    blocks = stage(chunks.select(*needed).join(small(wanted), "block_id", "left_semi"), "blocks")
    able = promotable(blocks, settings).where("promotable").select("block_id")
    rows = F.array_sort(F.collect_list(F.struct("start_line", "chunk_idx", "chunk_id", "heading_path", "content")))
    whole = blocks.join(able, "block_id", "left_semi").groupBy("block_id").agg(rows.alias("rows"))

    def body(x: Column, i: Column) -> Column:
        heading = F.coalesce(x["heading_path"], F.lit(""))
        repeated = (i > 0) & (heading != "") & F.startswith(x["content"], heading) & F.lit(settings.strip_repeated_heading)
        return F.when(repeated, F.regexp_replace(F.call_function("substring", x["content"], F.length(heading) + 1), "^\n+", "")).otherwise(x["content"])

    whole = whole.select("block_id", F.array_join(F.transform("rows", body), "\n\n").alias("whole"), F.transform("rows", lambda x: x["chunk_id"]).alias("ids"))
    own = hits.join(blocks.select("chunk_id", "block_id", "role", "heading_path", "content"), "chunk_id").join(whole, "block_id", "left")
    order = Window.partitionBy("query_id", "block_id").orderBy("rank")
    own = own.withColumn("promoted", F.col("whole").isNotNull()).withColumn("__n", F.row_number().over(order)).where(~F.col("promoted") | (F.col("__n") == 1))
    return own.select(
        "query_id", "rank", "chunk_id", "block_id", "role", "heading_path", "score", "promoted",
        F.coalesce("whole", "content").alias("content"), token_estimate(F.coalesce("whole", "content")).alias("tokens"),
        F.when(F.col("promoted"), F.col("content")).alias("original_content"), token_estimate(F.col("content")).alias("original_tokens"),
        F.when(F.col("promoted"), F.col("ids")).otherwise(F.array("chunk_id")).alias("chunk_ids"),
    )


def budget(hits: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The hits that fit into a query's budget, in the order of their ranks: query_id, rank, tokens, demoted. hits: query_id, rank, tokens, original_tokens, promoted. What doesn't fit is skipped; later ones may still fit. A promoted hit that doesn't fit falls back to its original if that does."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("tokens").cast("long").alias("tokens"), F.col("original_tokens").cast("long").alias("original"), "promoted")))
    listed = hits.groupBy("query_id").agg(rows.alias("rows"))
    choice = folds.chosen(F.col("rows.tokens"), F.col("rows.original"), F.col("rows.promoted"), settings.context_budget)
    taken = listed.select("query_id", F.zip_with("rows", choice, lambda r, c: F.struct(r["rank"].alias("rank"), F.when(c == 2, r["original"]).otherwise(r["tokens"]).alias("tokens"), c.alias("choice"))).alias("x"))
    each = taken.select("query_id", F.inline("x"))
    return each.where("choice > 0").select("query_id", "rank", "tokens", (F.col("choice") == 2).alias("demoted"))


def within_budget(hits: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The promoted hits that fit, demoted ones with their original content and chunk."""
    out = hits.drop("tokens").join(budget(hits, settings), ["query_id", "rank"])
    return out.select("query_id", "rank", "chunk_id", "block_id", "role", "heading_path", "score", (F.col("promoted") & ~F.col("demoted")).alias("promoted"), "demoted", F.when(F.col("demoted"), F.col("original_content")).otherwise(F.col("content")).alias("content"), "tokens", F.when(F.col("demoted"), F.array("chunk_id")).otherwise(F.col("chunk_ids")).alias("chunk_ids"))


def context(hits: DataFrame) -> DataFrame:
    """query_id, context, sources of hits (query_id, rank, heading_path, source_file, content, chunk_ids): numbered passages in order of rank, and all their chunks."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "heading_path", "source_file", "content", "chunk_ids")))
    some = lambda x, before, after: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(before), x, F.lit(after))).otherwise("")
    passages = F.transform("rows", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"), some(x["heading_path"], " ", ""), some(x["source_file"], " (", ")"), F.lit("\n"), x["content"]))
    return hits.groupBy("query_id").agg(rows.alias("rows")).select("query_id", F.array_join(passages, BETWEEN).alias("context"), F.flatten(F.transform("rows", lambda x: x["chunk_ids"])).alias("sources"))


def raw_context(hits: DataFrame) -> DataFrame:
    """query_id, rag_context, sources of hits (query_id, rank, chunk_id, content): the contents alone in order of rank, and each hit's own chunk, for answers without a second call."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "content")))
    return hits.groupBy("query_id").agg(rows.alias("rows")).select("query_id", F.array_join(F.transform("rows", lambda x: x["content"]), BETWEEN).alias("rag_context"), F.transform("rows", lambda x: x["chunk_id"]).alias("sources"))
