"""A batch of queries from the router to an answer or to the passages for one, as one plan over stated steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..operators import catalog as cat
from ..operators import roles, routing
from ..staging import stage
from . import retrieve


def first_round(queries: DataFrame, outputs: DataFrame, words: roles.Words, table: list[dict], settings: Settings = DEFAULT) -> DataFrame:
    """What is known of each query (query_id, query) after the router and the model's first output (query_id, output): command, confidence, needs_rag, hedging, answer, roles, pathogen, activity, search_text.

    A query that a rule takes goes no further. Hedging, and a marker without a known role, fall back on the roles of the
    query's keywords; hedging also searches with the query as it was asked."""
    asked = routing.router(queries, table, settings)
    known = asked.join(outputs.select("query_id", "output"), "query_id", "left").withColumn("output", F.coalesce("output", F.lit("")))
    parsed = routing.slots(known, settings)
    guessed = roles.query_roles(roles.scored(queries.select("query_id", F.col("query").alias("content"), F.lit("").alias("heading_path")), words, key="query_id", settings=settings))
    out = parsed.join(guessed.withColumnRenamed("roles", "__guessed"), "query_id")
    taken = F.when(F.col("hedging") | (F.col("needs_rag") & (F.size("roles") == 0)), F.col("__guessed")).otherwise(F.col("roles"))
    text = F.when(F.col("hedging") | F.col("slot_query").isNull(), F.col("query")).otherwise(F.col("slot_query"))
    return out.withColumn("roles", taken).withColumn("search_text", text).drop("__guessed", "slot_query")


def handle(
    queries: DataFrame,
    outputs: DataFrame,
    words: roles.Words,
    chunks: DataFrame | None,
    vectors: DataFrame | None,
    query_vectors: DataFrame | None,
    catalog: DataFrame | None = None,
    table: list[dict] = routing.RULES,
    settings: Settings = DEFAULT,
    second_call: bool = True,
) -> DataFrame:
    """query_id, answer_type, command, answer, roles, search_query, context, sources.

    funcall: a rule took it. direct: the first output answers. need_rag: a search is needed and there is nothing to search
    (chunks is None). direct_fallback: nothing was found, the first output stands. rag: context and sources are the passages
    for a second call; rag_raw: there is no second call, and context is the contents alone. chunks: chunk_id, text, role, and what promotion needs
    (block_id, heading_path, source_file, start_line, chunk_idx, content, token_estimate); vectors: chunk_id, vector, role. The
    vector search takes the query as it was asked (query_vectors), the word search the enriched one. Queries that are
    answered before the search take no part in it. A query without an output has an empty one."""
    known = stage(first_round(queries, outputs, words, table, settings), "known")
    searching = known.where("command is null and (needs_rag or hedging)")
    slots = searching.select("query_id", "pathogen", "activity", "roles", F.col("search_text").alias("query"))
    if catalog is not None:
        slots = cat.enrich(slots, catalog, settings)
    else:
        slots = slots.withColumn("search_query", F.col("query"))
    slots = stage(slots.select("query_id", "roles", "search_query"), "slots")
    out = known.drop("roles").join(slots, "query_id", "left")
    if chunks is None:
        out = out.withColumn("context", F.lit(None).cast("string")).withColumn("sources", F.lit(None).cast("array<string>"))
    else:
        asked = query_vectors.join(slots, "query_id", "left_semi")
        hits = stage(retrieve.hybrid(chunks, vectors, slots.select("query_id", F.col("search_query").alias("text"), "roles"), asked, settings), "hits")
        out = out.join(retrieve.passages(hits.select("query_id", "rank", "chunk_id", "score"), chunks, settings, raw=not second_call), "query_id", "left")
    branch = routing.branch(F.col("command"), F.col("needs_rag"), F.col("hedging"), F.lit(chunks is not None), F.when(F.col("context").isNull(), 0).otherwise(1), F.lit(second_call))
    # a marker carries no answer of its own: what the model said stands where nothing is found
    said = F.coalesce(F.nullif("answer", F.lit("")), "output")
    answer = F.when(F.col("answer_type") == "direct", F.col("answer")).when(F.col("answer_type") == "direct_fallback", said)
    return out.withColumn("answer_type", branch).select("query_id", "answer_type", "command", answer.alias("answer"), "roles", "search_query", "context", "sources")
