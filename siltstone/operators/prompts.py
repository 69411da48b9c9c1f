"""Messages for the models, and tagging prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..staging import small
from .roles import strip_heading

# --- fixed values: how much of a chunk a tagging prompt shows, and what frames a question ---
PREVIEW_CHARS = 800
REFERENCES = ("参考资料：\n", "\n\n用户问题：")
# --- end of fixed values ---

#: Templates: configuration, to be replaced by your own.
SCENARIO = "{title}\n\nSupplies:\n{supplies}\n\nSteps:\n{steps}\n\nFacts:\n{knowledge_points}"
TAGGING = "Which of these kinds fits the text best? Answer with one word.\n{roles}\n\n{heading_path}\n{chunk_text}"
ANSWERING = "Answer from these passages and what you know; say so where they don't suffice.\n\n{rag_context}\n\nQuestion: {query}"

MESSAGES = "array<struct<role:string,content:string>>"


def filled(template: str, **fields: Column) -> Column:
    """A template with its {fields} filled in, those that are null as nothing."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(fields[x], F.lit("")) if k % 2 else F.lit(x) for k, x in enumerate(parts)))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def question(query: Column, context: Column) -> Column:
    """The user's message: the query, with reference passages before it if there are any. The system message stays the same, so that its prefix can be cached."""
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(REFERENCES[0]), context, F.lit(REFERENCES[1]), query)).otherwise(query)


def second_question(query: Column, context: Column, template: str = ANSWERING) -> Column:
    """The user's message of the second call: the numbered passages and the query."""
    return filled(template, rag_context=context, query=query)


def system_text(scenarios: DataFrame, template: str = SCENARIO) -> DataFrame:
    """id, system of scenarios: title, supplies and knowledge points as lists, steps as lines."""
    listed = lambda c, mark: F.array_join(F.transform(c, lambda x: F.concat(F.lit(mark), x)), "\n")
    return scenarios.select("id", filled(template, title=F.col("title"), supplies=listed("supplies", "- "), steps=listed("steps", ""), knowledge_points=listed("knowledge_points", "- ")).alias("system"))


def scenario_list(scenarios: DataFrame) -> DataFrame:
    """id, title of all scenarios."""
    return scenarios.select("id", "title").distinct()


def scenario_of(wanted: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Adds title, supplies, steps and knowledge_points of the scenario that a row names (scenario_id), and missing: null, or the sorted choices where there is none of that name. Scenarios are a small table; their ids go into one row."""
    choices = scenarios.agg(F.array_join(F.array_sort(F.collect_set("id")), ", ").alias("__choices"))
    own = scenarios.withColumnRenamed("id", "scenario_id").withColumn("__here", F.lit(True))
    out = wanted.join(small(own), "scenario_id", "left").crossJoin(F.broadcast(choices))
    return out.withColumn("missing", F.when(F.col("__here").isNull(), F.col("__choices"))).drop("__here", "__choices")


def messages(system: Column, user: Column) -> Column:
    return F.array(message("system", system), message("user", user))


def tagging(chunks: DataFrame, settings: Settings = DEFAULT, template: str = TAGGING) -> DataFrame:
    """custom_id, messages that ask a model for the role of a chunk: its way and the first characters of its body, without the heading lines before it."""
    body = F.substring(strip_heading(F.col("content")), 1, PREVIEW_CHARS)
    ask = filled(template, roles=F.lit(", ".join(settings.roles)), heading_path=F.col("heading_path"), chunk_text=body)
    return chunks.select("custom_id", F.array(message("user", ask)).alias("messages"))


def conversation(turns: DataFrame) -> DataFrame:
    """conv_id, prompt: the turns of a conversation as `role: text` lines in order."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("prompt"))


def final_answer(second: Column, first: Column) -> Column:
    """The second answer, or the first where it is empty."""
    return F.coalesce(F.nullif(F.trim(second), F.lit("")), first)
