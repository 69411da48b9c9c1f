"""Readers and writers of the files between the stages."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays

CHUNK_ROW = "title string, content string, start_line bigint, end_line bigint, heading_level bigint, token_estimate bigint"
BLOCK_ROW = f"title string, source_file string, breadcrumb array<string>, heading_level bigint, start_line bigint, end_line bigint, chunks array<struct<{CHUNK_ROW.replace(' ', ':').replace(',:', ',')}>>"
TAGGED_ROW = "chunk_id string, content string, role string, role_confidence string, block_id string, source_file string, breadcrumb array<string>, heading_path string, start_line string, end_line string, token_estimate string, tagged_by string"
CHAT_ROW = "custom_id string, response struct<body:struct<choices:array<struct<message:struct<content:string>>>>>"
EMBEDDING_ROW = "custom_id string, response struct<body:struct<data:array<struct<embedding:array<double>>>>>"


def markdown(spark: SparkSession, path: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """source_file, text of the Markdown files of a folder, without the named ones; a file is a row, read where it is scheduled."""
    out = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))
    return out.where(~F.col("source_file").isin(*skip)) if skip else out


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return arrays.records(spark, path).select(F.from_json("value", F.lit(schema)).alias("x")).where("x is not null").select("x.*")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a JSON array file, with defaults for what is missing."""
    out = _rows(spark, path, BLOCK_ROW)
    zero, none = F.lit(0).cast("long"), F.lit("")
    return out.select(F.coalesce("title", none).alias("title"), F.coalesce("source_file", none).alias("source_file"), F.coalesce("breadcrumb", F.array().cast("array<string>")).alias("breadcrumb"), *(F.coalesce(c, zero).alias(c) for c in ("heading_level", "start_line", "end_line")), F.coalesce("chunks", F.array().cast(dict(out.dtypes)["chunks"])).alias("chunks"))


def tagged(spark: SparkSession, path: str) -> DataFrame:
    """Tagged chunks of a JSON array file, cast and with defaults."""
    out = _rows(spark, path, TAGGED_ROW)
    number = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0).cast("long")).alias(c)
    word = lambda c, default="": F.coalesce(F.col(c), F.lit(default)).alias(c)
    return out.select(*map(word, ("chunk_id", "content", "role")), number("role_confidence"), *map(word, ("block_id", "source_file")), F.coalesce("breadcrumb", F.array().cast("array<string>")).alias("breadcrumb"), word("heading_path"), *map(number, ("start_line", "end_line", "token_estimate")), word("tagged_by", "rule"))


def catalog_tables(spark: SparkSession, path: str) -> DataFrame:
    """record, ord of a tables file: a row a record; several values of a column joined by bars, columns in their order."""
    raw = spark.read.text(path, wholetext=True)
    tables = F.from_json("value", F.lit("array<struct<table_name:string,columns:array<string>,records:array<map<string,string>>>>"))
    rows = raw.select(F.posexplode(tables).alias("t", "table")).select("t", "table.columns", F.posexplode("table.records").alias("r", "record"))
    value = lambda v: F.when(F.startswith(v, F.lit("[")), F.array_join(F.from_json(v, "array<string>"), " | ")).otherwise(v)
    record = F.map_from_arrays("columns", F.transform("columns", lambda c: value(F.coalesce(F.try_element_at("record", c), F.lit("")))))
    return rows.select(record.alias("record"), (F.col("t") * F.lit(1 << 32) + F.col("r")).alias("ord"))


def parse_answers(lines: DataFrame) -> DataFrame:
    """custom_id (long), answer of result lines (value); lines that are broken, blank or have an id that isn't a number are left out."""
    row = F.from_json("value", F.lit(CHAT_ROW))
    out = lines.select(row.alias("r")).where("r.custom_id rlike '^[0-9]+$'")
    return out.select(F.col("r.custom_id").cast("long").alias("custom_id"), F.coalesce(F.trim(F.get("r.response.body.choices", F.lit(0))["message"]["content"]), F.lit("")).alias("answer"))


def parse_embeddings(lines: DataFrame) -> DataFrame:
    """custom_id (string), embedding of result lines (value); empty where it is missing."""
    out = lines.select(F.from_json("value", F.lit(EMBEDDING_ROW)).alias("r")).where("r.custom_id is not null")
    return out.select("r.custom_id", F.coalesce(F.get("r.response.body.data", F.lit(0))["embedding"], F.array().cast("array<double>")).alias("embedding"))


def batch_answers(spark: SparkSession, path: str) -> DataFrame:
    """The answers of a batch result file."""
    return parse_answers(spark.read.text(path))


def batch_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """The vectors of a batch result file."""
    return parse_embeddings(spark.read.text(path))


def answered(requests: DataFrame, answers: DataFrame, value: str, default: Column) -> DataFrame:
    """Requests (custom_id) with their answers' value, the default where there is none."""
    return requests.join(answers.select("custom_id", value), "custom_id", "left").withColumn(value, F.coalesce(value, default))


def chat_requests(rows: DataFrame, model: str, max_tokens: int, temperature: float, path: str = "/v1/chat/completions") -> DataFrame:
    """JSON lines of a batch: rows (custom_id, messages) as requests."""
    body = F.struct(F.lit(model).alias("model"), "messages", F.lit(max_tokens).alias("max_tokens"), F.lit(temperature).alias("temperature"))
    return rows.select(F.to_json(F.struct(F.col("custom_id").cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit(path).alias("url"), body.alias("body"))).alias("value"))


def embedding_requests(rows: DataFrame, model: str, encoding: str = "float", path: str = "/v1/embeddings") -> DataFrame:
    """JSON lines of a batch: rows (custom_id, text) as requests for vectors."""
    body = F.struct(F.lit(model).alias("model"), F.col("text").alias("input"), F.lit(encoding).alias("encoding_format"))
    return rows.select(F.to_json(F.struct(F.col("custom_id").cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit(path).alias("url"), body.alias("body"))).alias("value"))


def env(text: str) -> dict[str, str]:
    """key=value lines; comments and blank lines are skipped, the first = splits, quotes around a value go."""
    pairs = (line.strip().partition("=") for line in text.splitlines() if line.strip() and not line.strip().startswith("#"))
    return {key.strip(): value.strip().strip("\"'") for key, sign, value in pairs if sign}


# --- fixed values: names in a scenario file ---
SCENARIO_TITLE = r'title:\s*"([^"]+)"'
SCENARIO_BODY = r"context:\s*(`?)"
SCENARIO_LISTS = ("experiment_supplies", "experiment_steps", "knowledge_points_list")
SCENARIO_PREFIX = '"experiment_'
SCENARIO_UNTITLED = "实验"
# --- end of fixed values ---


def _object(text: str) -> str:
    """The object that a text begins with: up to the bracket that closes it, or, where the text ends before, up to its last whole element with what is open closed."""
    closers: list[str] = []
    quoted = escaped = False
    whole = "{}"
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = escaped or c != '"', c == "\\" and not escaped
            ended = not quoted and closers[-1:] == ["]"]  # an element; a name isn't one
        elif c == '"':
            quoted, ended = True, False
        elif c in "[{":
            closers.append("]" if c == "[" else "}")
            ended = c == "["
        elif c in "]}" and closers[-1:] == [c]:
            closers.pop()
            ended = True
        else:
            ended = False
        if ended:
            whole = text[: i + 1] + "".join(reversed(closers))
            if not closers:
                break
    return whole


def scenario(text: str) -> tuple[str | None, list[str], list[str], list[str]] | None:
    """Title, supplies, steps and knowledge points of a scenario file: JSON within a script's object, between back quotes. A missing outer brace or back quote and a list that is cut short are mended; None if there is nothing to read."""
    body = re.search(SCENARIO_BODY, text)
    if not body:
        return None
    found = text[body.end() :]
    if body[1]:
        found = found.partition("`")[0]
    brace, name = found.find("{"), found.find(SCENARIO_PREFIX)
    if brace < 0 and name < 0:
        return None
    try:
        data = json.loads(_object(found[brace:] if brace >= 0 else "{" + found[name:]))
    except json.JSONDecodeError:
        return None
    title = re.search(SCENARIO_TITLE, text)
    return title[1] if title else None, *([str(x) for x in data.get(k) or []] for k in SCENARIO_LISTS)


SCENARIO = T.StructType([T.StructField("title", T.StringType()), *(T.StructField(c, T.ArrayType(T.StringType())) for c in ("supplies", "steps", "knowledge_points"))])


@F.pandas_udf(SCENARIO)
def scenario_parse(texts: pd.Series) -> pd.DataFrame:
    found = [scenario(t or "") or (None, None, None, None) for t in texts]
    return pd.DataFrame(found, columns=["title", "supplies", "steps", "knowledge_points"])


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """id, title, supplies, steps, knowledge_points of a folder's scenario files; unreadable ones are left out."""
    out = markdown(spark, path).select(F.regexp_replace("source_file", r"\.md$", "").alias("id"), scenario_parse("text").alias("x")).where("x.steps is not null")
    return out.select("id", F.coalesce("x.title", F.concat(F.lit(SCENARIO_UNTITLED), "id")).alias("title"), "x.supplies", "x.steps", "x.knowledge_points")


def save(df: DataFrame, path: str, form: str = "parquet", by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Writes a stage's result; tagged chunks partitioned by role let later searches read only their role."""
    writer = df.write.mode(mode).format(form)
    (writer.partitionBy(*by) if by else writer).save(path)


