"""Roles of chunks: weighted keywords, heading keywords and structure, the best role with its margin, junk."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import is_blank, utrim
from ..staging import staged
from .lines import positions

LEXICON = Path(__file__).resolve().parent.parent / "data" / "lexicon.json"

# --- fixed values: structure that speaks for a role ---
STEP = r"(?U)(?:^|\n)\s*(?:\d+[.、)）]|[（(]\d+[)）]|[一二三四五六七八九十]+[、.]|第[一二三四五六七八九十\d]+步|[Ss]tep\s*\d+)"
DEFINITION = r"(?U)(?:^|\n)\s*(?:\d+\.\d+\s+\S|术语|定义|含义|是指|即：|即,)"
TONE = ("必须", "应当", "不得", "禁止", "严禁", "违反")
JUNK_IMAGE_SHARE, JUNK_CHARS, JUNK_REFERENCES, JUNK_REFERENCE_SHARE = 0.8, 20, 2, 0.5
# --- end of fixed values ---


#: role, scope (body or heading), keyword, weight: configuration of a stated, small size that is part of the plan.
Words = list[tuple[str, str, str, int]]


def lexicon(path: str | Path = LEXICON, settings: Settings = DEFAULT) -> Words:
    """The keywords of a JSON file {scope: {role: {keyword: weight}}}."""
    table = json.loads(Path(path).read_text(encoding="utf-8"))
    return [(role, scope, word, weight) for scope, by_role in table.items() for role, words in by_role.items() for word, weight in words.items() if word and role in settings.roles]


def occurrences(text: Column, word: Column | str) -> Column:
    """Non-overlapping occurrences of a word that isn't empty."""
    word = F.lit(word) if isinstance(word, str) else word
    return F.floor((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("int")


def _passed(lines: Column) -> Column:
    """The place of the first line after the first one that is neither blank nor a # line; 0 if there is none."""
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.array_position(F.transform(rest, lambda x: ~is_blank(x) & ~x.rlike(r"(?U)^\s*#{1,6}\s+\S")), True)


def _rest(lines: Column, passed: Column) -> Column:
    return F.when(passed > 0, utrim(F.array_join(F.slice(lines, (passed + 1).cast("int"), F.size(lines)), "\n"))).otherwise("")


def strip_heading(text: Column) -> Column:
    """A chunk's body: without its first line (the way to it) and the blank and # lines after it; all of it if nothing would be left or it is one line."""
    rest = _rest(F.split(text, "\n"), _passed(F.split(text, "\n")))
    return F.when(rest != "", rest).otherwise(text)


def with_body(chunks: DataFrame) -> DataFrame:
    """Adds __body (see strip_heading) and __shown, its lines that aren't blank, step by step, so that no step is worked out twice."""
    lined = chunks.withColumn("__lines", F.split("content", "\n")).withColumn("__passed", _passed(F.col("__lines")))
    rest = lined.withColumn("__rest", _rest(F.col("__lines"), F.col("__passed"))).drop("__lines", "__passed")
    body = rest.withColumn("__body", F.when(F.col("__rest") != "", F.col("__rest")).otherwise(F.col("content"))).drop("__rest")
    return body.withColumn("__shown", _shown(F.col("__body")))


def structure_bonus(text: Column) -> dict[str, Column]:
    steps = F.regexp_count(text, F.lit(STEP))
    tone = sum((occurrences(text, w) for w in TONE), F.lit(0))
    return {
        "sop": F.when(steps >= 3, 4).when(steps >= 1, 2).otherwise(0),
        "knowledge": F.when(text.rlike(DEFINITION), 3).otherwise(0),
        "regulation": F.when(tone >= 3, 3).when(tone >= 1, 1).otherwise(0),
    }


def _shown(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: ~is_blank(x))


def junk_reason(text: Column, shown: Column | None = None) -> Column:
    """Why a text is junk, the first that holds: empty, image_only, too_short, reference_section; null if it isn't. shown: its lines that aren't blank, if they are there already."""
    lines = _shown(text) if shown is None else shown
    n = F.size(lines)
    images = F.size(F.filter(lines, lambda x: x.rlike(r"(?U)^\s*!\[.*?\]\(")))
    references = F.size(F.filter(lines, lambda x: x.rlike(r"(?U)^\s*\[?\d+\]")))
    visible = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"!\[.*?\]\(.*?\)", ""), r"(?U)https?://\S+", ""), r"(?U)\s+", ""))
    # without links and images a look at the beginning tells
    plain = ~F.contains(text, F.lit("![")) & ~F.contains(text, F.lit("http"))
    short = F.when(plain, ~text.rlike(rf"(?U)(?:\S\s*){{{JUNK_CHARS}}}")).otherwise(visible < JUNK_CHARS)
    return F.when(n == 0, "empty").when(images > JUNK_IMAGE_SHARE * n, "image_only").when(short, "too_short").when((references >= JUNK_REFERENCES) & (references > JUNK_REFERENCE_SHARE * n), "reference_section")


def _by_role(words: Words, scope: str, settings: Settings) -> Column:
    """The keywords of each role, in the roles' order, as one literal."""
    kind = "array<struct<keyword:string,weight:int>>"
    lists = [[F.struct(F.lit(k).alias("keyword"), F.lit(w).cast("int").alias("weight")) for r, s, k, w in words if (r, s) == (role, scope)] for role in settings.roles]
    return F.array(*(F.array(*x).cast(kind) for x in lists))


def scored(chunks: DataFrame, words: Words, key: str = "chunk_id", settings: Settings = DEFAULT, keep: list[str] | None = None) -> DataFrame:
    """key (or the columns to keep) and scores: of each role in order a struct (score, back, role), back the negative place of the role, so that the greatest is the best.

    Scores are exploded by the outer form (they are never empty): before the other one Spark puts a filter that works all of
    them out again, many times over.

    All within the row: no join and no shuffle. Body keywords count a few times at most, heading keywords by presence and
    twice, structure adds its bonus."""
    names = keep or [key]
    body = with_body(chunks).withColumn("__path", F.coalesce("heading_path", F.lit("")))
    total = lambda list_, each: F.aggregate(list_, F.lit(0).cast("long"), lambda s, x: s + each(x))
    in_body = F.transform(_by_role(words, "body", settings), lambda w: total(w, lambda x: F.when(F.contains(F.col("__body"), x["keyword"]), F.least(occurrences(F.col("__body"), x["keyword"]), F.lit(settings.keyword_cap)) * x["weight"]).otherwise(0)))
    in_path = F.transform(_by_role(words, "heading", settings), lambda w: total(w, lambda x: F.contains(F.col("__path"), x["keyword"]).cast("int") * settings.heading_factor * x["weight"]))
    extra = {**structure_bonus(F.col("__body")), "junk": F.when(junk_reason(F.col("__body"), F.col("__shown")).isNotNull(), settings.junk_bonus).otherwise(0)}
    found = body.select(*names, in_body.alias("__a"), in_path.alias("__b"), F.array(*(F.coalesce(extra.get(r, F.lit(0)), F.lit(0)).cast("long") for r in settings.roles)).alias("__c"))
    each = [F.struct((F.get("__a", F.lit(i)) + F.get("__b", F.lit(i)) + F.get("__c", F.lit(i))).alias("score"), F.lit(-i).alias("back"), F.lit(r).alias("role")) for i, r in enumerate(settings.roles)]
    return found.select(*names, F.array(*each).alias("scores"))


def scores(chunks: DataFrame, words: Words, key: str = "chunk_id", settings: Settings = DEFAULT) -> DataFrame:
    """key, role, role_ord, score: every role of every chunk (key, content, heading_path)."""
    return scored(chunks, words, key, settings).select(key, F.inline_outer("scores")).select(key, "role", (-F.col("back")).alias("role_ord"), "score")


def argmax(scored_chunks: DataFrame, key: str = "chunk_id", keep: list[str] | None = None) -> DataFrame:
    """key (or the columns to keep), role, confidence: the best role (ties by the roles' order) and its lead over the second."""
    names = keep or [key]
    top = scored_chunks.select(*names, F.sort_array("scores", asc=False).alias("__top"))
    return top.select(*names, F.get("__top", F.lit(0))["role"].alias("role"), (F.get("__top", F.lit(0))["score"] - F.coalesce(F.get("__top", F.lit(1))["score"], F.lit(0))).alias("confidence"))


def query_roles(scored_queries: DataFrame, key: str = "query_id", k: int = 2) -> DataFrame:
    """key, roles: the best roles of a query, junk left out."""
    top = F.slice(F.sort_array(F.filter("scores", lambda x: x["role"] != "junk"), asc=False), 1, k)
    return scored_queries.select(key, F.transform(top, lambda x: x["role"]).alias("roles"))


def parse_role(answer: Column, settings: Settings = DEFAULT) -> Column:
    """The role that a model's answer names: its letters as a whole, else the first role (in order) within it; null if none."""
    letters = F.regexp_replace(F.lower(answer), "[^a-z]", "")
    exact = F.when(letters.isin(*settings.roles), letters)
    return F.coalesce(exact, *(F.when(F.contains(F.lower(answer), F.lit(r)), r) for r in settings.roles))


def low_margin(tagged: DataFrame, settings: Settings = DEFAULT, order: str = "chunk_id") -> DataFrame:
    """Rows below the margin with custom_id, their place among these (from 0) in the order.

    They are chosen from a staged table: a filter on what isn't written yet would work the roles out many times over, and the
    ranges of the order once more."""
    return positions(staged(tagged, "tagged").where(F.col("confidence") < settings.low_margin), order, "custom_id")


def backfill(tagged: DataFrame, low: DataFrame, answers: DataFrame, key: str = "chunk_id", settings: Settings = DEFAULT) -> DataFrame:
    """Adds tagged_by: rows whose custom_id has an answer (custom_id, answer) that names a role get it; the others keep theirs."""
    named = low.select(key, "custom_id").join(answers.select("custom_id", parse_role(F.col("answer"), settings).alias("__role")), "custom_id").where(F.col("__role").isNotNull())
    out = tagged.join(named.select(key, "__role"), key, "left")
    return out.withColumn("role", F.coalesce("__role", "role")).withColumn("tagged_by", F.when(F.col("__role").isNull(), "rule").otherwise("llm")).drop("__role")


def distribution(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("role").agg(F.count("*").alias("n"))
