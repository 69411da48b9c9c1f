"""A catalog of named entries: built from records, looked up by a cascade, and used to enrich queries."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Settings
from ..functions.text import utrim
from ..staging import small, stage

# --- fixed values: columns of the catalog tables, and activities by column ---
NAMES = ("病毒名称/中文名", "疾病中文名", "病原菌名称/中文名", "真菌名称/中文名")
SECOND_NAMES = ("病毒名称/英文名", "疾病英文名", "病原菌名称/拉丁文名称", "真菌名称/拉丁文名称")
LEVEL_PREFIX, CLASS, NOTES, TRANSPORT, UN_NUMBER, LOWEST = "实验活动所需实验室等级/", "危害程度分类", "备注", "A/B", "UN编号", "BSL-1"
ACTIVITIES = {
    "病毒培养": "culture",
    "动物感染实验": "animal",
    "未经培养的感染材料的操作": "sample",
    "灭活材料的操作": "inactivated",
    "无感染性材料的操作": "noninfectious",
    "活菌操作": "culture",
    "样本检测": "sample",
    "非感染性材料的实验": "noninfectious",
    "组织培养": "culture",
    "动物感染": "animal",
    "感染性材料的检测": "sample",
}
# --- end of fixed values ---


def first_of(record: Column, names: tuple[str, ...]) -> Column:
    """The value of the first of these columns that a record has."""
    return F.coalesce(*(F.try_element_at(record, F.lit(n)) for n in names))


def levels(record: Column) -> Column:
    """Map from activity to level: level columns, by the activity that their name (without footnote letters) stands for; empty values left out, of several columns the last."""
    chosen = F.map_filter(record, lambda k, v: F.startswith(k, F.lit(LEVEL_PREFIX)) & (utrim(F.coalesce(v, F.lit(""))) != ""))
    known = F.create_map(*(F.lit(x) for pair in ACTIVITIES.items() for x in pair))
    activity = lambda k: F.try_element_at(known, utrim(F.regexp_replace(F.substring(k, len(LEVEL_PREFIX) + 1, 1000), "[a-zA-Z]+$", "")))
    entries = F.filter(F.transform(F.map_entries(chosen), lambda e: F.struct(activity(e["key"]).alias("key"), utrim(e["value"]).alias("value"))), lambda e: e["key"].isNotNull())
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["value"]), -1)))


def build(records: DataFrame, order: str = "ord") -> DataFrame:
    """cn_name, en_name, hazard_class, lab_level, transport, notes, ord of records (record, ord). A name's last record counts, at the place of its first."""
    record = F.col("record")
    like = lambda part: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.map_values(F.map_filter(record, lambda k, _: F.contains(k, F.lit(part))))), -1)
    ab, un = utrim(F.coalesce(like(TRANSPORT), F.lit(""))), utrim(F.coalesce(like(UN_NUMBER), F.lit("")))
    one = records.select(
        utrim(F.regexp_replace(utrim(first_of(record, NAMES)), "[a-z]+$", "")).alias("cn_name"),
        F.coalesce(utrim(first_of(record, SECOND_NAMES)), F.lit("")).alias("en_name"),
        utrim(F.coalesce(F.try_element_at(record, F.lit(CLASS)), F.lit(""))).alias("hazard_class"),
        levels(record).alias("lab_level"),
        F.when((ab != "") | (un != ""), F.struct(ab.alias("category"), un.alias("un_number"))).alias("transport"),
        utrim(F.coalesce(F.try_element_at(record, F.lit(NOTES)), F.lit(""))).alias("notes"),
        F.col(order).alias("ord"),
    ).where(F.coalesce("cn_name", F.lit("")) != "")
    return upsert(one, "cn_name", "ord")


def upsert(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the last row's values, at the first row's place. Partial maxima are shuffled, not groups."""
    rest = [c for c in rows.columns if c not in (key, order)]
    out = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x"), F.min(order).alias(order))
    return out.select(key, *(F.col(f"x.{c}").alias(c) for c in rest), order)


def lookup_exact(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, cn_name of names (query_id, name) that equal a first name or, in lower case, a second name."""
    asked = names.withColumn("name", utrim("name"))
    first = asked.join(catalog.select(F.col("cn_name").alias("name"), F.col("cn_name").alias("__a")), "name", "left")
    second = catalog.where("en_name <> ''").groupBy(F.lower("en_name").alias("__low")).agg(F.max_by("cn_name", "ord").alias("__b"))
    both = first.join(second, F.lower("name") == F.col("__low"), "left")
    return both.select("query_id", F.coalesce("__a", "__b").alias("cn_name")).where(F.col("cn_name").isNotNull())


#: Characters of the fingerprint by which a name is found in other strings.
FINGERPRINT = 4


def _grams(text: Column, size: Column) -> Column:
    """The distinct stretches of this length; none of a shorter string."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(text, i, size))
    return F.when(F.length(text) >= size, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def _within(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """part, whole: which of the distinct strings `part` stand in which of the distinct strings `whole`.

    A whole is cut into its stretches of a few fixed lengths, which are as many as it has characters for each length. A part
    is known by the stretch of it that the fewest wholes have (a part shorter than that by itself), and looked for in these
    wholes only; one with a stretch that no whole has is in none."""
    size = F.least(F.length("part"), F.lit(FINGERPRINT))
    sizes = parts.agg(F.collect_set(size).alias("__sizes"))
    cut = wholes.crossJoin(F.broadcast(sizes)).select("whole", F.explode(F.flatten(F.transform("__sizes", lambda n: _grams(F.col("whole"), n)))).alias("gram"))
    held = cut.groupBy("gram").agg(F.count("*").alias("n"))
    each = parts.select("part", F.explode(_grams(F.col("part"), size)).alias("gram"))
    known = each.join(held, "gram", "left").groupBy("part").agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    return cut.join(known.where("n > 0").select("part", "gram"), "gram").where(F.contains("whole", "part")).select("part", "whole")


def _held(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """asked, entry: distinct strings of which one stands in the other."""
    a, e = asked.select("asked").distinct(), entries.select("entry").distinct()
    inside = _within(a.withColumnRenamed("asked", "part"), e.withColumnRenamed("entry", "whole")).select(F.col("part").alias("asked"), F.col("whole").alias("entry"))
    around = _within(e.withColumnRenamed("entry", "part"), a.withColumnRenamed("asked", "whole")).select(F.col("whole").alias("asked"), F.col("part").alias("entry"))
    return inside.unionByName(around).distinct()


def lookup_contains(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, cn_name: the entry with the longest name that holds the asked name or is in it, by the first name or else the second (in lower case); ties by place."""
    asked = names.select("query_id", utrim("name").alias("name")).where("name <> ''").withColumn("low", F.lower("name"))
    first = catalog.where("cn_name <> ''").select("cn_name", "ord", F.col("cn_name").alias("entry"))
    second = catalog.where("en_name <> ''").select("cn_name", "ord", F.lower("en_name").alias("entry"))
    one = asked.withColumn("asked", F.col("name")).join(_held(asked.select(F.col("name").alias("asked")), first), "asked").join(first, "entry").withColumn("size", F.length("entry"))
    two = asked.withColumn("asked", F.col("low")).join(_held(asked.select(F.col("low").alias("asked")), second), "asked").join(second, "entry").withColumn("size", F.length("entry"))
    met = one.select("query_id", "cn_name", "ord", "size", F.lit(0).alias("by")).unionByName(two.select("query_id", "cn_name", "ord", "size", F.lit(1).alias("by")))
    # an entry found by its first name counts with that
    entry = met.groupBy("query_id", "cn_name", "ord").agg(F.min_by("size", "by").alias("size"))
    return entry.groupBy("query_id").agg(F.max_by("cn_name", F.struct("size", -F.col("ord"))).alias("cn_name"))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two strings, in the order asked name, entry's name."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _characters(text: Column) -> Column:
    """A string's characters, those that repeat numbered."""
    each = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(each, lambda c, i: F.concat_ws("/", c, F.size(F.filter(F.slice(each, F.lit(1), i + 1), lambda x: x == c))))


def _by_rarity(strings: DataFrame, counts: DataFrame) -> DataFrame:
    """text, size, c: distinct strings (text) with their numbered characters, those first that the fewest strings have."""
    each = strings.select("text", F.explode(_characters(F.col("text"))).alias("c")).join(counts, "c")
    ordered = each.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("n", "c"))).alias("x"))
    return ordered.select("text", F.size("x").alias("size"), F.col("x.c").alias("c"))


def alike_candidates(asked: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """asked, entry: the pairs of distinct strings whose ratio has to be worked out, none left out that has at least this ratio.

    The ratio is twice the matched characters by both lengths, so that strings with the ratio r share at least r / (2 - r) of
    each one's numbered characters. With these in one order, the rarest of all strings first, they then share one of each
    one's first few: an equi-join on these. A pair goes at once if its lengths, or what can still be shared around the places
    where it met, don't allow the ratio; then if its characters in common don't."""
    share = least / (2 - least)
    a, e = asked.select(F.col("asked").alias("text")).distinct(), entries.select(F.col("entry").alias("text")).distinct()
    symbols = lambda df: df.select(F.explode(_characters(F.col("text"))).alias("c"))
    counts = small(stage(symbols(a).unionByName(symbols(e)).groupBy("c").agg(F.count("*").alias("n")), "characters"))
    a, e = stage(_by_rarity(a, counts), "asked"), stage(_by_rarity(e, counts), "entries")
    few = F.slice("c", F.lit(1), F.greatest(F.col("size") - F.ceil(F.col("size") * share - 1e-9).cast("int") + 1, F.lit(0)))
    head = lambda df, name: df.select(F.col("text").alias(name), F.col("size").alias(f"n_{name}"), F.posexplode(few).alias(f"at_{name}", "c"))
    needed = (least / 2 - 1e-9) * (F.col("n_asked") + F.col("n_entry"))
    around = lambda f: f(F.col("at_asked"), F.col("at_entry")) + 1 + F.least(F.col("n_asked") - F.col("at_asked"), F.col("n_entry") - F.col("at_entry")) - 1
    met = head(a, "asked").join(head(e, "entry"), "c").where((F.least("n_asked", "n_entry") >= needed) & (around(F.least) >= needed))
    pairs = met.select("asked", "entry", needed.alias("needed")).distinct()
    of = lambda df, name: df.select(F.col("text").alias(name), F.col("c").alias(f"c_{name}"))
    near = pairs.join(small(of(a, "asked")), "asked").join(small(of(e, "entry")), "entry")
    return near.where(F.size(F.array_intersect("c_asked", "c_entry")) >= F.col("needed")).select("asked", "entry")


def _alike(asked: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """asked, entry, score: distinct strings with at least this ratio."""
    return alike_candidates(asked, entries, least).select("asked", "entry", similarity("asked", "entry").alias("score")).where(F.col("score") >= least)


def lookup_similar(names: DataFrame, catalog: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """query_id, cn_name: the most similar entry by either name, if similar enough; ties by place. Only names that nothing cheaper found should get here."""
    asked = names.select("query_id", utrim("name").alias("name")).where("name <> ''").withColumn("low", F.lower("name"))
    first = catalog.select("cn_name", "ord", F.col("cn_name").alias("entry"))
    second = catalog.where("en_name <> ''").select("cn_name", "ord", F.lower("en_name").alias("entry"))
    found = None
    for column, entries in (("name", first), ("low", second)):
        own = asked.select("query_id", F.col(column).alias("asked"))
        part = own.join(_alike(own, entries, settings.similarity_min), "asked").join(entries, "entry").select("query_id", "cn_name", "ord", "score")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("query_id").agg(F.max_by("cn_name", F.struct("score", -F.col("ord"))).alias("cn_name"))


def lookup(names: DataFrame, catalog: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """query_id, cn_name, found_by: exact, then containment for the rest, then similarity for the rest of these. What a level found is written, so that the next doesn't work it out again."""
    out = None
    left = names.where(F.coalesce(utrim("name"), F.lit("")) != "")
    for how, find in (("exact", lookup_exact), ("contains", lookup_contains), ("similar", lambda n, c: lookup_similar(n, c, settings))):
        found = stage(find(left, catalog).withColumn("found_by", F.lit(how)), how)
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select("query_id"), "query_id", "left_anti")
    return out


def level_of(lab_level: Column, activity: Column) -> Column:
    """The level of a known activity as it stands; else all distinct levels but the lowest, without footnote letters, sorted."""
    cleaned = F.transform(F.map_values(lab_level), lambda v: F.regexp_replace(utrim(v), "[a-z]+$", ""))
    every = F.array_join(F.array_sort(F.array_distinct(F.filter(cleaned, lambda v: (v != "") & (v != LOWEST)))), " ")
    return F.coalesce(F.try_element_at(lab_level, activity), F.nullif(every, F.lit("")))


def enrich(slots: DataFrame, catalog: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Adds search_query to slots (query_id, pathogen, activity, roles, query): the entry's name, its level (not for directory questions), the query."""
    found = lookup(slots.select("query_id", F.col("pathogen").alias("name")), catalog, settings)
    entries = catalog.select("cn_name", "lab_level")
    out = slots.join(found.join(entries, "cn_name").select("query_id", "cn_name", "lab_level"), "query_id", "left")
    level = F.when(~F.array_contains("roles", "directory"), level_of(F.col("lab_level"), F.coalesce("activity", F.lit(""))))
    return out.withColumn("search_query", F.concat_ws(" ", F.nullif("cn_name", F.lit("")), level, F.nullif("query", F.lit("")))).drop("cn_name", "lab_level")
