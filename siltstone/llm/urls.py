"""URL filters by hashed host-suffix and path-prefix expressions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of the short prefix: 32 bits.
PREFIX_DIGITS = 8

ALLOW = "allow"

#: Up to so many rules are sent to every task; longer tables are joined by a shuffle.
BROADCAST_RULES = 50_000


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, with A-Z lower-cased; empty where there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) pairs as a table: rule like `example.com/en/`, its host before the first slash and its path from there."""
    bad = [r for _, r in rules if not r.endswith("/")]
    if bad:
        raise ValueError(f"a rule's path ends with a slash: {bad}")
    return spark.createDataFrame([(v, r) for v, r in rules], "verdict string, rule string")


def _suffixes(host: Column, most: int) -> Column:
    """The last 1, 2, ... labels, as many as any rule has."""
    labels = F.split(host, r"\.", -1)
    ends = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(ends, lambda k: F.call_function("substring_index", host, F.lit("."), -k)))


def _prefixes(path: Column, most: int) -> Column:
    """The path up to its 1st, 2nd, ... slash, as many as any rule has."""
    parts = F.split(path, "/", -1)
    ends = F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(most)))
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(ends, lambda k: F.concat(F.call_function("substring_index", path, F.lit("/"), k), F.lit("/"))))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id", default: str = ALLOW, depth: tuple[int, int] | None = None) -> DataFrame:
    """Judges every URL: the longest rule that fits decides, else the default.

    Each URL becomes host-suffix and path-prefix expressions, only as deep as the rules go (longer ones can't equal a rule).
    The expressions meet the rules by an equi-join on the first 32 bits of their SHA-256; then the whole digests must agree.
    Of the rules that fit, the one with most characters wins; of equal rules, the smaller verdict (allow before block).
    Matches are folded into one row a page before anything is shuffled, so no host or rule gathers rows in one task.

    Null URLs and those without :// have an empty host and path, fit no rule and get the default. A null id is an id.
    Rows that repeat give as many rows. An empty rule table leaves all to the default.
    Returns the id, host, path, rule (null if none), verdict."""
    if depth is None:
        got = rules.agg(F.max(F.size(F.split(F.substring_index("rule", "/", 1), r"\."))).alias("h"), F.max(F.size(F.split("rule", "/")) - 1).alias("p")).first()
        depth = (got["h"] or 1, got["p"] or 1)
    listed = rules.select(F.sha2("rule", 256).alias("rule_digest"), F.substring(F.sha2("rule", 256), 1, PREFIX_DIGITS).alias("short"), F.struct(F.length("rule").alias("size"), (F.col("verdict") == ALLOW).alias("first"), F.col("rule"), F.col("verdict")).alias("hit"))
    if rules.count() <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    joined = F.flatten(F.transform(_suffixes(F.col("host"), depth[0]), lambda h: F.transform(_prefixes(F.col("path"), depth[1]), lambda p: F.concat(h, p))))
    # the empty expression goes first: it stands for the page's row itself and meets no rule
    spread = urls.select("id", "host", "path", F.posexplode(F.concat(F.array(F.lit("")), joined)).alias("at", "expression"))
    spread = spread.select("id", "host", "path", (F.col("at") == 0).alias("row"), F.sha2("expression", 256).alias("digest"))
    # markers get keys of another length, spread by the page, so that they don't gather under one key
    spread = spread.withColumn("near", F.when(F.col("row"), F.sha2(F.coalesce(F.col("id").cast("string"), F.lit("")), 256)).otherwise(F.substring("digest", 1, PREFIX_DIGITS)))
    met = spread.join(listed, (F.col("near") == F.col("short")) & ~F.col("row"), "left")
    fits = F.max(F.when(F.col("digest") == F.col("rule_digest"), F.col("hit")))
    best = met.groupBy("id", "host", "path").agg(F.count_if("row").alias("rows"), fits.alias("hit"))
    out = best.select(F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"))
    return out.drop("copy")
