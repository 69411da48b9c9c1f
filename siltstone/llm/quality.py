"""Quality rules: a text's own statistics, and lines that recur across a host's documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, small, stage, text_key

SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30

#: A line recurs too often in more than this share of a host's distinct documents and in more than this number of them. The
#: number is small, so that hosts with few documents are held to it too; the share keeps what is merely common on a large one.
LINE_SHARE = 0.01
LINE_DOCUMENTS = 10

#: A document is depleted when fewer than this percentage of its words are left without such lines.
LEFT_PERCENT = 30


def _letters(text: Column) -> Column:
    return F.translate(text, " \t\n\x0b\f\r", "")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WORD_SPACE}]+", -1), lambda w: w != "")


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    Null and empty texts have zeros and fail. All is done within the row: equal windows are found by sorting their 64-bit
    hashes with their places, and only for texts in which a hash recurs. Columns of those names are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = _lines(text)
    step = df.withColumn("__words", F.transform(_words(text), lambda w: F.xxhash64(w)))
    step = step.withColumn("n_words", F.size("__words").cast("long"))
    # a window's hash from those of two shorter ones, so that no window is taken out by itself
    step = step.withColumn("__windows", F.when(F.col("n_words") > WINDOW_WORDS, F.col("__words")).otherwise(F.array().cast("array<bigint>"))).drop("__words")
    reach = 1
    while reach < WINDOW_WORDS:
        by = min(reach, WINDOW_WORDS - reach)
        rest = F.greatest(F.size("__windows") - by, F.lit(0))
        step = step.withColumn("__windows", F.zip_with(F.slice("__windows", F.lit(1), rest), F.slice("__windows", F.lit(by + 1), rest), lambda a, b: F.xxhash64(a, b)))
        reach += by
    recurs = F.size(F.array_distinct("__windows")) < F.size("__windows")
    step = step.withColumn("__sorted", F.when(recurs, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__windows")
    rest = F.slice("__sorted", F.lit(2), F.size("__sorted"))
    pairs = F.zip_with("__sorted", rest, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    step = step.withColumn("__at", F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))).drop("__sorted")
    gaps = F.zip_with("__at", F.slice("__at", F.lit(2), F.size("__at")), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW_WORDS)), F.lit(WINDOW_WORDS)))
    covered = F.aggregate(gaps, F.lit(0), lambda a, g: a + g)
    step = step.withColumns({
        "word_chars": F.length(_letters(text)).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }).drop("__at")
    return step.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: _letters(x) != "")


def _normal(line: Column) -> Column:
    """Lines count as one whatever their case, digits and spaces."""
    return F.regexp_replace(F.lower(line), f"[0-9{WORD_SPACE}]+", " ")


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(_normal(line)))


def _host(host_col: str) -> Column:
    return F.coalesce(F.col(host_col).cast("string"), F.lit("\0"))


def frequent_lines(df: DataFrame, host_col: str = "source", text_col: str = "text", share: float = LINE_SHARE, least: int = LINE_DOCUMENTS) -> DataFrame:
    """host, often: the hashes of the lines above the limits of each host that has such lines.

    Copies of a text on one host are one document. First each distinct text is kept once with the hashes of its distinct
    lines (partial aggregation drops copies before the shuffle); from these the lines are counted by host and hash, again with
    partial sums. A null host is a host of its own. Texts are told apart by 128 bits, lines by 64: where two lines share them,
    counts of the two add up, far below the limits. As each line takes its share of a host's documents, a host's list is no
    longer than lines a document over the share, however many documents it has."""
    hashed = F.array_distinct(F.transform(_lines(F.coalesce(F.col(text_col), F.lit(""))), _line_hash))
    texts = df.select(_host(host_col).alias("host"), text_key(F.col(text_col)).alias("text_hash"), hashed.alias("lines")).groupBy("host", "text_hash").agg(F.first("lines").alias("lines"))
    texts = stage(texts, "lines")
    hosts = stage(texts.groupBy("host").agg(F.count("*").alias("documents")), "hosts")
    counts = texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > least)
    often = counts.join(small(hosts), "host").where(F.col("n") > share * F.col("documents"))
    return stage(often.groupBy("host").agg(F.collect_set("line").alias("often")), "often")


def judge(df: DataFrame, host_col: str = "source", text_col: str = "text", share: float = LINE_SHARE, least: int = LINE_DOCUMENTS, left: int = LEFT_PERCENT) -> DataFrame:
    """All columns, the statistics, words_left, text_left (without the lines above the limits) and kept: false if the base rules fail or too few words are left (a depleted document).

    Documents meet their host's list of lines and are cut within the row: they aren't shuffled. Columns of these names in the
    input are replaced. Repeated rows are judged alike; an empty table gives none."""
    often = frequent_lines(df, host_col, text_col, share, least).select(F.col("host").alias("__host"), F.col("often").alias("__often"))
    each = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    hashes = F.transform(each, lambda x: F.when(_letters(x) != "", _line_hash(x)))
    # what costs is below the join: a filter on what follows stays above it and repeats only cheap looks at these hashes
    judged = statistics(df, text_col).withColumns({"__host": _host(host_col), "__hashes": hashes}).join(small(often), "__host", "left")
    goes = lambda h: F.coalesce(F.array_contains("__often", h), F.lit(False))
    removed = F.aggregate(F.zip_with(each, "__hashes", lambda x, h: F.when(goes(h), F.size(_words(x))).otherwise(0)), F.lit(0), lambda s, n: s + n)
    touched = F.coalesce(F.arrays_overlap("__often", "__hashes"), F.lit(False))
    out = judged.withColumn("words_left", F.col("n_words") - F.when(touched, removed).otherwise(0))
    out = out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(100 * F.col("words_left") >= left * F.col("n_words")))
    rest = F.array_join(F.filter(F.zip_with(each, "__hashes", lambda x, h: F.when(~goes(h), x)), lambda x: x.isNotNull()), "\n")
    out = out.withColumn("text_left", F.when(touched & F.col(text_col).isNotNull(), rest).otherwise(F.col(text_col)))
    return out.drop("__host", "__often", "__hashes")
