"""Blocks to chunks within size limits, by folds over the token halves that chunks carry: no text is scanned again, and what a fold decides is put together once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import is_numbered_item, ordered_join, token_half, tokens_of, utrim
from . import folds

# --- fixed values: what marks the later parts of a chunk ---
MORE = ("(续", ")")
# --- end of fixed values ---

CHUNK = "struct<title:string,content:string,start_line:int,end_line:int,heading_level:int,half:bigint>"


def _chunk(title: Column, content: Column, start: Column, end: Column, level: Column, half: Column) -> Column:
    return F.struct(title.cast("string").alias("title"), content.cast("string").alias("content"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), level.cast("int").alias("heading_level"), half.cast("long").alias("half"))


def raw_chunks(lines: DataFrame, keys: list[str], settings: Settings = DEFAULT) -> DataFrame:
    """keys, chunk_no and a chunk of each stretch of a block's lines that a deeper heading or a long numbered item begins. Chunks without content go.

    A stretch without a heading has level 99, but 0 if it is its whole block."""
    order = Window.partitionBy(*keys).orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shown = ~F.col("is_noise") & ~F.col("is_table") & ~F.col("is_empty")
    numbered = is_numbered_item(F.col("cleaned"), settings)
    starts = shown & (F.row_number().over(order) > 1) & ((F.col("heading_level") > 0) | numbered)
    # an empty line counts once in a row, and only between lines that are shown
    own = F.when(shown, F.col("cleaned")).when(F.col("is_empty") & ~F.col("is_noise") & ~F.col("is_table"), F.lit(""))
    marked = lines.withColumn("chunk_no", F.sum(starts.cast("int")).over(upto)).withColumn("__own", own)
    grouped = marked.groupBy(*keys, "chunk_no").agg(
        F.min("line_no").alias("start_line"),
        F.max("line_no").alias("end_line"),
        F.min_by(F.when(F.col("heading_title") != "", F.col("heading_title")).otherwise(F.substring("cleaned", 1, settings.title_chars)), "line_no").alias("title"),
        F.min_by("heading_level", "line_no").alias("__level"),
        ordered_join("line_no", "__own", "\n").alias("content"),
    )
    content = utrim(F.regexp_replace("content", "\n{3,}", "\n\n"))
    alone = F.max("chunk_no").over(Window.partitionBy(*keys)) == 0
    level = F.when((F.col("__level") > 0) | alone, F.col("__level")).otherwise(99)
    grouped = grouped.withColumn("content", content).withColumn("heading_level", level).where("content <> ''")
    return grouped.select(*keys, "chunk_no", _chunk(F.col("title"), F.col("content"), F.col("start_line"), F.col("end_line"), F.col("heading_level"), token_half(F.col("content"))).alias("chunk"))


def in_order(raw: DataFrame, keys: list[str]) -> DataFrame:
    """keys and chunks: a block's chunks as an array."""
    rows = F.array_sort(F.collect_list(F.struct("chunk_no", "chunk")))
    return raw.groupBy(*keys).agg(F.transform(rows, lambda x: x["chunk"]).alias("chunks"))


def _stretch(items: Column, run: Column) -> Column:
    return F.slice(items, F.get(run, F.lit(0)) + 1, F.get(run, F.lit(1)) - F.get(run, F.lit(0)) + 1)


def _total(halves: Column) -> Column:
    return F.aggregate(halves, F.lit(0).cast("long"), lambda s, x: s + x)


def merge_small(chunks: Column, settings: Settings = DEFAULT) -> Column:
    """A chunk below the least size takes in those after it until it isn't; the last one may stay small. Halves add up, as line ends separate the pieces."""

    def joined(run: Column) -> Column:
        own = _stretch(chunks, run)
        first, last = F.get(chunks, F.get(run, F.lit(0))), F.get(chunks, F.get(run, F.lit(1)))
        return _chunk(first["title"], F.array_join(F.transform(own, lambda c: c["content"]), "\n\n"), first["start_line"], last["end_line"], first["heading_level"], _total(F.transform(own, lambda c: c["half"])))

    return F.transform(folds.runs_until(F.transform(chunks, lambda c: c["half"]), settings.chunk_min), joined)


def split_large(chunks: Column, settings: Settings = DEFAULT) -> Column:
    """A chunk above the largest size becomes parts of as many paragraphs as fit; a paragraph that is too large alone stays whole. Parts after the first are marked in the title."""
    none = F.array().cast("array<string>")
    texts = F.transform(chunks, lambda x: F.when(tokens_of(x["half"]) > settings.chunk_max, F.split(x["content"], "\n\n+")).otherwise(none))
    measured = F.transform(texts, lambda t: F.struct(t.alias("texts"), F.transform(t, token_half).alias("halves")))
    runs = folds.runs_within(F.transform(texts, lambda t: F.transform(t, token_half)), settings.chunk_max)
    # what a chunk's parts are made of stands beside it, so that each of them only takes its stretch
    given = F.zip_with(F.zip_with(chunks, measured, lambda x, m: F.struct(x.alias("x"), m["texts"].alias("texts"), m["halves"].alias("halves"))), runs, lambda g, r: F.struct(g["x"].alias("x"), g["texts"].alias("texts"), g["halves"].alias("halves"), r.alias("runs")))

    def parts(g: Column) -> Column:
        x = g["x"]
        title = lambda i: F.when(i > 0, F.concat(x["title"], F.lit(MORE[0]), i.cast("string"), F.lit(MORE[1]))).otherwise(x["title"])
        return F.transform(g["runs"], lambda run, i: _chunk(title(i), F.array_join(_stretch(g["texts"], run), "\n\n"), x["start_line"], x["end_line"], x["heading_level"], _total(_stretch(g["halves"], run))))

    return F.flatten(F.transform(given, lambda g: F.when(F.size(g["texts"]) > 0, parts(g)).otherwise(F.array(g["x"]))))


def sized(blocks: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Merges, splits and merges again; each step is a projection of its own, so that no array is computed twice."""
    for step in (merge_small, split_large, merge_small):
        blocks = blocks.withColumn("chunks", step(F.col("chunks"), settings))
    return blocks


def _merged_rows(rows: DataFrame, keys: list[str], settings: Settings) -> DataFrame:
    """merge_small for groups of any length: keys, chunk_no (of a run's first), chunk."""
    placed = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("chunk_no"))).withColumn("__half", F.col("chunk.half"))
    placed = placed.withColumn("__run", folds.run_rows(F.col("__n"), F.col("__half"), settings.chunk_min))
    runs = placed.groupBy(*keys, "__run").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))).alias("__x"))
    each = lambda f: F.transform("__x", lambda x: x["chunk"][f])
    first, last = F.get("__x", F.lit(0)), F.element_at("__x", -1)["chunk"]
    chunk = _chunk(first["chunk"]["title"], F.array_join(each("content"), "\n\n"), first["chunk"]["start_line"], last["end_line"], first["chunk"]["heading_level"], _total(each("half")))
    return runs.select(*keys, first["chunk_no"].alias("chunk_no"), chunk.alias("chunk"))


def sized_rows(raw: DataFrame, keys: list[str], settings: Settings = DEFAULT) -> DataFrame:
    """`sized` for groups of any length: keys, chunk_no (any order), chunk, a row for each chunk, so that no row holds a whole group."""
    merged = _merged_rows(raw, keys, settings).withColumn("__parts", split_large(F.array("chunk"), settings))
    split = merged.select(*keys, "chunk_no", F.posexplode_outer("__parts").alias("__part", "chunk"))
    return _merged_rows(split.select(*keys, F.struct("chunk_no", "__part").alias("chunk_no"), "chunk"), keys, settings)


def with_breadcrumb(chunks: Column, breadcrumb: Column) -> Column:
    """Puts the way to the block on a line before each content and counts it."""
    way = F.array_join(breadcrumb, " > ")
    return F.transform(chunks, lambda x: _chunk(x["title"], F.concat(way, F.lit("\n"), x["content"]), x["start_line"], x["end_line"], x["heading_level"], token_half(way) + x["half"]))


def exploded(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """One row a chunk: keys, chunk_idx, title, content, start_line, end_line, heading_level, token_estimate. Blocks without chunks go."""
    # the outer form, as Spark puts a filter before the other one that works the array out again
    out = blocks.select(*keys, F.posexplode_outer("chunks").alias("chunk_idx", "x")).where("chunk_idx IS NOT NULL")
    return out.select(*keys, "chunk_idx", "x.title", "x.content", "x.start_line", "x.end_line", "x.heading_level", tokens_of(F.col("x.half")).alias("token_estimate"))


def bins_in_order(sizes: Column, limit: int) -> Column:
    """The bin number of each size: a new bin when the next one would overflow a bin that isn't empty."""
    return folds.bins(sizes, limit)


def record_text(columns: Column, record: Column) -> Column:
    """`name: value` lines of a record (a map) in the order of its columns, without empty values."""
    lines = F.transform(columns, lambda c: F.when(utrim(F.coalesce(F.try_element_at(record, c), F.lit(""))) != "", F.concat(c, F.lit(": "), utrim(F.try_element_at(record, c)))))
    return F.array_join(lines, "\n")


def groups_in_order(sizes: Column, least: int) -> Column:
    """The group number of each size: a group below the least size takes in the next one."""
    return folds.groups(sizes, least)
