"""Documents to tagged chunks: the offline pipeline as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import ordered_join, token_half, tokens_of
from ..operators import chunks as ch
from ..operators import folds, outline, roles, tables
from ..operators import lines as ln
from ..operators.lines import latest_before
from ..staging import discard, small, stage


# --- fixed values: what marks the parts of a table's block ---
PART = ("(第", "部分)")
# --- end of fixed values ---


def lines_of(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of each block by its span, as an as-of join: no pairs of lines and blocks."""
    starts = found.select("source_file", F.col("first_line").alias("line_no"), F.struct("block_no", "last_line").alias("__b"))
    out = latest_before(lines, starts, ["source_file"], ["line_no"], "__b").where(F.col("line_no") <= F.col("__b.last_line"))
    return out.withColumn("block_no", F.col("__b.block_no")).drop("__b")


def text_chunks(docs: DataFrame, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Blocks (source_file, block_no, ...), and chunks (source_file, block_no, chunk_idx, ...) with the way to them in front.

    Documents are texts (source_file, text), or come as pieces (source_file, piece, text; see lines.pieces_of), whatever their length.
    Lines are parsed once, into a staged table that blocks, cuts and chunks read, and that is emptied when blocks and chunks
    are staged themselves."""
    lines = ln.parse(ln.of_pieces(docs) if "piece" in docs.columns else ln.explode_lines(docs), settings=settings)
    lines = stage(lines.select("source_file", "line_no", "cleaned", "heading_level", "heading_title", "is_noise", "is_table", "is_empty"), "lines")
    found = outline.measured_blocks(lines, settings=settings)
    found = outline.merge_shells(found, settings=settings)
    found = outline.split_oversized(lines, found, settings=settings)
    found = stage(outline.merge_tiny(found, settings=settings), "blocks")
    keys = ["source_file", "block_no"]
    raw = ch.in_order(ch.raw_chunks(lines_of(found, lines), keys, settings), keys)
    sized = ch.sized(raw, settings).join(found.select(*keys, "breadcrumb"), keys)
    sized = sized.withColumn("chunks", ch.with_breadcrumb(F.col("chunks"), F.col("breadcrumb")))
    out = stage(ch.exploded(sized, keys), "chunks")
    discard(lines)
    return found, out


def table_chunks(docs: DataFrame, blocks: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """source_file, table_block, block_title, chunk_idx, title, content, start_line, token_estimate, breadcrumb of the records of all tables.

    Each table hangs below the latest of the blocks (those that have chunks) that doesn't start after it. The way to it
    stands before each content and counts. A table above the largest size is cut into parts of chunks in order; a part below
    the least size takes in the next one of its line, as do small tables that share a line."""
    found = stage(tables.read_tables(docs if "piece" in docs.columns else ln.pieces_of(docs)), "tables")
    heads = stage(tables.table_heads(found), "heads")
    starts = blocks.select("source_file", F.col("start_line").alias("line_no"), F.col("breadcrumb").alias("__trail"))
    placed = latest_before(heads.select("source_file", "table_index", "table_name", "line_no"), starts, ["source_file"], ["line_no"], "__trail")
    placed = stage(placed.select("source_file", "table_index", F.concat(F.coalesce("__trail", F.array().cast("array<string>")), F.array("table_name")).alias("breadcrumb")), "placed")
    records, keys = tables.record_rows(found, heads)
    grouped = tables.group_spans(records, keys)
    text = ch.record_text(F.col("columns"), F.col("record"))
    items = F.array_join(F.transform("sub_items", lambda m, i: F.concat(F.lit("  " + tables.SUB_ITEMS), (i + 1).cast("string"), F.lit(": "), F.array_join(F.transform(F.filter(F.map_entries(m), lambda e: F.trim(e["value"]) != ""), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; "))), "\n")
    content = F.concat_ws("\n", F.nullif(text, F.lit("")), F.nullif(items, F.lit("")))
    hint = F.array_join(F.slice(F.filter(F.map_values("record"), lambda v: F.trim(v) != ""), 1, 2), " - ")
    rows = grouped.select(*keys, "record_no", content.alias("content"), F.when(hint == "", F.concat(F.lit("#"), (F.col("record_no") + 1).cast("string"))).otherwise(hint).alias("hint"))
    raw = rows.select(*keys, F.col("record_no").alias("chunk_no"), ch._chunk(F.concat_ws(" | ", "table_name", "hint"), F.col("content"), F.col("line_no"), F.col("line_no"), F.lit(99), token_half(F.col("content"))).alias("chunk"))
    sized = ch.sized_rows(raw, keys, settings).join(small(placed), ["source_file", "table_index"])
    sized = sized.withColumn("chunk", F.get(ch.with_breadcrumb(F.array("chunk"), F.col("breadcrumb")), F.lit(0))).drop("breadcrumb").withColumn("tokens", tokens_of(F.col("chunk.half")).cast("long"))
    sized = sized.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("chunk_no"))).drop("chunk_no")
    sized = stage(sized.withColumn("part", folds.bin_rows(F.col("at"), F.col("tokens"), settings.block_max)), "records")
    discard(found)
    # parts of tables, and which of them are one block, are told by numbers; the chunks meet them once
    parts = sized.groupBy(*keys, "part").agg(F.sum("tokens").alias("tokens"))
    name = F.concat("table_name", F.lit(PART[0]), (F.col("part") + 1).cast("string"), F.lit(PART[1]))
    parts = parts.withColumn("title", F.when(F.max("part").over(Window.partitionBy("source_file", "table_index")) > 0, name).otherwise(F.col("table_name")))
    parts = parts.withColumn("__n", F.row_number().over(Window.partitionBy("source_file", "line_no").orderBy("table_index", "part")))
    parts = stage(parts.withColumn("group", folds.group_rows(F.col("__n"), F.col("tokens"), settings.block_min)), "parts")
    merged = parts.join(placed, ["source_file", "table_index"]).groupBy("source_file", "line_no", "group").agg(F.max_by("title", "__n").alias("block_title"), F.min_by("breadcrumb", "__n").alias("breadcrumb"))
    merged = merged.withColumn("table_block", F.row_number().over(Window.partitionBy("source_file").orderBy("line_no", "group")) - 1)
    blocks_of = stage(parts.select("source_file", "line_no", "table_index", "part", "group").join(merged, ["source_file", "line_no", "group"]).drop("line_no", "group"), "table_blocks")
    out = sized.join(small(blocks_of), ["source_file", "table_index", "part"])
    order = Window.partitionBy("source_file", "table_block").orderBy("table_index", "at")
    out = out.withColumn("chunk_idx", F.row_number().over(order) - 1)
    return out.select("source_file", "table_block", "block_title", "chunk_idx", "chunk.title", "chunk.content", F.col("line_no").alias("start_line"), tokens_of(F.col("chunk.half")).alias("token_estimate"), "breadcrumb")


def all_chunks(text: DataFrame, text_blocks: DataFrame, table: DataFrame) -> DataFrame:
    """Text and table chunks of a document in one order: by start, text before tables, then their own order. source_file, chunk_no, is_table, block_no (in the same order, without blocks that have no chunks), chunk_idx, block_title, title, content, token_estimate, breadcrumb, start_line."""
    shown = ["chunk_idx", "block_title", "title", "content", "token_estimate", "breadcrumb", "start_line"]
    own = text_blocks.select("source_file", "block_no", "breadcrumb", F.col("title").alias("block_title"), F.col("start_line").alias("__start"))
    a = text.join(own, ["source_file", "block_no"]).select("source_file", "__start", F.lit(False).alias("is_table"), F.col("block_no").alias("__a"), *shown)
    b = table.select("source_file", F.col("start_line").alias("__start"), F.lit(True).alias("is_table"), F.col("table_block").alias("__a"), *shown)
    block = ["__start", "is_table", "__a"]
    order = Window.partitionBy("source_file")
    out = a.unionByName(b).withColumn("chunk_no", F.row_number().over(order.orderBy(*block, "chunk_idx")) - 1).withColumn("block_no", F.dense_rank().over(order.orderBy(*block)) - 1)
    return out.select("source_file", "chunk_no", "is_table", "block_no", *shown)


def ingested(docs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Documents (source_file, text; or as pieces) to all their chunks: lines, blocks and their merges, chunks, tables, one order."""
    blocks, text = text_chunks(docs, settings)
    filled = blocks.join(text.select("source_file", "block_no").distinct(), ["source_file", "block_no"], "left_semi")
    return all_chunks(text, blocks, table_chunks(docs, filled, settings))


def tree(blocks: DataFrame) -> DataFrame:
    """source_file, outline: a report of each document's blocks, indented by level."""
    line = F.concat(F.repeat(F.lit("  "), F.size("breadcrumb") - 1), F.lit("- "), "title", F.lit(" ["), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("]"))
    return blocks.withColumn("__line", line).groupBy("source_file").agg(ordered_join("start_line", "__line", "\n").alias("outline"))


def tagged(blocks: DataFrame, chunks: DataFrame, words: roles.Words, settings: Settings = DEFAULT) -> DataFrame:
    """Chunks with ids, the way to them and the rules' role: chunk_id, content, role, role_confidence, block_id, source_file, breadcrumb, heading_path, start_line, end_line, token_estimate, tagged_by. Blocks are numbered in their document."""
    block_id = F.concat(F.regexp_replace("source_file", r"\.md$", ""), F.lit("_block"), F.col("block_no").cast("string"))
    rows = chunks.join(blocks.select("source_file", "block_no", "breadcrumb"), ["source_file", "block_no"])
    rows = rows.withColumn("block_id", block_id).withColumn("chunk_id", F.concat("block_id", F.lit("_chunk"), F.col("chunk_idx").cast("string"))).withColumn("heading_path", F.array_join("breadcrumb", " > "))
    out = roles.argmax(roles.scored(rows, words, keep=rows.columns, settings=settings), keep=rows.columns)
    return out.select("chunk_id", "content", "role", F.col("confidence").alias("role_confidence"), "block_id", "source_file", "breadcrumb", "heading_path", "start_line", "end_line", "token_estimate", F.lit("rule").alias("tagged_by"))
