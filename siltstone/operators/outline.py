"""Classified lines to blocks with breadcrumbs: boundaries and breadcrumbs by windows, merges by folds over a document's blocks."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Settings
from ..functions.text import token_half
from .folds import LISTS, by_rows
from .lines import latest_before


#: Fixed value: the title of a document without headings and without a name.
WHOLE = "全文"


def with_blocks(lines: DataFrame, doc: str = "source_file", settings: Settings = DEFAULT) -> DataFrame:
    """Adds block_no (0 for what precedes the first heading) to lines: a running sum of headings of the block level or above."""
    upto = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = F.col("heading_level").between(1, settings.block_level)
    return lines.withColumn("block_no", F.sum(starts.cast("int")).over(upto))


def _measures(settings: Settings) -> list[Column]:
    """What the folds need to know of a block, by its lines: their span, whether it is a shell (few lines, none with content), its token half."""
    content = ~F.col("is_noise") & ~F.col("is_table") & ~F.col("is_empty")
    return [
        F.min("line_no").alias("first_line"),
        F.max("line_no").alias("last_line"),
        ((F.count("*") <= settings.shell_lines_max) & (F.count_if(content & (F.col("heading_level") == 0)) == 0)).alias("shell"),
        F.coalesce(F.sum(F.when(content, token_half(F.col("cleaned")))), F.lit(0)).alias("half"),
    ]


MEASURES = ("first_line", "last_line", "shell", "half")


def blocks(lines: DataFrame, doc: str = "source_file", settings: Settings = DEFAULT) -> DataFrame:
    """doc, block_no, title, heading_level, start_line, end_line, breadcrumb: `measured_blocks` without the measures, which aren't computed then."""
    return measured_blocks(lines, doc, settings).drop(*MEASURES)


def measured_blocks(lines: DataFrame, doc: str = "source_file", settings: Settings = DEFAULT) -> DataFrame:
    """doc, block_no, title, heading_level, start_line, end_line, the measures of `measured`, breadcrumb: one window and one aggregate over the lines, one shuffle by document.

    A document without headings is one block of level 1 with the document's name. Text before the first heading is a block
    of level 0 named by its first usable line, if it has one; without one the lines before are in no block."""
    named = with_blocks(lines, doc, settings)
    usable = ~F.col("is_noise") & ~F.col("is_empty") & ~F.col("is_table") & (F.col("cleaned") != "")
    grouped = named.groupBy(doc, "block_no").agg(
        F.min("line_no").alias("start_line"),
        F.max("line_no").alias("end_line"),
        F.min_by("heading_title", "line_no").alias("__title"),
        F.min_by("heading_level", "line_no").alias("__level"),
        F.min_by(F.when(usable, F.substring("cleaned", 1, settings.title_chars)), F.when(usable, F.col("line_no"))).alias("__first"),
        *_measures(settings),
    )
    whole = Window.partitionBy(doc)
    grouped = grouped.withColumn("__blocks", F.max("block_no").over(whole))
    lone = F.col("__blocks") == 0
    level = F.when(lone, 1).when(F.col("block_no") == 0, 0).otherwise(F.col("__level"))
    title = F.when(lone, F.when(F.col(doc).cast("string") == "", WHOLE).otherwise(F.col(doc).cast("string"))).when(F.col("block_no") == 0, F.col("__first")).otherwise(F.col("__title"))
    out = grouped.select(doc, "block_no", title.alias("title"), level.cast("int").alias("heading_level"), "start_line", "end_line", *MEASURES).where(F.col("title").isNotNull())
    return out.withColumn("breadcrumb", breadcrumb(doc, settings.block_level))


def breadcrumb(doc: str, deepest: int) -> Column:
    """Titles on the way to each block: of each level above it the last one that no heading of that level or above has closed."""
    upto = Window.partitionBy(doc).orderBy("block_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = []
    for level in range(deepest + 1):
        here = F.last(F.when(F.col("heading_level") == level, F.struct(F.col("block_no").alias("at"), F.col("title").alias("title"))), ignorenulls=True).over(upto)
        closed = F.last(F.when(F.col("heading_level") < level, F.col("block_no")), ignorenulls=True).over(upto)
        parts.append(F.when((F.col("heading_level") >= level) & (F.coalesce(closed, F.lit(-1)) < here["at"]), here["title"]))
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


#: One row a block: what the folds need to know of its lines.
BLOCK = "title string, heading_level int, start_line int, end_line int, breadcrumb array<string>, first_line int, last_line int, shell boolean, half bigint"


def measured(lines: DataFrame, found: DataFrame, doc: str = "source_file", settings: Settings = DEFAULT) -> DataFrame:
    """Blocks that are given apart from their lines, with their span of lines, whether they are shells, and their token half."""
    sizes = with_blocks(lines, doc, settings).groupBy(doc, "block_no").agg(*_measures(settings))
    return found.join(sizes, [doc, "block_no"])


def _shell_runs(shell: list[bool], level: list[int], title_chars: list[int], settings: Settings) -> list[list[int]]:
    """Runs (first, own, last) of a document's blocks: own is the block whose title and level stay. A shell is absorbed by what follows if that is deeper, or of its level and its own title short."""
    out: list[list[int]] = []
    held = last = -1
    for i, empty in enumerate(shell):
        if held < 0 and not empty:
            out.append([i, i, i])
        elif held >= 0 and empty and level[i] > level[held]:
            last = i
        elif empty:
            if held >= 0:
                out.append([held, held, last])
            held = last = i
        else:
            if level[held] < level[i] or (level[held] == level[i] and title_chars[held] <= settings.shell_title_max):
                out.append([held, i, i])
            else:
                out += [[held, held, last], [i, i, i]]
            held = -1
    return out if held < 0 else [*out, [held, held, last]]


def _tiny_runs(half: list[int], root: list[str], settings: Settings) -> list[list[int]]:
    """Runs (first, own, last): small blocks join the next one of their root chapter; at the end, and in a last sweep from the end, the one before."""
    out: list[list[int]] = []
    sums: list[int] = []
    small = lambda k: sums[k] // 2 + 1 < settings.block_min
    for i, own in enumerate(half):
        first = i
        if out and small(-1) and root[out[-1][1]] == root[i]:
            first = out.pop()[0]
            own += sums.pop()
        out.append([first, i, i])
        sums.append(own)
    for k in range(len(out) - 1, 0, -1):
        if small(k) and root[out[k - 1][1]] == root[out[k][1]]:
            out[k - 1][2] = out[k][2]
            sums[k - 1] += sums[k]
            del out[k], sums[k]
    return out


RUNS = T.ArrayType(T.ArrayType(T.IntegerType()))


def _merged(measured_blocks: DataFrame, runs: Callable[[Column], Column], doc: str, end: int) -> DataFrame:
    """Merges each document's blocks by runs of them. Python sees only the few arrays that decide; the blocks themselves stay in the JVM. end: which of a run's blocks says where it ends."""
    names = [x.split()[0] for x in BLOCK.split(", ")]
    listed = measured_blocks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("start_line", "block_no", *(n for n in names if n != "start_line")))).alias("blocks"))
    listed = listed.withColumn("runs", runs(F.col("blocks")))

    def built(r: Column) -> Column:
        first, own, last, ends = (F.get("blocks", F.get(r, F.lit(k))) for k in (0, 1, 2, end))
        absorbed = (F.get(r, F.lit(0)) < F.get(r, F.lit(1))) & F.lit(end == 1) & ~F.array_contains(own["breadcrumb"], first["title"])
        trail = F.when(absorbed, F.concat(first["breadcrumb"], F.filter(own["breadcrumb"], lambda t: ~F.array_contains(first["breadcrumb"], t)))).otherwise(own["breadcrumb"])
        covered = F.slice("blocks", F.get(r, F.lit(0)) + 1, F.get(r, F.lit(2)) - F.get(r, F.lit(0)) + 1)
        half = F.aggregate(covered, F.lit(0).cast("long"), lambda s, b: s + b["half"])
        values = (own["title"], own["heading_level"], first["start_line"], ends["end_line"], trail, first["first_line"], last["last_line"], own["shell"], half)
        return F.struct(*(v.cast(kind).alias(n) for v, (n, kind) in zip(values, (x.split(" ", 1) for x in BLOCK.split(", ")), strict=True)))

    return listed.select(doc, F.posexplode_outer(F.transform("runs", built)).alias("block_no", "b")).where("block_no IS NOT NULL").select(doc, "block_no", "b.*")


def merge_shells(measured_blocks: DataFrame, doc: str = "source_file", settings: Settings = DEFAULT) -> DataFrame:
    """Merges empty blocks into what they head. A group is one document's blocks."""

    @F.arrow_udf(RUNS)
    def found(shell: pa.Array, level: pa.Array, chars: pa.Array) -> pa.Array:
        return by_rows(lambda *row: _shell_runs(*row, settings), LISTS, shell, level, chars)

    each = lambda b, f: F.transform(b, f)
    return _merged(measured_blocks, lambda b: found(each(b, lambda x: x["shell"]), each(b, lambda x: x["heading_level"]), each(b, lambda x: F.length(x["title"]))), doc, end=1)


def merge_tiny(measured_blocks: DataFrame, doc: str = "source_file", settings: Settings = DEFAULT) -> DataFrame:
    """Merges blocks below the least size within their root chapter."""

    @F.arrow_udf(RUNS)
    def found(half: pa.Array, root: pa.Array) -> pa.Array:
        return by_rows(lambda *row: _tiny_runs(*row, settings), LISTS, half, root)

    each = lambda b, f: F.transform(b, f)
    return _merged(measured_blocks, lambda b: found(each(b, lambda x: x["half"]), each(b, lambda x: F.coalesce(F.get(x["breadcrumb"], F.lit(0)), F.lit("")))), doc, end=2)


def _pieces(level: list[int], half: list[int], block: list[int], own: list[int], settings: Settings) -> list[list[int]]:
    """Pieces (first, last, cut ...) of a document's stretches, each of which a heading begins: block, own: the number and level of its block; cuts: the stretches whose headings a piece has below its block's, in order."""
    pieces: list[tuple[int, int, int, list[int]]] = []
    for k, number in enumerate(block):
        if k and block[k - 1] == number:
            pieces[-1] = (pieces[-1][0], k, own[k], [])
        else:
            pieces.append((k, k, own[k], []))
    for _ in range(settings.heading_cap):
        out: list[tuple[int, int, int, list[int]]] = []
        for first, last, top, cuts in pieces:
            deeper = [k for k in range(first + 1, last + 1) if level[k] > top] if sum(half[first : last + 1]) // 2 + 1 > settings.block_max else []
            if not deeper:
                out.append((first, last, top, cuts))
                continue
            least = min(level[k] for k in deeper)
            at = [k for k in deeper if level[k] == least]
            out.append((first, at[0] - 1, top, cuts))
            out += [(k, end - 1, least, [*cuts, k]) for k, end in zip(at, [*at[1:], last + 1], strict=True)]
        pieces = out
    return [[first, last, *cuts] for first, last, _, cuts in pieces]


def split_oversized(lines: DataFrame, measured_blocks: DataFrame, doc: str = "source_file", settings: Settings = DEFAULT) -> DataFrame:
    """Cuts blocks above the largest size at their shallowest deeper heading, again and again: as many rounds as there are levels. The first piece keeps title and breadcrumb; the others add their heading.

    Lines become stretches from heading to heading by one window, and a document's stretches go through a fold that sees levels and sizes only."""
    start = F.struct("title", "heading_level", "breadcrumb", "shell", "last_line", F.col("block_no").alias("no"))
    content = ~F.col("is_noise") & ~F.col("is_table") & ~F.col("is_empty")
    body = lines.select(doc, "line_no", F.col("heading_level").alias("level"), "heading_title", F.when(content, token_half(F.col("cleaned"))).otherwise(0).alias("half"))
    now = latest_before(body, measured_blocks.select(doc, F.col("first_line").alias("line_no"), start.alias("block")), [doc], ["line_no"], "block")
    now = now.where(F.col("line_no") <= F.col("block.last_line"))
    order = Window.partitionBy(doc).orderBy("line_no")
    now = now.withColumn("__before", F.lag("block.no").over(order))
    begins = (F.col("level") > 0) | F.coalesce(F.col("__before") != F.col("block.no"), F.lit(True))
    now = now.withColumn("__begins", begins).withColumn("__at", F.sum(begins.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # what a stretch has from its first line stands on that line only
    head = F.when(F.col("__begins"), F.struct(F.col("level").cast("int").alias("level"), F.col("heading_title").alias("title"), "block"))
    found = now.groupBy(doc, "__at").agg(F.min("line_no").cast("int").alias("first_line"), F.max("line_no").cast("int").alias("last_line"), F.coalesce(F.sum("half"), F.lit(0)).alias("half"), F.first(head, ignorenulls=True).alias("h"))
    listed = found.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("__at", "first_line", "last_line", "half", "h"))).alias("s"))

    @F.arrow_udf(RUNS)
    def cut(level: pa.Array, half: pa.Array, block: pa.Array, own: pa.Array) -> pa.Array:
        return by_rows(lambda *row: _pieces(*row, settings), LISTS, level, half, block, own)

    each = lambda f: F.transform("s", f)
    listed = listed.withColumn("pieces", cut(each(lambda x: x["h"]["level"]), each(lambda x: x["half"]), each(lambda x: x["h"]["block"]["no"]), each(lambda x: x["h"]["block"]["heading_level"])))

    def built(r: Column) -> Column:
        first, last = F.get("s", F.get(r, F.lit(0))), F.get("s", F.get(r, F.lit(1)))
        cuts = F.slice(r, F.lit(3), F.greatest(F.size(r) - 2, F.lit(0)))
        block, own = first["h"]["block"], first["h"]
        half = F.aggregate(F.slice("s", F.get(r, F.lit(0)) + 1, F.get(r, F.lit(1)) - F.get(r, F.lit(0)) + 1), F.lit(0).cast("long"), lambda a, x: a + x["half"])
        whole = F.size(cuts) == 0
        trail = F.when(whole, block["breadcrumb"]).otherwise(F.concat(block["breadcrumb"], F.transform(cuts, lambda k: F.get("s", k)["h"]["title"])))
        values = (F.when(whole, block["title"]).otherwise(own["title"]), F.when(whole, block["heading_level"]).otherwise(own["level"]), first["first_line"], last["last_line"], trail, first["first_line"], last["last_line"], block["shell"], half)
        return F.struct(*(v.cast(kind).alias(n) for v, (n, kind) in zip(values, (x.split(" ", 1) for x in BLOCK.split(", ")), strict=True)))

    return listed.select(doc, F.posexplode_outer(F.transform("pieces", built)).alias("block_no", "b")).where("block_no IS NOT NULL").select(doc, "block_no", "b.*")
