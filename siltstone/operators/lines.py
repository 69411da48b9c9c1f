"""Documents to classified lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import BOILERPLATE, NOISE, TAIL, heading, is_blank, is_image, is_table, ordered_join, starts_like, utrim, without_formulas
from ..staging import stage

FLAGS = ("is_noise", "is_table", "is_empty", "is_image", "is_tail_section")


#: Rows that a task sorts and holds at most, about, where windows follow each other, and the least that a task of its own is worth.
ROWS_A_TASK, LEAST_ROWS = 200_000, 20_000


def dealt(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """Rows (n of them in all, about) dealt by their keys to as many tasks as keep a task's rows bounded, however many there are.

    The number is named, so that Spark doesn't put tasks together by the bytes that it shuffles: windows in a row sort and hold
    many times as much."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(1, min(usual, -(-n // LEAST_ROWS)), -(-n // ROWS_A_TASK)), *by)


def explode_lines(docs: DataFrame, doc: str = "source_file", text: str = "text") -> DataFrame:
    """doc, line_no (from 1), raw."""
    lines = docs.select(doc, F.posexplode_outer(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("p", "raw")).where("p IS NOT NULL")
    return lines.select(doc, (F.col("p") + 1).alias("line_no"), "raw")


def pieces_of(docs: DataFrame, doc: str = "source_file", text: str = "text") -> DataFrame:
    """doc, piece, text: documents as pieces in order, which are lines, and of lines with tables their rows.

    However a document is cut, a piece ends behind a line end or before a <, so that no tag and no line end stands in two."""
    return docs.select(doc, F.posexplode_outer(F.split(text, r"(?<=\n)|(?<=\r)(?!\n)|(?i)(?=<tr\b)")).alias("piece", "text")).where("piece IS NOT NULL")


def of_pieces(pieces: DataFrame, doc: str = "source_file") -> DataFrame:
    """doc, line_no (from 1), raw of documents that come as pieces (doc, piece, text; see pieces_of), so that no row has to hold a whole one.

    Of a line that begins with a table only the beginning is kept, as nothing else of it is looked at."""
    order = Window.partitionBy(doc).orderBy("piece")
    parts = pieces.select(doc, "piece", F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n").alias("__parts"))
    before = F.coalesce(F.sum(F.size("__parts") - 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(doc, "piece", "__parts", before.alias("__before"), F.lead(F.lit(True)).over(order).isNull().alias("__end"))
    own = parts.select(doc, "piece", "__before", "__end", (F.size("__parts") - 1).alias("__last"), F.posexplode_outer("__parts").alias("__at", "raw"))
    # what a piece has behind its last line end is the beginning of the next piece's first line
    own = own.where((F.col("raw") != "") | (F.col("__at") < F.col("__last")) | F.col("__end"))
    own = own.select(doc, (F.col("__before") + F.col("__at") + 1).cast("int").alias("line_no"), "piece", "raw")
    line = Window.partitionBy(doc, "line_no").orderBy("piece")
    shown = F.when(~is_blank(F.col("raw")), is_table(F.col("raw")))
    own = own.withColumn("__shown", shown).withColumn("__table", F.first("__shown", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("__after", F.count("__shown").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    own = own.where(~F.coalesce("__table", F.lit(False)) | (F.col("__after") == 0))
    return own.groupBy(doc, "line_no").agg(ordered_join("piece", "raw", "").alias("raw"))


def parse(lines: DataFrame, doc: str = "source_file", settings: Settings = DEFAULT, latex: bool = True) -> DataFrame:
    """Adds cleaned, heading_level, heading_title and the flags.

    Noise, tables, empty and image lines have no cleaned text. From the first tail heading on all lines of a document are
    noise (a running maximum), and so are images in runs of images and empty lines with enough images. One shuffle by
    document serves both windows."""
    line = F.col("__line")
    out = lines.withColumn("__line", utrim(F.col("raw"))).withColumn("is_empty", line == "").withColumn("is_table", is_table(F.col("raw")))
    plain = ~F.col("is_empty")
    out = out.withColumn("__noise", plain & starts_like(line, NOISE, True))
    body = plain & ~F.col("__noise") & ~F.col("is_table")
    out = out.withColumn("is_image", body & is_image(F.col("raw"))).withColumn("__noise", F.col("__noise") | (body & starts_like(line, BOILERPLATE, True)))
    shown = ~F.col("__noise") & ~F.col("is_table") & plain & ~F.col("is_image")
    out = out.withColumn("cleaned", F.when(shown, utrim(without_formulas(F.when(shown, F.col("raw")))) if latex else line).otherwise(""))
    out = out.withColumn("__h", heading(F.col("cleaned"), settings)).withColumn("heading_level", F.col("__h.level")).withColumn("heading_title", F.col("__h.title"))
    out = sticky(out, starts_like(line, TAIL), "is_tail_section", doc).withColumn("__noise", F.col("__noise") | F.col("is_tail_section"))
    images = F.col("is_image") & ~F.col("__noise")
    out = runs(out, images | F.col("is_empty"), images, "__images", doc)
    out = out.withColumn("is_noise", F.col("__noise") | (images & (F.coalesce("__images", F.lit(0)) >= settings.image_run_min)))
    return out.select(*lines.columns, "cleaned", "heading_level", "heading_title", *FLAGS)


def sticky(lines: DataFrame, flag: Column, to: str, doc: str = "source_file") -> DataFrame:
    """Adds whether the flag is set on this line or on one before it in the document."""
    upto = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn(to, F.max(flag).over(upto))


def runs(lines: DataFrame, member: Column, counted: Column, to: str, doc: str = "source_file") -> DataFrame:
    """Adds, to members of a run of lines that are all members, how many counted lines the run has (null to others). Gaps and islands: a run's number is the count of lines before it that aren't members."""
    upto = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = lines.withColumn("__in", member).withColumn("__counted", member & counted).withColumn("__run", F.sum(F.when(F.col("__in"), 0).otherwise(1)).over(upto))
    n = F.count_if("__counted").over(Window.partitionBy(doc, "__run"))
    return out.withColumn(to, F.when(F.col("__in"), n)).drop("__in", "__counted", "__run")


def offsets_to_lines(docs: DataFrame, offsets: DataFrame, doc: str = "source_file", text: str = "text") -> DataFrame:
    """Adds line_no to character offsets (doc, offset): the last line that starts at the offset or before it, as an as-of join by a window over both sides."""
    lines = explode_lines(docs, doc, text)
    before = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.select(doc, F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0)).alias("offset"), "line_no")
    both = starts.withColumn("__side", F.lit(0)).unionByName(offsets.select(doc, F.col("offset").cast("long").alias("offset"), F.lit(None).cast("int").alias("line_no"), F.lit(1).alias("__side")))
    upto = Window.partitionBy(doc).orderBy("offset", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("line_no", F.last("line_no", ignorenulls=True).over(upto)).where("__side = 1").select(doc, "offset", "line_no")


def latest_before(left: DataFrame, right: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """As-of join backward: adds to each left row the value of the latest right row of its keys that isn't after it (null if none). Both sides go through one window; no pairs are made."""
    both = left.withColumn("__side", F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType)).unionByName(right.select(*by, *order, value).withColumn("__side", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy(*by).orderBy(*order, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(upto)).where("__side = 1").drop("__side")


def positions(rows: DataFrame, order: str, to: str) -> DataFrame:
    """Adds each row's place, from 0, in an order over the whole table.

    Without one task for all: the rows are sorted into ranges and written with the number of their range, then the counts of
    the ranges are summed up and the place within a range is added."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stage(rows.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("__range", F.spark_partition_id()), "ranges")
    dealt = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__range").orderBy(order)))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return dealt.join(F.broadcast(before), "__range").withColumn(to, F.col("__before") + F.col("__at") - 1).drop("__range", "__at", "__before")
