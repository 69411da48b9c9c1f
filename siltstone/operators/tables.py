"""HTML tables to records: one grid function in Python, all else in columns."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WHITE, utrim
from ..staging import small

# --- fixed values: what a table, a row, a cell and a span look like; limits ---
TABLE = r"(?is)<table\b.*?>.*?</table>"
ROW = r"(?isU)<tr\b.*?>.*?</tr>"
CELL = r"(?is)<t[dh]\b([^>]*)>(.*?)</t[dh]>"
SPAN = r"(?i)\b(rowspan|colspan)\s*=\s*['\"]?(\d+)"
HEADER_SCAN, NAME_LOOKBACK, LEFT_ROWS = 12, 50, (2, 5)
SUB_ITEMS = "子项"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"
# --- end of fixed values ---

CELLS = T.StructType([T.StructField("cells", T.ArrayType(T.StringType())), T.StructField("high", T.BooleanType())])

#: Rows of tables that are Python objects at a time.
ROWS_AT_ONCE = 1000


#: What a cell's text must hold for cleaning to change it: tags, entities, runs of white space or white space that becomes another.
UNCLEAN = re.compile("[<&\xa0\t\r\f\v]|\n\n|  ").search


def _text(fragment: str) -> str:
    if not UNCLEAN(fragment):
        return fragment.strip()
    fragment = html.unescape(re.sub("<[^>]+>", "", re.sub("<br(?: ?/)?>", "\n", fragment))).replace("\xa0", " ")
    for run, one in (("[\t\r\f\v]+", " "), ("\n+", "\n"), (" +", " ")):
        fragment = re.sub(run, one, fragment)
    return fragment.strip()


def _row(row: str, below: dict[int, tuple[str, int]]) -> tuple[list[str], bool] | None:
    """A row's cells with spans filled in, without empty cells at its end, and whether one of them spans rows; null for a row without cells. below: column -> text and rows that it still covers, which is brought up to date."""
    found = re.findall(CELL, row)
    if not found:
        return None
    line: list[str] = []

    def covered() -> None:
        while below.get(len(line), ("", 0))[1] > 0:
            text, left = below[len(line)]
            below[len(line)] = text, left - 1
            line.append(text)

    high = False
    for attributes, inner in found:
        covered()
        span = {k.lower(): max(1, int(v)) for k, v in reversed(re.findall(SPAN, attributes))} if attributes else {}
        rows, text = span.get("rowspan", 1), _text(inner)
        high |= rows > 1
        for _ in range(span.get("colspan", 1)):
            if rows > 1:
                below[len(line)] = text, rows - 1
            line.append(text)
    covered()
    while line and not line[-1]:
        line.pop()
    return line, high


@F.arrow_udf(CELLS)
def table_rows(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Cells of a task's rows of tables (number, html), which come in order: what spans rows is carried from row to row and batch to batch, and a table's first row begins anew."""
    below: dict[int, tuple[str, int]] = {}
    for numbers, rows in batches:
        parts = []
        for at in range(0, len(rows), ROWS_AT_ONCE):
            found = []
            for number, row in zip(numbers.slice(at, ROWS_AT_ONCE).to_pylist(), rows.slice(at, ROWS_AT_ONCE).to_pylist(), strict=True):
                if not number:
                    below = {}
                found.append(None if row is None else _row(row, below))
            columns = [pa.array([x and x[0] for x in found], pa.list_(pa.string())), pa.array([x and x[1] for x in found], pa.bool_())]
            parts.append(pa.StructArray.from_arrays(columns, names=["cells", "high"]))
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("cells", pa.list_(pa.string())), ("high", pa.bool_())]))


def grids(tables: DataFrame, keys: list[str]) -> DataFrame:
    """keys, table_name and __g (cells, row_spans): of each table its rows of cells, and which of them have a cell that spans rows.

    Tables become rows before Python sees them, so that it holds a few rows at a time, however long a table is; rows are put
    together again by the table's keys, by which the records are grouped later anyway."""
    others = [] if "table_name" in keys else ["table_name"]
    rows = tables.select(*keys, *others, F.posexplode_outer(F.regexp_extract_all("table_html", F.lit(ROW), F.lit(0))).alias("__row", "__html"))
    # not deterministic, as it looks at the rows before: Spark leaves it where it stands
    rows = rows.select(*keys, *others, "__row", table_rows.asNondeterministic()("__row", "__html").alias("__c"))
    # the name goes along with the first row
    rows = rows.select(*keys, *(F.when(F.coalesce("__row", F.lit(0)) == 0, F.col(c)).alias(c) for c in others), F.when(F.col("__c.cells").isNotNull(), F.struct("__row", "__c.cells", "__c.high")).alias("__own"))
    listed = rows.groupBy(*keys).agg(*(F.max(c).alias(c) for c in others), F.array_sort(F.collect_list("__own")).alias("__r"))
    return listed.select(*keys, *others, F.struct(F.col("__r.cells").alias("cells"), F.col("__r.high").alias("row_spans")).alias("__g"))


#: What one looks for in a document that comes in pieces: where tables and their rows begin and end.
TAGS = re.compile(r"<(?:table\b|/table>|tr\b|/tr>)", re.I).finditer
OUTSIDE, OPENING, INSIDE = range(3)

FOUND = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("table_index", T.IntegerType()), ("row_no", T.IntegerType()), ("cells", T.ArrayType(T.StringType())), ("high", T.BooleanType()), ("line_no", T.IntegerType()), ("table_name", T.StringType()))]))
FOUND_KINDS = (pa.int32(), pa.int32(), pa.list_(pa.string()), pa.bool_(), pa.int32(), pa.string())


class _Reader:
    """Reads a document piece by piece and holds no more of it than a row of a table, a line of text, and the last line that may name a table."""

    def __init__(self) -> None:
        self.table = self.row = OUTSIDE
        self.index = self.rows = self.line_ends = self.lines = 0
        self.partial = ""
        #: The last usable line and its number.
        self.usable = ("", -1)
        self.held: list[str] = []

    def _feed(self, text: str) -> None:
        """Counts the lines of what stands before the next table, tables included."""
        self.line_ends += text.count("\n") + (len(re.findall("\r(?!\n)", text)) if "\r" in text else 0)
        *ended, partial = (text + ".").splitlines()
        partial = partial[:-1]
        if not ended and self.partial == "<":
            return
        if ended:
            ended[0] = self.partial + ended[0]
            for k in range(len(ended) - 1, -1, -1):
                if line := self._own(ended[k]):
                    self.usable = line, self.lines + k
                    break
            self.lines += len(ended)
        else:
            partial = self.partial + partial
        self.partial = "<" if partial.strip(WHITE).startswith("<") else partial

    @staticmethod
    def _own(line: str) -> str:
        line = line.strip(WHITE)
        return "" if line.startswith("<") else line

    def _name(self) -> str:
        if own := self._own(self.partial):
            return own
        last, number = self.usable
        return last if number >= self.lines + bool(self.partial) - NAME_LOOKBACK else ""

    def _opened(self) -> None:
        if self.table == OPENING:
            self.table = INSIDE
        if self.row == OPENING:
            self.row = INSIDE

    def read(self, text: str) -> Iterator[tuple]:
        """(table, number, cells, spans rows, null, null) of each row that ends in this piece, (table, null, null, null, line, name) of each table that does."""
        fed = seen = start = 0
        for tag in TAGS(text):
            a, b = tag.span()
            if OPENING in (self.table, self.row) and text.find(">", seen, a) >= 0:
                self._opened()
            seen, kind = b, tag[0].lower()
            if kind == "<table":
                if self.table == OUTSIDE:
                    self._feed(text[fed:a])
                    fed = a
                    self.table, self.index, self.rows, self.below = OPENING, self.index + 1, 0, {}
                    self.shown = self.line_ends + 1, self._name()
            elif self.table == OUTSIDE:
                continue
            elif kind == "<tr":
                if self.row == OUTSIDE:
                    self.row, start, self.held = OPENING, a, []
            elif kind == "</table>" and self.table == INSIDE:
                yield self.index, None, None, None, *self.shown
                self.table = self.row = OUTSIDE
            elif kind == "</tr>" and self.row == INSIDE:
                self.row = OUTSIDE
                if found := _row("".join([*self.held, text[start:b]]), self.below):
                    yield self.index, self.rows, *found, None, None
                    self.rows += 1
                self._opened()
            else:
                self._opened()
        if OPENING in (self.table, self.row) and text.find(">", seen) >= 0:
            self._opened()
        if self.row != OUTSIDE:
            self.held.append(text[start:])
        self._feed(text[fed:])


@F.arrow_udf(FOUND)
def tables_read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """What a task's pieces (place in the document from 1, text), which come in order, hold of tables."""
    reader = _Reader()
    for places, texts in batches:
        parts = []
        for at in range(0, max(1, len(texts)), ROWS_AT_ONCE):
            found, ends = [], [0]
            for place, text in zip(places.slice(at, ROWS_AT_ONCE).to_pylist(), texts.slice(at, ROWS_AT_ONCE).to_pylist(), strict=True):
                if place == 1:
                    reader = _Reader()
                found += reader.read(text or "")
                ends.append(len(found))
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(FOUND_KINDS)]
            parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=FOUND.elementType.names)))
        yield pa.concat_arrays(parts)


def read_tables(pieces: DataFrame, doc: str = "source_file") -> DataFrame:
    """doc, table_index (from 1), row_no (from 0), cells, high of each row of the tables of documents that come as pieces (doc, piece, text; see lines.pieces_of); and a row with line_no and table_name for each table that ends. The tables are those of `find_tables` and `grids`, but no row holds a whole one."""
    placed = pieces.select(doc, "text", F.row_number().over(Window.partitionBy(doc).orderBy("piece")).alias("__n"))
    found = placed.select(doc, tables_read.asNondeterministic()("__n", "text").alias("__t"))
    return found.select(doc, F.explode_outer("__t").alias("__x")).where("__x IS NOT NULL").select(doc, "__x.*")


def table_heads(found: DataFrame, doc: str = "source_file") -> DataFrame:
    """doc, table_index, line_no, table_name, columns, header_rows, is_transposed, data_row_spans, cells (of a transposed table, which is small) of what `read_tables` found, by the upper rows."""
    upper = F.array_sort(F.collect_list(F.when(F.col("row_no") < HEADER_SCAN, F.struct("row_no", "cells"))))
    out = found.groupBy(doc, "table_index").agg(F.max("line_no").alias("line_no"), F.max("table_name").alias("table_name"), F.max(F.when(F.col("cells").isNotNull(), F.size("cells"))).alias("__width"), F.max(F.when(F.col("high"), F.col("row_no"))).alias("__high"), upper.alias("__upper"))
    out = out.where(F.col("line_no").isNotNull()).withColumn("__upper", F.transform("__upper", lambda x: x["cells"]))
    out = out.withColumn("is_transposed", has_left_header(F.col("__upper"))).withColumn("cells", F.when(F.col("is_transposed"), transpose(F.col("__upper"))).otherwise(F.col("__upper")))
    out = out.withColumn("header_rows", header_rows(F.col("cells")))
    # a row as wide as the widest stands for those that aren't here
    width = F.when(F.col("is_transposed"), F.lit(0)).otherwise(F.coalesce("__width", F.lit(0)))
    out = out.withColumn("__names", plain_names(F.concat("cells", F.array(F.array_repeat(F.lit(""), width))), F.col("header_rows"))).withColumn("columns", numbered(F.col("__names")))
    spans = ~F.col("is_transposed") & F.coalesce(F.col("__high") >= F.col("header_rows"), F.lit(False))
    return out.select(doc, "table_index", "line_no", "table_name", "columns", "header_rows", "is_transposed", spans.alias("data_row_spans"), F.when(F.col("is_transposed"), F.col("cells")).alias("cells"))


def record_rows(found: DataFrame, heads: DataFrame, doc: str = "source_file") -> tuple[DataFrame, list[str]]:
    """The records of `records`, and their keys (doc, table_index, line_no, table_name), of rows and heads of tables. heads: staged. Rows go on with the one before them by a window; only what is one record is put together."""
    keys = [doc, "table_index", "line_no", "table_name"]
    shown = [*keys, "columns", "data_row_spans", "row_no", "cells"]
    plain = found.where("row_no IS NOT NULL").select(doc, "table_index", "row_no", "cells").join(small(heads.where("NOT is_transposed").drop("cells")), [doc, "table_index"]).where("row_no >= header_rows")
    sideways = heads.where("is_transposed").select(*(c for c in shown if c not in ("row_no", "cells")), "header_rows", F.posexplode_outer("cells").alias("row_no", "cells")).where("row_no >= header_rows")
    n = F.size("columns")
    rows = plain.select(*shown).unionByName(sideways.select(*shown)).where((n > 0) & F.exists("cells", lambda x: x != ""))
    filled = F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.greatest(n - F.size("cells"), F.lit(0)))), F.lit(1), n)
    rows = rows.withColumn("row", F.when(F.size("cells") == n, F.col("cells")).otherwise(filled)).drop("cells")
    order = Window.partitionBy(*keys).orderBy("row_no")
    goes_on = (F.get("row", F.lit(0)) == "") & (F.size(F.filter("row", lambda x: x != "")) <= 2)
    rows = rows.withColumn("__new", (F.row_number().over(order) == 1) | ~F.coalesce(goes_on, F.lit(False)))
    rows = rows.withColumn("record_no", F.sum(F.col("__new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    one = rows.groupBy(*keys, "record_no").agg(F.first("columns").alias("columns"), F.first("data_row_spans").alias("data_row_spans"), F.array_sort(F.collect_list(F.struct("row_no", "row"))).alias("__rows"))
    row = F.get(join_continuations(F.transform("__rows", lambda x: x["row"])), F.lit(0))
    one = one.withColumn("__row", F.when(F.size("__rows") == 1, F.get("__rows", F.lit(0))["row"]).otherwise(row))
    return one.select(*keys, "columns", "data_row_spans", F.col("record_no").cast("int").alias("record_no"), F.map_from_arrays("columns", "__row").alias("record")), keys


def _table_name(lines: Column) -> Column:
    """The last usable line of those before a table."""
    usable = F.filter(F.transform(F.slice(F.reverse(lines), 1, NAME_LOOKBACK), utrim), lambda x: (x != "") & ~F.startswith(x, F.lit("<")))
    return F.coalesce(F.get(usable, 0), F.lit(""))


def find_tables(docs: DataFrame, doc: str = "source_file", text: str = "text") -> DataFrame:
    """doc, table_index (from 1), table_html, table_name, start_char: every table of a text. Its name is the last usable line among those before it.

    One walk over a text's tables and what stands between them, which carries the place and the last lines before it; each
    stretch of text is looked at once, and no table carries more than itself."""
    rows = docs.select(doc, F.regexp_extract_all(text, F.lit(TABLE), F.lit(0)).alias("__found"), F.split(text, TABLE, -1).alias("__between")).where(F.size("__found") > 0)
    kind = "array<struct<table_name:string,start_char:int>>"
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("last"), F.array().cast(kind).alias("out"))
    lines = lambda x: F.split(F.regexp_replace(x, r"\r?\n$", ""), LINE_END, -1)

    def step(s: Column, x: Column) -> Column:
        before = F.concat(s["last"], x["between"])
        start = s["at"] + F.length(x["between"])
        after = F.split(F.concat(before, x["found"]), LINE_END, -1)
        kept = F.array_join(F.slice(after, F.greatest(F.size(after) - NAME_LOOKBACK, F.lit(1)), F.lit(NAME_LOOKBACK + 1)), "\n")
        own = F.struct(_table_name(lines(before)).alias("table_name"), start.cast("int").alias("start_char"))
        return F.struct((start + F.length(x["found"])).cast("int").alias("at"), kept.alias("last"), F.concat(s["out"], F.array(own)).alias("out"))

    pairs = F.zip_with(F.slice("__between", F.lit(1), F.size("__found")), "__found", lambda b, f: F.struct(b.alias("between"), f.alias("found")))
    rows = rows.withColumn("__out", F.aggregate(pairs, state, step, lambda s: s["out"]))
    out = rows.select(doc, F.posexplode(F.arrays_zip("__found", "__out")).alias("p", "x"))
    return out.select(doc, (F.col("p") + 1).alias("table_index"), F.col("x.__found").alias("table_html"), "x.__out.table_name", "x.__out.start_char")


def _width(cells: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(cells, F.size)), F.lit(0))


def transpose(cells: Column) -> Column:
    """Rows for columns, short rows filled with empty cells."""
    width = _width(cells)
    columns = F.transform(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda c: F.transform(cells, lambda r: F.coalesce(F.get(r, c), F.lit(""))))
    return F.when(width == 0, F.array().cast("array<array<string>>")).otherwise(columns)


def has_left_header(cells: Column) -> Column:
    """Few rows, many columns, and labels in front: such a table is read sideways."""
    n = F.size(cells)
    labels = F.transform(cells, lambda r: utrim(F.coalesce(F.get(r, 0), F.lit(""))))
    return n.between(*LEFT_ROWS) & (_width(cells) >= 2 * n) & F.forall(labels, lambda x: (x != "") & ~x.rlike(r"(?U)^\d+$")) & F.exists(cells, lambda r: F.coalesce(F.get(r, 0), F.lit("")).rlike(r"[一-鿿/\\%]"))


def header_rows(cells: Column) -> Column:
    """Rows before the first of the upper ones that begins with an integer; one if none does."""
    first = F.array_position(F.transform(F.slice(cells, 1, HEADER_SCAN), lambda r: utrim(F.coalesce(F.get(r, 0), F.lit(""))).rlike(r"(?U)^\d+$")), True)
    return F.when(F.size(cells) == 0, 0).when(first > 0, first - 1).otherwise(1).cast("int")


def plain_names(cells: Column, headers: Column) -> Column:
    """The distinct header cells of a column joined by slashes; col_n where there are none."""
    top = F.transform(F.slice(cells, F.lit(1), headers), lambda r: F.transform(r, utrim))
    columns = F.transform(F.sequence(F.lit(0), F.greatest(_width(cells) - 1, F.lit(0))), lambda c: F.transform(top, lambda r: F.coalesce(F.get(r, c), F.lit(""))))
    run = lambda parts: F.aggregate(parts, F.array().cast("array<string>"), lambda s, x: F.when((x == "") | (F.coalesce(F.element_at(F.concat(F.array(F.lit("")), s), -1), F.lit("")) == x), s).otherwise(F.concat(s, F.array(x))))
    names = F.transform(columns, lambda c, i: F.coalesce(F.nullif(utrim(F.array_join(run(c), "/")), F.lit("")), F.concat(F.lit("col_"), (i + 1).cast("string"))))
    return F.when(_width(cells) == 0, F.array().cast("array<string>")).otherwise(names)


def numbered(names: Column) -> Column:
    """Names with a number behind those that stood before. names: a column that is there already, as each name looks at the earlier ones."""
    earlier = lambda i, x: F.size(F.filter(F.slice(names, F.lit(1), i), lambda y: y == x))
    repeated = F.transform(names, lambda x, i: F.when(earlier(i, x) > 0, F.concat(x, F.lit("__"), (earlier(i, x) + 1).cast("string"))).otherwise(x))
    return F.when(F.size(F.array_distinct(names)) == F.size(names), names).otherwise(repeated)


def parse_tables(tables: DataFrame, keys: list[str]) -> DataFrame:
    """keys, table_name, columns, header_rows, is_transposed, row_count, rows (array of arrays, blank rows left out), data_row_spans."""
    out = grids(tables, keys).withColumn("is_transposed", has_left_header(F.col("__g.cells")))
    out = out.withColumn("cells", F.when(F.col("is_transposed"), transpose(F.col("__g.cells"))).otherwise(F.col("__g.cells")))
    out = out.withColumn("header_rows", header_rows(F.col("cells"))).withColumn("__names", plain_names(F.col("cells"), F.col("header_rows"))).withColumn("columns", numbered(F.col("__names")))
    n = F.size("columns")
    body = F.slice("cells", F.col("header_rows") + 1, F.size("cells"))
    # cells come without white space around them, and rows without empty cells at their end
    filled = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(n - F.size(r), F.lit(0)))), F.lit(1), n)
    rows = F.transform(F.filter(body, lambda r: F.exists(r, lambda x: x != "")), lambda r: F.when(F.size(r) == n, r).otherwise(filled(r)))
    spans = F.exists(F.slice("__g.row_spans", F.col("header_rows") + 1, F.size("__g.row_spans")), lambda x: x)
    return out.select(*keys, "table_name", "columns", "header_rows", "is_transposed", F.size("cells").alias("row_count"), F.when(n == 0, F.array().cast("array<array<string>>")).otherwise(rows).alias("rows"), (~F.col("is_transposed") & spans).alias("data_row_spans"))


def join_continuations(rows: Column) -> Column:
    """A row with an empty first cell and at most two values goes on with the row before it. Whether it does is its own affair, so that rows are put together stretch by stretch."""
    filled = lambda r: F.size(F.filter(r, lambda x: x != ""))
    goes_on = lambda r: (F.get(r, 0) == "") & (filled(r) <= 2)
    merged = lambda a, b: F.zip_with(a, b, lambda x, y: F.when(y == "", x).when(x == "", y).otherwise(F.concat(x, F.lit("\n"), y)))
    places = F.filter(F.transform(rows, lambda r, i: F.when((i == 0) | ~F.coalesce(goes_on(r), F.lit(False)), i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(places, F.lit(2), F.greatest(F.size(places) - 1, F.lit(0))), F.array(F.size(rows)))
    stretch = lambda a, b: F.aggregate(F.slice(rows, a + 2, F.greatest(b - a - 1, F.lit(0))), F.get(rows, a), merged)
    return F.when(F.size(rows) == 0, rows).otherwise(F.zip_with(places, ends, stretch))


def records(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, columns, record_no and record (a map from column to value) of every row."""
    rows = parsed.select(*keys, "columns", "data_row_spans", F.posexplode(join_continuations(F.col("rows"))).alias("record_no", "row"))
    return rows.select(*keys, "columns", "data_row_spans", "record_no", F.map_from_arrays("columns", "row").alias("record"))


def group_spans(found: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbouring records with the same first column become one: columns that don't vary keep their value, one that varies has its values joined by bars, several become sub-items.

    keys, columns, record_no, record, sub_items (array of maps). Neighbours are found by gaps and islands, so that a table's records move once, by table."""
    order = Window.partitionBy(*keys).orderBy("record_no")
    first = F.col("record")[F.col("columns")[0]]
    new = F.lag(first).over(order).isNull() | (F.lag(first).over(order) != first) | ~F.col("data_row_spans")
    marked = found.withColumn("__new", new.cast("int")).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("record_no", F.map_values("record").alias("values")))), lambda x: x["values"])
    grouped = marked.groupBy(*keys, "__island").agg(F.first("columns").alias("columns"), F.min("record_no").alias("record_no"), rows.alias("rows"))
    of_column = transpose(F.col("rows"))
    grouped = grouped.withColumn("__columns", of_column).withColumn("__varies", F.transform("__columns", lambda c: F.size(F.array_distinct(c)) > 1)).withColumn("__n", F.size(F.filter("__varies", lambda x: x)))
    values = F.transform("columns", lambda c, i: F.when(~F.get("__varies", i), F.get(F.get("__columns", i), F.lit(0))).when(F.col("__n") == 1, F.array_join(F.get("__columns", i), " | ")))
    record = F.map_filter(F.map_from_arrays("columns", values), lambda _, v: v.isNotNull())
    varying = F.filter("columns", lambda c, i: F.get("__varies", i))
    items = F.when(F.col("__n") > 1, F.transform("rows", lambda r: F.map_from_arrays(varying, F.filter(r, lambda _, i: F.get("__varies", i)))))
    return grouped.select(*keys, "columns", "record_no", record.alias("record"), F.coalesce(items, F.array().cast("array<map<string,string>>")).alias("sub_items"))
