"""JSON array files, written by many tasks and read by many: a file is cut by bytes, and records that a cut runs through are put together again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import discard, small, stage

#: What the scanner stops at; an escape takes the next character with it.
MARKS = re.compile(r'\\.|["{}\[\]]', re.DOTALL)


def save_array(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes rows as JSON arrays, one file a task: record by record, nothing is held. A task without rows writes an empty array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lead = "["
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"value": [(lead if k == 0 else ",") + v for k, v in enumerate(batch["value"])]})
                lead = ","
        yield pd.DataFrame({"value": ["]" if lead == "," else "[]"]})

    df.select(F.to_json(F.struct("*")).alias("value")).mapInPandas(run, "value string").write.mode(mode).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, start, seq, value, size: what stands between closing braces, by the stretch of bytes that a task reads; the file's bytes."""
    scan = spark.read.option("lineSep", "}").text(path)
    return scan.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seq"), "value", F.col("_metadata.file_size").alias("size"))


def measure(texts: Iterator[str]) -> tuple[int, int, int]:
    """Of a stretch: whether its quotes turn being within a string around, and by how much brackets change the depth if it starts outside or inside a string. A closing brace ends each piece but maybe the last of a file, which needs none."""
    odd, depth = 0, [0, 0]
    for text in texts:
        for m in MARKS.finditer(text + "}"):
            mark = m[0]
            if mark == '"':
                odd ^= 1
            elif len(mark) == 1:
                depth[odd] += 1 if mark in "{[" else -1
    return odd, depth[0], depth[1]


class Scanner:
    """Records of an array, from any place with a known state: whether it is within a string, and how deep in brackets."""

    def __init__(self, quoted: bool, depth: int):
        self.quoted, self.depth = quoted, depth
        self.open: list[str] | None = [] if depth > 1 else None

    def feed(self, text: str, brace: bool = True) -> Iterator[str]:
        """What ends in this piece, a brace at its end or not: whole records, or the rest of one that began before the scanner."""
        text += "}" if brace else ""
        begin = 0
        for m in MARKS.finditer(text):
            mark = m[0]
            if mark == '"':
                self.quoted = not self.quoted
            elif len(mark) > 1 or self.quoted:
                continue
            elif mark in "{[":
                self.depth += 1
                if self.depth == 2:
                    self.open, begin = [], m.start()
            else:
                self.depth -= 1
                if self.depth == 1 and self.open is not None:
                    yield "".join([*self.open, text[begin : m.end()]])
                    self.open = None
        if self.open is not None:
            self.open.append(text[begin:])


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, start, seq, value: the objects of the arrays in the files of a path, each as its text; in a file they are in the order of start and seq.

    Two passes over the bytes, in stretches as Spark cuts them (spark.sql.files.maxPartitionBytes): the first gives of each
    stretch how its quotes and brackets change the state, a row a stretch; sums over a file's stretches give the state in which
    each one starts; the second reads the records. Those that a cut runs through leave a part in each of their stretches, and
    the parts are put together by the stretch that they began in. What isn't an object within the array is left out; records
    that are no JSON, or that the file's end cuts off, are there as they stand (see read)."""

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int, int], list[int]] = {}
        for batch in batches:
            for key, own in batch.groupby(["file", "start", "size"], sort=False):
                odd, out, inside = measure(own["value"])
                now = held.setdefault(key, [0, 0, 0, 0])
                # a stretch that starts inside a string has what this batch does the other way round
                before = now[0]
                now[1] += (out, inside)[before]
                now[2] += (inside, out)[before]
                now[0] ^= odd
                now[3] += int(own["bytes"].sum())
        yield pd.DataFrame([(*k, *v) for k, v in held.items()], columns=["file", "start", "size", "odd", "outside", "inside", "bytes"])

    pieces = _pieces(spark, path)
    measured = pieces.select("file", "start", "size", "value", (F.octet_length("value") + 1).alias("bytes"))
    found = measured.mapInPandas(sizes, "file string, start bigint, size bigint, odd int, outside bigint, inside bigint, bytes bigint")
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    states = found.withColumn("quoted", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2 == 1)
    states = states.withColumn("depth", F.coalesce(F.sum(F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("outside"))).over(earlier), F.lit(0)))
    # a file that doesn't end with a brace has one byte less than its pieces with theirs
    states = states.withColumn("bare", (F.sum("bytes").over(Window.partitionBy("file")) > F.col("size")) & F.lead("start").over(Window.partitionBy("file").orderBy("start")).isNull())
    states = stage(states.select("file", "start", "quoted", "depth", "bare"), "states")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner, of, head, bare = None, None, False, False
        held: tuple[int, str] | None = None  # the piece that may be its stretch's last

        def taken(last: bool) -> Iterator[tuple]:
            nonlocal head
            if held is None:
                return
            for text in scanner.feed(held[1], not (last and bare)):
                yield (*of, held[0], text, head, False)
                head = False
            # a part that goes on in the next stretch
            if last and scanner.open:
                yield (*of, held[0], "".join(scanner.open), head, True)

        names = ["file", "start", "seq", "value", "goes_on", "open"]
        for batch in batches:
            out: list[tuple] = []
            for file, start, seq, value, quoted, depth, ends in batch.itertuples(index=False):
                out += taken(last=(file, start) != of)
                if (file, start) != of:
                    of, scanner, head, bare = (file, start), Scanner(quoted, depth), depth > 1, ends
                held = (seq, value)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(list(taken(last=True)), columns=names)

    placed = pieces.join(small(states), ["file", "start"]).sortWithinPartitions("file", "start", "seq")
    parts = stage(placed.select("file", "start", "seq", "value", "quoted", "depth", "bare").mapInPandas(read, "file string, start bigint, seq bigint, value string, goes_on boolean, open boolean"), "parts")
    discard(states)
    whole = parts.where("not goes_on and not open").select("file", "start", "seq", "value")
    # a record's parts: one that opens, those that go on and stay open, one that ends
    order = Window.partitionBy("file").orderBy("start", "seq")
    cut = parts.where("goes_on or open").withColumn("record", F.sum((~F.col("goes_on")).cast("int")).over(order))
    mended = cut.groupBy("file", "record").agg(F.min("start").alias("start"), F.min("seq").alias("seq"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq", "value"))), lambda x: x["value"]), "").alias("value"))
    return whole.unionByName(mended.select("file", "start", "seq", "value")).where(F.startswith("value", F.lit("{")))


def read(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the records by a schema, and the broken ones (file, start, seq, value)."""
    rows = records(spark, path).withColumn("row", F.from_json("value", F.lit(f"{schema}, __broken string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"}))
    good, bad = F.col("row.__broken").isNull() & F.col("row").isNotNull(), F.col("row.__broken").isNotNull() | F.col("row").isNull()
    return rows.where(good).select("row.*").drop("__broken"), rows.where(bad).select("file", "start", "seq", "value")
