"""Documents that come as pieces: the same lines, tables, records and chunks as from whole texts, and no row that holds a whole document."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from siltstone.config import Settings
from siltstone.operators import chunks, folds, lines, tables
from siltstone.plans import ingest
from siltstone.plans import whole_queries as w

KEYS = ["source_file", "table_index"]


def _text(rng: random.Random) -> str:
    cell = lambda: rng.choice(["", "", "1", "22", "x", "y z", "品", "a<br>b", "<b>c</b>"])
    span = lambda: rng.choice(["", "", "", ' rowspan="2"', ' colspan="2"'])
    row = lambda: rng.choice(["<tr>", "<TR a='>'>", "<tr\n>"]) + "".join(f"<td{span()}>{cell()}</td>" for _ in range(rng.randrange(7))) + rng.choice(["</tr>", "</tr>", "</TR>", ""]) + rng.choice(["", "\n", " "])
    table = lambda: rng.choice(["<table>", "<TABLE x>", " <table\n>", "<table"]) + "".join(row() for _ in range(rng.randrange(16))) + rng.choice(["</table>", "</table>", "</Table>", ""])
    other = lambda: rng.choice(["# one", "## two", "plain 12 words", "", "", "a <br> b <tr> c", "www.a.com", " \t", "参考", "<tr>", "x<table", "<tables>"])
    return rng.choice(["\n", "\n", ""]).join(rng.choice([table, other, other, other])() + rng.choice(["\n", ""]) for _ in range(rng.randrange(1, 16)))


def _docs(spark, n: int = 120):
    rng = random.Random(11)
    rows = [(f"d{k}", _text(rng)) for k in range(n)] + [("empty", ""), ("long", "Name\n" + "\n" * 45 + "<table><tr><td>a</td></tr><tr><td>1</td></tr></table>"), ("far", "Name\n" + "\n" * 60 + "<table><tr><td>a</td></tr><tr><td>1</td></tr></table>")]
    return spark.createDataFrame(rows, "source_file string, text string")


def _rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_lines_of_pieces(spark):
    docs = _docs(spark)
    pieces = lines.pieces_of(docs)
    joined = pieces.groupBy("source_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "").alias("text"))
    assert _rows(joined, "source_file") == _rows(docs, "source_file")
    whole, own = lines.explode_lines(docs), lines.of_pieces(pieces)
    shown = lambda df: _rows(lines.parse(df).select("source_file", "line_no", F.when(~F.col("is_table"), F.col("raw")), "cleaned", "heading_level", "is_table", "is_empty"), "source_file", "line_no")
    assert shown(own) == shown(whole)
    # of a line that is a table the rows don't follow each other in one row
    table = spark.createDataFrame([("t", "<table>" + "<tr><td>x</td></tr>" * 500 + "</table>\nend")], "source_file string, text string")
    assert [r.n for r in lines.of_pieces(lines.pieces_of(table)).orderBy("line_no").select(F.length("raw").alias("n")).collect()] == [7, 3]


def test_tables_of_pieces(spark):
    docs = _docs(spark)
    found = tables.find_tables(docs)
    parsed = tables.parse_tables(found, KEYS)
    rows = tables.read_tables(lines.pieces_of(docs)).localCheckpoint()
    heads = tables.table_heads(rows).localCheckpoint()
    assert _rows(heads.select(*KEYS, "table_name", "columns", "header_rows", "is_transposed", "data_row_spans"), *KEYS) == _rows(parsed.select(*KEYS, "table_name", "columns", "header_rows", "is_transposed", "data_row_spans"), *KEYS)
    at = lines.offsets_to_lines(docs, found.select("source_file", F.col("start_char").alias("offset"))).withColumnRenamed("offset", "start_char")
    assert _rows(heads.select(*KEYS, "line_no"), *KEYS) == _rows(found.join(at, ["source_file", "start_char"]).select(*KEYS, "line_no"), *KEYS)
    records, keys = tables.record_rows(rows, heads)
    shown = lambda df: _rows(df.select(*KEYS, "record_no", "columns", F.map_values("record").alias("v")), *KEYS, "record_no")
    got = shown(records)
    assert got == shown(tables.records(parsed, KEYS)) and len(got) > 100


def test_chunks_of_pieces(spark):
    docs = _docs(spark, 60)
    settings = Settings(block_max=60, block_min=20, chunk_min=8, chunk_max=16)
    names = ["source_file", "chunk_no", "is_table", "block_no", "chunk_idx", "block_title", "title", "content", "token_estimate", "breadcrumb", "start_line"]
    shown = lambda x: _rows(ingest.ingested(x, settings).select(*names), "source_file", "chunk_no")
    got = shown(lines.pieces_of(docs))
    assert got == shown(docs) and len(got) > 100


def test_sizes_row_by_row(spark):
    rng = random.Random(3)
    settings = Settings(chunk_min=10, chunk_max=20)
    texts = [(g, k, "\n\n".join(" ".join(["w"] * rng.randrange(1, 15)) for _ in range(rng.randrange(1, 5)))) for g in range(30) for k in range(0, 2 * rng.randrange(1, 9), 2)]
    raw = spark.createDataFrame(texts, "g int, chunk_no int, content string")
    raw = raw.select("g", "chunk_no", chunks._chunk(F.concat(F.lit("t"), "chunk_no"), F.col("content"), F.col("chunk_no"), F.col("chunk_no"), F.lit(99), chunks.token_half(F.col("content"))).alias("chunk"))
    whole = chunks.sized(chunks.in_order(raw, ["g"]), settings).select("g", F.posexplode("chunks").alias("p", "chunk"))
    assert [tuple(r) for r in chunks.sized_rows(raw, ["g"], settings).orderBy("g", "chunk_no").select("g", "chunk").collect()] == [tuple(r) for r in whole.orderBy("g", "p").select("g", "chunk").collect()]
    sizes = [(g, k, rng.randrange(0, 9)) for g in range(40) for k in range(1, rng.randrange(2, 30))]
    rows = spark.createDataFrame(sizes, "g int, k int, size int").repartition(3, "g").sortWithinPartitions("g", "k")
    got = rows.select("g", "k", folds.run_rows(F.col("k"), F.col("size"), 4).alias("a"), folds.bin_rows(F.col("k"), F.col("size"), 10).alias("b"), folds.group_rows(F.col("k"), F.col("size"), 10).alias("c")).collect()
    for g in {g for g, _, _ in sizes}:
        own = [s for x, _, s in sizes if x == g]
        mine = sorted(tuple(r)[1:] for r in got if r.g == g)
        runs = [n for n, (a, b) in enumerate(folds.filled_runs(own, 4)) for _ in range(a, b + 1)]
        assert [x[1:] for x in mine] == list(zip(runs, folds.bin_numbers(own, 10), folds.group_numbers(own, 10), strict=True))


def test_no_row_holds_a_document(spark):
    docs = w._brand_docs(spark, "/root/testdata/sf0.001")
    text, n = docs.agg(F.max(F.length("text")), F.count("*")).first()
    assert text < 2000 and n > docs.select("source_file").distinct().count() * 4
