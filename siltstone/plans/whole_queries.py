"""Named queries that go through whole families of operators: headings, HTML tables, ingest, search to context, the online plan.

Their documents are made of the driver's tables in Spark; the SQL knows what must come out from the tables themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import text as tx
from ..operators import fusion, lines, outline, prompts, tables
from ..sources import files
from ..staging import stage
from . import ingest, online, retrieve
from . import queries as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

read, half = q.read, q.half


def query(sql: str):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return add


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# ---------------------------------------------------------------- lines and headings

#: A line of each kind for a part, and its level and title.
HEADINGS = [
    ("'一、' || p_name", 1, True),
    ("'（二）' || p_name", 2, True),
    ("'3.' || p_size || ' ' || p_name", 2, True),
    ("'6.3.2.' || p_size", 4, True),
    ("'0.25% ' || p_name", 0, False),
    ("'2016.6 ' || p_name", 0, False),
    ("p_name", 0, False),
]
KIND = "CASE p_partkey % 9 " + " ".join(f"WHEN {k} THEN {raw}" for k, (raw, _, _) in enumerate(HEADINGS)) + " WHEN 7 THEN '### 3.1 ' || p_name ELSE '# 6.3.1 ' || p_name END"


@query(f"""SELECT p_partkey, CAST(CASE p_partkey % 9 {' '.join(f'WHEN {k} THEN {level}' for k, (_, level, _) in enumerate(HEADINGS))} ELSE 3 END AS INTEGER) AS level,
CASE p_partkey % 9 {' '.join(f"WHEN {k} THEN {raw if own else chr(39) * 2}" for k, (raw, _, own) in enumerate(HEADINGS))} WHEN 7 THEN '3.1 ' || p_name ELSE '6.3.1 ' || p_name END AS title FROM part""")
def heading_kinds(spark, sf_dir):
    """CJK ordinals, ordinals in brackets, dotted numbers, numbers that are none, and hashes with deeper numbers."""
    return read(spark, sf_dir, "part").select("p_partkey", tx.heading(F.expr(KIND)).alias("h")).select("p_partkey", "h.level", "h.title")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size || '.5 m l of ' || p_name || '~ ' || p_size ELSE p_name || ' $' || p_size END AS content FROM part")
def latex_lines(spark, sf_dir):
    raw = F.expr(r"CASE WHEN p_size % 2 = 0 THEN concat('$', p_size, ' . 5 \\mathsf { m l }$ of ', p_name, '$\\sim  ', p_size, '$') ELSE concat(p_name, ' $', p_size) END")
    return read(spark, sf_dir, "part").select("p_partkey", tx.latex_clean(raw).alias("content"))


@query("""WITH n AS (SELECT n_nationkey AS doc, n_nationkey % 5 AS n FROM nation), lines AS (SELECT doc, n, unnest(range(1, 2 * n + 2)) AS line_no FROM n)
SELECT CAST(doc AS BIGINT) AS doc, line_no, line_no % 2 = 1 AND line_no < 2 * n + 1 AND n >= 3 AS is_noise, line_no % 2 = 1 AND line_no < 2 * n + 1 AS is_image FROM lines""")
def image_runs(spark, sf_dir):
    """Images with empty lines between them, then text: three make a run that goes."""
    n = (F.col("n_nationkey") % 5).cast("int")
    docs = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc"), F.concat(F.repeat(F.lit("![a](b)\n\n"), n), F.lit("text")).alias("text"))
    return lines.parse(lines.explode_lines(docs, doc="doc"), doc="doc").select("doc", *_long("line_no"), "is_noise", "is_image")


@query("""WITH n AS (SELECT CAST(n_nationkey AS VARCHAR) AS doc, n_nationkey % 3 AS k, n_name AS x FROM nation)
SELECT doc, 0 AS block_no, 'intro ' || x AS title, CAST(0 AS INTEGER) AS heading_level, 1 AS start_line, 1 AS end_line, 'intro ' || x AS heading_path FROM n WHERE k = 0
UNION ALL SELECT doc, 1, 'A ' || x, 1, 2, 3, 'intro ' || x || ' > A ' || x FROM n WHERE k = 0
UNION ALL SELECT doc, 0, doc, 1, 1, 2, doc FROM n WHERE k = 1
UNION ALL SELECT doc, 1, 'A ' || x, 1, 1, 1, 'A ' || x FROM n WHERE k = 2
UNION ALL SELECT doc, 2, 'B ' || x, 2, 2, 3, 'A ' || x || ' > B ' || x FROM n WHERE k = 2
UNION ALL SELECT doc, 3, 'C ' || x, 1, 4, 5, 'C ' || x FROM n WHERE k = 2""".replace("0 AS block_no", "CAST(0 AS BIGINT) AS block_no").replace("1 AS start_line, 1 AS end_line", "CAST(1 AS BIGINT) AS start_line, CAST(1 AS BIGINT) AS end_line"))
def preamble_blocks(spark, sf_dir):
    """A document with text before its first heading, one without headings, one with two levels."""
    text = F.expr("CASE n_nationkey % 3 WHEN 0 THEN concat('intro ', n_name, '\\n# A ', n_name, '\\nbody') WHEN 1 THEN concat('only ', n_name, '\\nmore') ELSE concat('# A ', n_name, '\\n## B ', n_name, '\\nbody\\n# C ', n_name, '\\nend') END")
    docs = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("doc"), text.alias("text"))
    found = outline.blocks(lines.parse(lines.explode_lines(docs, doc="doc"), doc="doc"), doc="doc")
    return found.select("doc", *_long("block_no"), "title", "heading_level", *_long("start_line", "end_line"), F.array_join("breadcrumb", " > ").alias("heading_path"))


# ---------------------------------------------------------------- HTML tables: an order's items

#: The items of an order in pairs, the last one with a row that goes on with it.
PAIRS = """items AS (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS part, CAST(l_suppkey AS VARCHAR) AS supplier, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
pairs AS (SELECT l_orderkey, (i + 1) // 2 AS no, i, n, CASE WHEN i = n THEN part || chr(10) || 'end' ELSE part END AS part, supplier, flag FROM items),
groups AS (SELECT l_orderkey, no, min(i) - 1 AS record_no, min(part) AS part, count(DISTINCT part) > 1 AS vp, count(DISTINCT supplier) > 1 AS vs, count(DISTINCT flag) > 1 AS vf, min(supplier) AS supplier, min(flag) AS flag, string_agg(part, ' | ' ORDER BY i) AS parts, string_agg(supplier, ' | ' ORDER BY i) AS suppliers, string_agg(flag, ' | ' ORDER BY i) AS flags, min_by(part, i) AS p1, max_by(part, i) AS p2, min_by(supplier, i) AS s1, max_by(supplier, i) AS s2, min_by(flag, i) AS f1, max_by(flag, i) AS f2 FROM pairs GROUP BY l_orderkey, no),
counted AS (SELECT *, CAST(vp AS INTEGER) + CAST(vs AS INTEGER) + CAST(vf AS INTEGER) AS v FROM groups)"""


def _pair_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_file, text: the items of an order as a table with a header of two rows, cells that span two items, and a row that goes on."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", F.row_number().over(order).alias("i"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"))
    no = F.expr("(i + 1) div 2").cast("string")
    lead = F.when((F.col("i") % 2 == 1) & (F.col("i") < F.col("n")), F.concat(F.lit('<td rowspan="2">'), no, F.lit("</td>"))).when(F.col("i") % 2 == 1, F.concat(F.lit("<td>"), no, F.lit("</td>"))).otherwise("")
    row = F.concat(F.lit("<tr>"), lead, *(F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>")) for c in ("l_partkey", "l_suppkey", "l_returnflag")), F.lit("</tr>"))
    body = items.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", row.alias("row")))), lambda x: x["row"]), "\n").alias("rows"))
    head = '<tr><th rowspan="2">No</th><th colspan="2">Item</th><th>State</th></tr><tr><th>Part</th><th>Supplier</th><th>Flag</th></tr>'
    text = F.concat(F.lit("Before\nItems of "), F.col("l_orderkey").cast("string"), F.lit(f"\n\n<table>{head}"), "rows", F.lit("<tr><td></td><td>end</td><td></td><td></td></tr></table>\nafter"))
    return body.select(F.col("l_orderkey").cast("string").alias("source_file"), text.alias("text"))


@query(f"""WITH {PAIRS} SELECT CAST(l_orderkey AS VARCHAR) AS source_file, 'Items of ' || l_orderkey AS table_name, CAST(record_no AS BIGINT) AS record_no, CAST(no AS VARCHAR) AS no,
CASE WHEN NOT vp THEN part WHEN v = 1 THEN parts END AS part, CASE WHEN NOT vs THEN supplier WHEN v = 1 THEN suppliers END AS supplier, CASE WHEN NOT vf THEN flag WHEN v = 1 THEN flags END AS flag,
CASE WHEN v > 1 THEN concat_ws(';', CASE WHEN vp THEN p1 END, CASE WHEN vs THEN s1 END, CASE WHEN vf THEN f1 END) || '|' || concat_ws(';', CASE WHEN vp THEN p2 END, CASE WHEN vs THEN s2 END, CASE WHEN vf THEN f2 END) ELSE '' END AS items FROM counted""")
def table_records(spark, sf_dir):
    """From HTML to grouped records: tables and their names, cells, spans, header rows, column names, rows that go on, groups."""
    keys = ["source_file", "table_index"]
    parsed = tables.parse_tables(tables.find_tables(_pair_tables(spark, sf_dir)), keys)
    # a table's name goes along as a key: a join would parse all tables twice
    named = [*keys, "table_name"]
    out = tables.group_spans(tables.records(parsed, named), named)
    items = F.array_join(F.transform("sub_items", lambda m: F.array_join(F.map_values(m), ";")), "|")
    return out.select("source_file", "table_name", *_long("record_no"), F.col("record")["No"].alias("no"), F.try_element_at("record", F.lit("Item/Part")).alias("part"), F.try_element_at("record", F.lit("Item/Supplier")).alias("supplier"), F.try_element_at("record", F.lit("State/Flag")).alias("flag"), items.alias("items"))


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT CAST(l_orderkey AS VARCHAR) AS source_file, CAST(length('Before' || chr(10) || 'Items of ' || l_orderkey || chr(10) || chr(10)) AS BIGINT) AS start_char, CAST(4 AS BIGINT) AS line_no, 'No,Item/Part,Item/Supplier,State/Flag' AS columns, CAST(2 AS BIGINT) AS header_rows, CAST(n + 3 AS BIGINT) AS row_count, n > 1 AS data_row_spans, false AS is_transposed FROM n""")
def table_shapes(spark, sf_dir):
    """Places, header rows, column names and span tests of the same tables."""
    keys = ["source_file", "table_index"]
    docs = stage(_pair_tables(spark, sf_dir), "docs")
    found = stage(tables.find_tables(docs), "tables")
    at = lines.offsets_to_lines(docs, found.select("source_file", F.col("start_char").alias("offset"))).withColumnRenamed("offset", "start_char")
    parsed = tables.parse_tables(found, [*keys, "start_char"]).join(at, ["source_file", "start_char"])
    return parsed.select("source_file", *_long("start_char", "line_no"), F.array_join("columns", ",").alias("columns"), *_long("header_rows", "row_count"), "data_row_spans", "is_transposed")


@query("""WITH o AS (SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS k, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS source_file, true AS is_transposed, CAST(i - 1 AS BIGINT) AS record_no, k AS first, p AS second FROM o WHERE n >= 3
UNION ALL SELECT CAST(o_custkey AS VARCHAR), false, 0, '数量', p FROM o WHERE n < 3 AND i = 1""")
def table_sideways(spark, sf_dir):
    """Tables whose headers are at the left, read by columns if they are wide enough."""
    cells = lambda c: F.array_join(F.transform("rows", lambda x: F.concat(F.lit("<td>"), x[c], F.lit("</td>"))), "")
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderkey").cast("string").alias("k"), F.floor("o_totalprice").cast("string").alias("p")))).alias("rows"))
    docs = rows.select(F.col("o_custkey").cast("string").alias("source_file"), F.concat(F.lit("<table><tr><td>项目</td>"), cells("k"), F.lit("</tr><tr><td>数量</td>"), cells("p"), F.lit("</tr></table>")).alias("text"))
    keys = ["source_file", "table_index"]
    parsed = tables.parse_tables(tables.find_tables(docs), keys)
    found = tables.records(parsed, keys).join(parsed.select(*keys, "is_transposed"), keys)
    value = lambda i: F.col("record")[F.get("columns", F.lit(i))]
    return found.select("source_file", "is_transposed", *_long("record_no"), value(0).alias("first"), value(1).alias("second"))


# ---------------------------------------------------------------- ingest: a brand's parts as a document

FILL = 130


def _brand_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_file, piece, text: a heading for each part with a paragraph, then the same parts as a table. A document comes as pieces, as its length grows with the parts."""
    fill = F.lit(" ".join(["word"] * FILL))
    part = read(spark, sf_dir, "part")
    body = F.concat(F.lit("## part "), F.col("p_partkey").cast("string"), F.lit("\n"), "p_name", F.lit(" "), fill, F.lit("\n"))
    row = F.concat(F.lit("<tr><td>"), F.col("p_partkey").cast("string"), F.lit("</td><td>"), "p_name", F.lit("</td><td>"), fill, F.lit("</td></tr>"))
    piece = lambda section, text: F.struct(F.lit(section).alias("section"), F.col("p_partkey").cast("long").alias("key"), F.col("p_name").alias("name"), text.alias("text"))
    own = part.select("p_brand", F.inline(F.array(piece(1, body), piece(3, row))))
    once = part.select("p_brand").distinct().select("p_brand", F.lit(0).cast("long").alias("key"), F.lit("").alias("name"), F.inline(F.array(*(F.struct(F.lit(k).alias("section"), text.alias("text")) for k, text in ((0, F.concat(F.lit("# "), "p_brand", F.lit("\n"))), (2, F.lit("Records\n<table><tr><td>No</td><td>Name</td><td>Note</td></tr>")), (4, F.lit("</table>")))))))
    return own.unionByName(once).select(F.col("p_brand").alias("source_file"), F.struct("section", "key", "name").alias("piece"), "text")


INGEST = f"""WITH RECURSIVE p AS (SELECT p_brand AS b, p_partkey AS k, p_name AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY p_brand) AS n, repeat('word ', {FILL - 1}) || 'word' AS fill FROM part),
last AS (SELECT b, max_by(k, i) AS k, max(n) AS n FROM p GROUP BY b),
t AS (SELECT b, i, 'part ' || k AS title, b || ' > part ' || k || chr(10) || CASE WHEN i = 1 THEN '# ' || b || chr(10) || chr(10) ELSE '' END || '## part ' || k || chr(10) || x || ' ' || fill || CASE WHEN i = n THEN chr(10) || 'Records' ELSE '' END AS content, CASE WHEN i = 1 THEN 1 ELSE 2 * i END AS start_line FROM p),
r0 AS (SELECT p.b, i, p.n, b || ' > part ' || last.k || ' > Records' || chr(10) || 'No: ' || p.k || chr(10) || 'Name: ' || x || chr(10) || 'Note: ' || fill AS content FROM p JOIN last USING (b)),
r AS (SELECT *, {half('content')} // 2 + 1 AS tokens FROM r0),
w AS (SELECT b, i, tokens AS used, 0 AS part FROM r WHERE i = 1 UNION ALL SELECT r.b, r.i, CASE WHEN w.used + r.tokens > 2000 THEN r.tokens ELSE w.used + r.tokens END, CASE WHEN w.used + r.tokens > 2000 THEN part + 1 ELSE part END FROM w JOIN r ON r.b = w.b AND r.i = w.i + 1),
parts AS (SELECT b, max(part) + 1 AS parts FROM w GROUP BY b)"""


@query(f"""{INGEST} SELECT b AS source_file, CAST(i - 1 AS BIGINT) AS chunk_no, false AS is_table, title AS block_title, CAST({half('content')} // 2 + 1 AS BIGINT) AS token_estimate, CAST(start_line AS BIGINT) AS start_line, md5(content) AS content FROM t
UNION ALL SELECT r.b, n + r.i - 1, true, CASE WHEN parts > 1 THEN 'Records(第' || (part + 1) || '部分)' ELSE 'Records' END, tokens, 2 * n + 3, md5(content) FROM r JOIN w ON w.b = r.b AND w.i = r.i JOIN parts ON parts.b = r.b""")
def ingest_chunks(spark, sf_dir):
    """The whole offline plan: lines, headings, shells, sizes, chunks with the way to them, the table's records in parts of bounded size, one order."""
    out = ingest.ingested(_brand_docs(spark, sf_dir))
    return out.select("source_file", *_long("chunk_no"), "is_table", "block_title", *_long("token_estimate", "start_line"), F.md5("content").alias("content"))


@query("""WITH p AS (SELECT s_suppkey AS k, s_suppkey % 4 AS n FROM supplier), t AS (SELECT k, n, unnest(range(1, n + 2)) AS i FROM p)
SELECT CAST(k AS VARCHAR) AS source_file, CAST(0 AS BIGINT) AS table_block, 'T' || k || CASE WHEN n > 0 THEN '' ELSE '' END AS block_title, CAST(i - 1 AS BIGINT) AS chunk_idx, 'T' || k || chr(10) || 'Name: x' || i AS content FROM t""")
def small_tables(spark, sf_dir):
    """Small tables that share a line become one block, whatever their number."""
    docs = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("source_file"), F.concat(F.lit("T"), F.col("s_suppkey").cast("string"), F.lit("\n"), F.array_join(F.transform(F.sequence(F.lit(1), (F.col("s_suppkey") % 4 + 1).cast("int")), lambda i: F.concat(F.lit("<table><tr><td>Name</td></tr><tr><td>x"), i.cast("string"), F.lit("</td></tr></table>"))), "")).alias("text"))
    none = spark.createDataFrame([], "source_file string, start_line int, breadcrumb array<string>")
    return ingest.table_chunks(docs, none).select("source_file", *_long("table_block"), "block_title", *_long("chunk_idx"), "content")


@query("SELECT CAST(p_partkey AS BIGINT) AS custom_id, 'Which of these kinds fits the text best? Answer with one word.' || chr(10) || '" + ", ".join(DEFAULT.roles) + "' || chr(10) || chr(10) || p_brand || chr(10) || left(trim(repeat(p_name || ' ', 200)), 800) AS prompt FROM part")
def tagging_prompts(spark, sf_dir):
    """The first characters of a chunk's body, without the heading before it."""
    content = F.concat("p_brand", F.lit("\n\n# "), "p_brand", F.lit("\n"), F.repeat(F.concat("p_name", F.lit(" ")), F.lit(200)))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("custom_id"), F.col("p_brand").alias("heading_path"), content.alias("content"))
    return prompts.tagging(rows).select("custom_id", F.col("messages")[0]["content"].alias("prompt"))


# ---------------------------------------------------------------- files between the stages

@query("""SELECT '{"custom_id":"' || p_partkey || '","method":"POST","url":"/v1/embeddings","body":{"model":"m","input":"' || p_name || '","encoding_format":"float"}}' AS value FROM part""")
def embedding_requests(spark, sf_dir):
    return files.embedding_requests(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("custom_id"), F.col("p_name").alias("text")), "m")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (1, 2) THEN '' ELSE o_orderpriority END AS answer FROM orders")
def batch_round_trip(spark, sf_dir):
    """Result lines, some of them broken, without an answer or missing, joined to their requests by id."""
    line = F.expr("""CASE o_orderkey % 5 WHEN 1 THEN '{broken' WHEN 2 THEN concat('{"custom_id":"', o_orderkey, '","response":null}') ELSE concat('{"custom_id":"', o_orderkey, '","response":{"body":{"choices":[{"message":{"content":" ', o_orderpriority, ' "}}]}}}') END""")
    orders = read(spark, sf_dir, "orders")
    answers = files.parse_answers(orders.select(line.alias("value")))
    return files.answered(orders.select(F.col("o_orderkey").alias("custom_id")), answers, "answer", F.lit("")).select(F.col("custom_id").alias("o_orderkey"), "answer")


@query("SELECT c_custkey, n_name AS title, CASE WHEN n_name IS NULL THEN (SELECT string_agg(CAST(n_nationkey AS VARCHAR), ', ' ORDER BY CAST(n_nationkey AS VARCHAR)) FROM nation) END AS missing FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN -1 ELSE c_nationkey END AS k FROM customer) LEFT JOIN nation ON n_nationkey = k")
def scenario_choice(spark, sf_dir):
    """A scenario by its name, or the choices there are."""
    none = F.array().cast("array<string>")
    scenarios = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title"), none.alias("supplies"), none.alias("steps"), none.alias("knowledge_points"))
    wanted = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "none").otherwise(F.col("c_nationkey").cast("string")).alias("scenario_id"))
    return prompts.scenario_of(wanted, scenarios).select("c_custkey", "title", "missing")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'first ' || o_orderkey ELSE o_orderpriority END AS answer FROM orders")
def second_call(spark, sf_dir):
    """The second answer, or the first where it is blank."""
    second = F.when(F.col("o_orderkey") % 3 == 0, F.lit("  ")).otherwise(F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").select("o_orderkey", prompts.final_answer(second, F.concat(F.lit("first "), F.col("o_orderkey").cast("string"))).alias("answer"))


# ---------------------------------------------------------------- search to context

def _fit_sql(source: str) -> str:
    """Recursive SQL: the hits of a query that fit into the budget, in order of rank; demoted ones with their own text."""
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM {source}),
w AS (SELECT query_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(NULL AS BOOLEAN) AS whole_in FROM (SELECT DISTINCT query_id FROM n)
UNION ALL SELECT n.query_id, n.i, CAST(w.used + CASE WHEN w.used + n.tokens <= 10000 THEN n.tokens WHEN n.promoted AND w.used + n.original <= 10000 THEN n.original ELSE 0 END AS BIGINT), CASE WHEN w.used + n.tokens <= 10000 THEN n.promoted WHEN n.promoted AND w.used + n.original <= 10000 THEN false END FROM w JOIN n ON n.query_id = w.query_id AND n.i = w.i + 1),
fitting AS (SELECT n.query_id, n.rank, n.doc_id, w.whole_in FROM w JOIN n ON n.query_id = w.query_id AND n.i = w.i WHERE w.whole_in IS NOT NULL),
texts AS (SELECT f.query_id, f.rank, f.doc_id, c.source, c.lang, CASE WHEN f.whole_in THEN b.content ELSE c.content END AS content, CASE WHEN f.whole_in THEN b.ids ELSE CAST(f.doc_id AS VARCHAR) END AS ids FROM fitting f JOIN places c ON c.doc_id = f.doc_id JOIN bodies b USING (block_id)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM texts),
contexts AS (SELECT query_id, md5(string_agg('[' || i || '] ' || source || ' (' || lang || ')' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i)) AS context, string_agg(ids, ',' ORDER BY i) AS sources FROM numbered GROUP BY query_id)"""


PLACES = "places AS (SELECT doc_id, doc_id // 4 AS block_id, source, lang, text AS content FROM documents), bodies AS (SELECT block_id, string_agg(content, chr(10) || chr(10) ORDER BY doc_id) AS content, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM places GROUP BY block_id)"


@query(f"WITH RECURSIVE {q.PROMOTED}, {PLACES}, {_fit_sql('promoted')} SELECT query_id, context, sources FROM contexts")
def search_context(spark, sf_dir):
    """The whole search: both branches by role, fusion, the best hits, promoted blocks, the budget, numbered passages."""
    hits = q.stage(q._hybrid(spark, sf_dir).select("query_id", "rank", "chunk_id", "score"), "hits")
    out = retrieve.passages(hits, q._blocks(spark, sf_dir))
    return out.select("query_id", F.md5("context").alias("context"), F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


@query("SELECT o_custkey AS query_id, string_agg(o_orderpriority, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY o_orderkey) AS rag_context, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS sources FROM orders GROUP BY o_custkey")
def raw_context(spark, sf_dir):
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    hits = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.row_number().over(order).alias("rank"), F.col("o_orderkey").cast("string").alias("chunk_id"), F.col("o_orderpriority").alias("content"))
    return fusion.raw_context(hits).select("query_id", "rag_context", F.array_join("sources", ",").alias("sources"))


#: Roles for the documents' languages, and what the first call answers to each query.
ROLE_OF = {"en": "sop", "de": "emergency", "fr": "knowledge", "es": "notice"}
ROLE_SQL = "CASE lang " + " ".join(f"WHEN '{lang}' THEN '{role}'" for lang, role in ROLE_OF.items()) + " END"
ASKED = "trim(replace(left(text, 40), '\n', ' '))"
OUTPUT = f"CASE item_id % 6 WHEN 0 THEN ' known: ' || item_id WHEN 1 THEN '我不确定' WHEN 2 THEN '[NEED_RAG:sop, Emergency,other]\nQUERY: ' || {ASKED} WHEN 3 THEN '[NEED_RAG: knowledge]' WHEN 4 THEN '[NEED_RAG:equipment]\nQUERY: ' || {ASKED} ELSE '[NEED_RAG:none]' END"

#: The same search over documents that carry a role for a language, for the queries and roles of `wanted`.
ONLINE_SEARCH = (
    q.HYBRID.replace("FROM documents", "FROM placed").replace("JOIN documents", "JOIN placed").replace("FROM benchmark", "FROM searched").replace("FROM fused JOIN orders USING (lang))", "FROM fused JOIN (SELECT query_id, lang, place AS role_ord FROM wanted) USING (query_id, lang))")
)
ONLINE_SCORES = q.SCORES_SQL.replace("FROM documents", "FROM asked_docs")


@query(f"""WITH RECURSIVE placed AS (SELECT doc_id, source, text, {ROLE_SQL} AS lang FROM documents), asked_docs AS (SELECT item_id AS doc_id, '' AS source, text FROM benchmark), {ONLINE_SCORES},
guessed AS (SELECT doc_id AS item_id, role, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, role_ord) AS place FROM scores WHERE role <> 'junk'),
known AS (SELECT item_id, text, item_id % 6 AS k, {q._route_sql().replace("(q,", "(regexp_replace(text, '\\s+', '', 'g'),")} AS command FROM benchmark),
searched AS (SELECT item_id, CASE WHEN k IN (2, 4) THEN {ASKED} ELSE text END AS text FROM known WHERE command IS NULL AND k > 0),
wanted AS (SELECT item_id AS query_id, role AS lang, place FROM guessed JOIN known USING (item_id) WHERE command IS NULL AND k IN (1, 5) AND place <= 2 UNION ALL SELECT item_id, 'sop', 1 FROM known WHERE command IS NULL AND k = 2 UNION ALL SELECT item_id, 'emergency', 2 FROM known WHERE command IS NULL AND k = 2 UNION ALL SELECT item_id, 'knowledge', 1 FROM known WHERE command IS NULL AND k = 3 UNION ALL SELECT item_id, 'equipment', 1 FROM known WHERE command IS NULL AND k = 4),
{ONLINE_SEARCH}, {q.CHUNKS_SQL.replace("FROM documents", "FROM placed")},
hits AS (SELECT h.query_id, h.rank, h.doc_id, block_id, tokens AS original, a.whole, coalesce(n >= 2 AND r = 1 AND t <= 2000, false) AS promoted FROM hybrid h JOIN chunks c ON c.doc_id = h.doc_id JOIN able a USING (block_id)),
promoted AS (SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, promoted, CASE WHEN promoted THEN whole ELSE original END AS tokens, original FROM (SELECT *, row_number() OVER (PARTITION BY query_id, block_id ORDER BY rank) AS k FROM hits) WHERE NOT promoted OR k = 1),
{PLACES.replace("FROM documents", "FROM placed")}, {_fit_sql('promoted')},
roles AS (SELECT query_id AS item_id, string_agg(lang, ',' ORDER BY place) AS roles FROM wanted GROUP BY query_id)
SELECT item_id AS query_id, CASE WHEN command IS NOT NULL THEN 'funcall' WHEN k = 0 THEN 'direct' WHEN context IS NULL THEN 'direct_fallback' ELSE 'rag' END AS answer_type, command, CASE WHEN command IS NULL AND k = 0 THEN 'known: ' || item_id WHEN command IS NULL AND context IS NULL THEN CASE k WHEN 1 THEN '我不确定' WHEN 2 THEN '[NEED_RAG:sop, Emergency,other]' || chr(10) || 'QUERY: ' || {ASKED} WHEN 3 THEN '[NEED_RAG: knowledge]' WHEN 4 THEN '[NEED_RAG:equipment]' || chr(10) || 'QUERY: ' || {ASKED} ELSE '[NEED_RAG:none]' END END AS answer, roles, CASE WHEN command IS NULL AND k > 0 THEN CASE WHEN k IN (2, 4) THEN {ASKED} ELSE text END END AS search_query, context, sources
FROM known LEFT JOIN roles USING (item_id) LEFT JOIN contexts ON contexts.query_id = item_id""")
def online_answers(spark, sf_dir):
    """The whole online plan: router, first output, slots and hedging, roles by keywords, search by role, promotion, budget, context."""
    return _online(spark, sf_dir)


def _online(spark: SparkSession, sf_dir: str, searched: bool = True, second_call: bool = True) -> DataFrame:
    docs, benchmark, vectors, asked = q._search_inputs(spark, sf_dir)
    role = lambda c: F.create_map(*(F.lit(x) for pair in ROLE_OF.items() for x in pair))[c]
    chunks = q._blocks(spark, sf_dir).withColumn("role", role(F.col("role"))).withColumn("source_file", F.col("role")).withColumn("text", F.col("content"))
    placed = vectors.join(docs.select("chunk_id", role(F.col("role")).alias("role")), "chunk_id")
    outputs = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(OUTPUT.replace("\n", "\\n")).alias("output"))
    where = (chunks, placed, asked) if searched else (None, None, None)
    out = online.handle(benchmark.select("query_id", F.col("text").alias("query")), outputs, q.WORDS, *where, table=q.RULES, second_call=second_call)
    return out.select("query_id", "answer_type", "command", "answer", F.array_join("roles", ",").alias("roles"), "search_query", F.md5("context").alias("context"), F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


RAW_SQL = ORACLES["online_answers"].replace("'[' || i || '] ' || source || ' (' || lang || ')' || chr(10) || content", "content").replace("string_agg(ids, ',' ORDER BY i)", "string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY i)").replace("ELSE 'rag' END", "ELSE 'rag_raw' END")


@query(RAW_SQL)
def online_raw(spark, sf_dir):
    """The online plan without a second call: the contents alone are the answer's context."""
    return _online(spark, sf_dir, second_call=False)


@query(f"SELECT query_id, CASE answer_type WHEN 'funcall' THEN 'funcall' WHEN 'direct' THEN 'direct' ELSE 'need_rag' END AS answer_type, command, CASE WHEN answer_type = 'direct' THEN answer END AS answer, roles, search_query, CAST(NULL AS VARCHAR) AS context, CAST(NULL AS VARCHAR) AS sources FROM ({ORACLES['online_answers']})")
def online_unsearched(spark, sf_dir):
    """The online plan where there is nothing to search: what needs a search says so, with its roles and its text."""
    return _online(spark, sf_dir, searched=False)
