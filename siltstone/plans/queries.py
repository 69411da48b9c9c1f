"""Named queries over the driver's tables, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import text as tx
from ..operators import catalog, chunks, fusion, lines, outline, postings, prompts, roles, routing, search, store, tables
from ..staging import scratch, small, stage
from . import ingest, retrieve

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# ---------------------------------------------------------------- lines

LINES = r"lines AS (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
HALF = r"(3 * (length({0}) - length(regexp_replace({0}, '[\x{{4e00}}-\x{{9fff}}]', '', 'g'))) + 2 * len(regexp_extract_all({0}, '[a-zA-Z]+')) + len(regexp_extract_all({0}, '[0-9]+')))"


def half(column: str) -> str:
    return HALF.format(column)


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.explode_lines(read(spark, sf_dir, "documents"), doc="doc_id")


@query(f"SELECT doc_id, CAST({half('text')} // 2 + 1 AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query(f"WITH {LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(length(raw) AS BIGINT) AS chars FROM lines")
def line_explode(spark, sf_dir):
    return _doc_lines(spark, sf_dir).select("doc_id", *_long("line_no"), F.length("raw").cast("long").alias("chars"))


NOISE_SQL = f"(?i)^(?:{'|'.join((*tx.NOISE, *tx.BOILERPLATE))})"
TAIL_SQL = f"^(?:{'|'.join(tx.TAIL)})"


@query(rf"WITH {LINES}, flagged AS (SELECT *, regexp_matches(trim(raw), '{NOISE_SQL}') OR bool_or(regexp_matches(trim(raw), '{TAIL_SQL}')) OVER (PARTITION BY doc_id ORDER BY line_no) AS noise FROM lines) SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (noise) AS BIGINT) AS n_noise, CAST(count(*) FILTER (trim(raw) = '') AS BIGINT) AS n_empty FROM flagged GROUP BY doc_id")
def noise_filter(spark, sf_dir):
    parsed = lines.parse(_doc_lines(spark, sf_dir), doc="doc_id")
    return parsed.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("is_noise").alias("n_noise"), F.count_if("is_empty").alias("n_empty"))


@query(f"WITH {LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, bool_or(regexp_matches(raw, '(?i)license')) OVER (PARTITION BY doc_id ORDER BY line_no) AS is_tail FROM lines")
def tail_flag(spark, sf_dir):
    return lines.sticky(_doc_lines(spark, sf_dir), F.col("raw").rlike("(?i)license"), "is_tail", "doc_id").select("doc_id", *_long("line_no"), "is_tail")


@query(f"WITH {LINES}, flagged AS (SELECT *, length(raw) < 40 AS short FROM lines), numbered AS (SELECT *, sum(CASE WHEN short THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM flagged) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(n AS BIGINT) AS n FROM (SELECT *, count(*) FILTER (short) OVER (PARTITION BY doc_id, run) AS n FROM numbered) WHERE short AND n >= 3")
def line_runs(spark, sf_dir):
    short = F.length("raw") < 40
    return lines.runs(_doc_lines(spark, sf_dir), short, F.lit(True), "n", "doc_id").where("n >= 3").select("doc_id", *_long("line_no", "n"))


@query("SELECT doc_id, CAST(n_chars // 2 AS BIGINT) AS \"offset\", CAST(length(left(text, n_chars // 2)) - length(replace(left(text, n_chars // 2), chr(10), '')) + 1 AS BIGINT) AS line_no FROM documents")
def offset_to_line(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return lines.offsets_to_lines(docs, docs.select("doc_id", F.floor(F.col("n_chars") / 2).alias("offset")), doc="doc_id").select("doc_id", *_long("offset", "line_no"))


@query("SELECT event_id, click_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS click_id FROM events) WHERE event_type = 'error'")
def asof_preceding(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    left = events.where("event_type = 'error'").select("user_id", "ts", "event_id")
    right = events.where("event_type = 'click'").select("user_id", "ts", "event_id", F.col("event_id").alias("click_id"))
    return lines.latest_before(left, right, ["user_id"], ["ts", "event_id"], "click_id").select("event_id", "click_id")


# ---------------------------------------------------------------- outline: a customer's orders and their items

OUTLINE = """filled AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)), items AS (
 SELECT o_custkey AS doc, 0 AS o, 0 AS k, 0 AS ln, 0 AS p, 0 AS s, '# customer ' || o_custkey AS raw FROM (SELECT DISTINCT o_custkey FROM filled)
 UNION ALL SELECT o_custkey, o_orderkey, 1, 0, 0, 0, '## order ' || o_orderkey FROM filled
 UNION ALL SELECT o_custkey, o_orderkey, 2, l_linenumber, l_partkey, l_suppkey, l_linenumber || ' part ' || l_partkey || ' supplier ' || l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
outline AS (SELECT doc, raw, o, k, CAST(row_number() OVER (PARTITION BY doc ORDER BY o, k, ln, p, s) AS BIGINT) AS line_no FROM items)"""


def _outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One join, and one shuffle by customer: an item brings the lines of the headings right before it."""
    item = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("ln"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("o")).repartition("o").groupBy("o", "doc").agg(F.count("*").alias("times"))
    order = Window.partitionBy("doc").orderBy("o", "ln", "p", "s")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.dealt(orders.join(item, "o"), item.count(), "doc")
    rows = rows.withColumn("first", F.row_number().over(order) == 1).withColumn("heads", F.when(F.coalesce(F.lag("o").over(order) == F.col("o"), F.lit(False)), 0).otherwise(F.col("times")))
    rows = rows.withColumn("end", F.sum(F.col("heads") + F.col("times")).over(upto) + 1)
    n = F.col("times") + F.col("heads") + F.col("first").cast("int")
    rows = rows.select("*", F.explode(F.sequence(F.col("end") - n + 1, F.col("end"))).alias("line_no"))
    raw = F.when(F.col("end") - F.col("line_no") < F.col("times"), F.concat("ln", F.lit(" part "), "p", F.lit(" supplier "), "s")).when(F.col("first") & (F.col("line_no") == 1), F.concat(F.lit("# customer "), "doc")).otherwise(F.concat(F.lit("## order "), "o"))
    return rows.select("doc", F.col("line_no").cast("int").alias("line_no"), raw.alias("raw"))


def _outline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.parse(_outline(spark, sf_dir), doc="doc", latex=False)


@query(f"WITH {OUTLINE} SELECT doc, line_no, CAST(CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS heading_level, CASE WHEN k < 2 THEN ltrim(raw, '# ') ELSE '' END AS heading_title FROM outline")
def heading_detect(spark, sf_dir):
    return _outline_lines(spark, sf_dir).select("doc", *_long("line_no"), "heading_level", "heading_title")


OUTLINE_BLOCKS = f"{OUTLINE}, blocks AS (SELECT doc, k, o, ltrim(raw, '# ') AS title, line_no AS start_line, lead(line_no, 1) OVER (PARTITION BY doc ORDER BY line_no) - 1 AS until, row_number() OVER (PARTITION BY doc ORDER BY line_no) AS block_no FROM outline WHERE k < 2), ends AS (SELECT doc, max(line_no) AS n FROM outline GROUP BY doc)"


@query(f"WITH {OUTLINE_BLOCKS} SELECT doc, CAST(block_no AS BIGINT) AS block_no, title, CAST(k + 1 AS INTEGER) AS heading_level, start_line, CAST(coalesce(until, n) AS BIGINT) AS end_line FROM blocks JOIN ends USING (doc)")
def outline_blocks(spark, sf_dir):
    return outline.blocks(_outline_lines(spark, sf_dir), doc="doc").select("doc", *_long("block_no"), "title", "heading_level", *_long("start_line", "end_line"))


@query(f"WITH {OUTLINE_BLOCKS} SELECT doc, CAST(block_no AS BIGINT) AS block_no, CASE WHEN k = 0 THEN title ELSE 'customer ' || doc || ' > ' || title END AS heading_path FROM blocks")
def breadcrumbs(spark, sf_dir):
    return outline.blocks(_outline_lines(spark, sf_dir), doc="doc").select("doc", *_long("block_no"), F.array_join("breadcrumb", " > ").alias("heading_path"))


def _measured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parsed = _outline_lines(spark, sf_dir)
    return parsed, outline.measured_blocks(parsed, doc="doc")


@query(f"""WITH {OUTLINE_BLOCKS}, kept AS (SELECT b.doc, title, start_line, coalesce(until, n) AS end_line, k, block_no FROM blocks b JOIN ends USING (doc) WHERE k = 1)
SELECT doc, title, CAST(2 AS INTEGER) AS heading_level, CAST(CASE WHEN block_no = 2 THEN 1 ELSE start_line END AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line FROM kept""")
def shell_merge(spark, sf_dir):
    """Every order has items here, so that only the customer's heading is a shell."""
    return outline.merge_shells(_measured(spark, sf_dir)[1], doc="doc").select("doc", "title", "heading_level", *_long("start_line", "end_line"))


@query(f"""WITH RECURSIVE {OUTLINE_BLOCKS},
b AS (SELECT b.doc, block_no AS i, title, start_line, coalesce(until, n) AS end_line, (SELECT sum({half("regexp_replace(ol.raw, '^#+ ', '# ')")}) FROM outline ol WHERE ol.doc = b.doc AND ol.line_no BETWEEN b.start_line AND coalesce(b.until, e.n)) AS half FROM blocks b JOIN ends e USING (doc)),
w AS (SELECT doc, i, 1 AS g, half FROM b WHERE i = 1 UNION ALL SELECT b.doc, b.i, CASE WHEN w.half // 2 + 1 < 100 THEN g ELSE g + 1 END, CASE WHEN w.half // 2 + 1 < 100 THEN w.half + b.half ELSE b.half END FROM w JOIN b ON b.doc = w.doc AND b.i = w.i + 1),
g AS (SELECT w.doc, g, max(w.half) AS half, min(start_line) AS start_line, max(end_line) AS end_line, max_by(title, w.i) AS title FROM w JOIN b ON b.doc = w.doc AND b.i = w.i GROUP BY w.doc, g),
last AS (SELECT doc, max(g) AS m FROM g GROUP BY doc),
joined AS (SELECT g.doc, CASE WHEN g.g = m AND g.half // 2 + 1 < 100 AND m > 1 THEN g.g - 1 ELSE g.g END AS g, g.g AS own, half, start_line, end_line, title FROM g JOIN last USING (doc))
SELECT doc, min_by(title, own) AS title, CAST(min(start_line) AS BIGINT) AS start_line, CAST(max(end_line) AS BIGINT) AS end_line, CAST(sum(half) // 2 + 1 AS BIGINT) AS tokens FROM joined GROUP BY doc, g""")
def tiny_merge(spark, sf_dir):
    out = outline.merge_tiny(_measured(spark, sf_dir)[1], doc="doc")
    return out.select("doc", "title", *_long("start_line", "end_line"), tx.tokens_of(F.col("half")).cast("long").alias("tokens"))


@query(f"""WITH {OUTLINE}, lines AS (SELECT doc, k, line_no, ltrim(raw, '# ') AS title, {half("regexp_replace(raw, '^#+ ', '# ')")} AS half FROM outline),
sized AS (SELECT *, sum(half) OVER (PARTITION BY doc) // 2 + 1 > 300 AS large FROM lines), pieces AS (SELECT *, CASE WHEN large THEN sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) ELSE 0 END AS piece FROM sized),
cut AS (SELECT doc, piece, min_by(title, line_no) AS title, min(line_no) AS start_line, max(line_no) AS end_line, sum(half) AS half FROM pieces GROUP BY doc, piece)
SELECT doc, CAST(piece AS BIGINT) AS block_no, title, CASE WHEN piece = 0 THEN title ELSE 'customer ' || doc || ' > ' || title END AS heading_path, start_line, end_line, CAST(half AS BIGINT) AS half FROM cut""")
def oversize_split(spark, sf_dir):
    parsed, found = _measured(spark, sf_dir)
    # one block a customer, so that large ones are there to be cut
    whole = found.groupBy("doc").agg(F.min("block_no").alias("block_no"), F.min_by("title", "block_no").alias("title"), F.min("heading_level").alias("heading_level"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.min_by("breadcrumb", "block_no").alias("breadcrumb"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.lit(False).alias("shell"), F.sum("half").alias("half"))
    return outline.split_oversized(parsed, whole, doc="doc", settings=Settings(block_max=300)).select("doc", *_long("block_no"), "title", F.array_join("breadcrumb", " > ").alias("heading_path"), *_long("start_line", "end_line"), "half")


@query()
def chunk_pipeline(spark, sf_dir):
    """Lines of an outline to chunks: blocks, shells, tiny blocks, chunk boundaries and sizes."""
    parsed, found = _measured(spark, sf_dir)
    found = outline.merge_tiny(outline.merge_shells(found, doc="doc"), doc="doc").withColumnRenamed("doc", "source_file")
    keys = ["source_file", "block_no"]
    placed = ingest.lines_of(found, parsed.withColumnRenamed("doc", "source_file"))
    sized = chunks.sized(chunks.in_order(chunks.raw_chunks(placed, keys), keys)).join(found.select(*keys, "breadcrumb"), keys)
    out = chunks.exploded(sized.withColumn("chunks", chunks.with_breadcrumb(F.col("chunks"), F.col("breadcrumb"))), keys)
    return out.select(F.col("source_file").alias("doc"), *_long("block_no", "chunk_idx", "start_line", "end_line", "token_estimate"), F.sha2("content", 256).alias("content_sha256"))


# ---------------------------------------------------------------- chunks

PARTS = f"parts AS (SELECT doc_id, raw, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS i, {half('raw')} AS half FROM lines WHERE trim(raw) <> '')"


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doc_lines(spark, sf_dir).where("trim(raw) <> ''").withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))
    return rows.select("doc_id", F.col("i").alias("chunk_no"), chunks._chunk(F.lit("t"), F.col("raw"), F.col("i"), F.col("i"), F.lit(1), tx.token_half(F.col("raw"))).alias("chunk"))


@query(f"""WITH RECURSIVE {LINES}, {PARTS}, w AS (SELECT doc_id, i, 0 AS g, half FROM parts WHERE i = 1 UNION ALL SELECT p.doc_id, p.i, CASE WHEN w.half // 2 + 1 < 128 THEN g ELSE g + 1 END, CASE WHEN w.half // 2 + 1 < 128 THEN w.half + p.half ELSE p.half END FROM w JOIN parts p ON p.doc_id = w.doc_id AND p.i = w.i + 1)
SELECT doc_id, CAST(g AS BIGINT) AS chunk_idx, min(i) AS start_line, max(i) AS end_line, CAST(max(half) // 2 + 1 AS BIGINT) AS token_estimate FROM w GROUP BY doc_id, g""")
def merge_small_chunks(spark, sf_dir):
    merged = chunks.in_order(_paragraphs(spark, sf_dir), ["doc_id"]).withColumn("chunks", chunks.merge_small(F.col("chunks")))
    return chunks.exploded(merged, ["doc_id"]).select("doc_id", *_long("chunk_idx", "start_line", "end_line", "token_estimate"))


@query(f"""WITH RECURSIVE {LINES}, {PARTS}, w AS (SELECT doc_id, i, 0 AS g, half FROM parts WHERE i = 1 UNION ALL SELECT p.doc_id, p.i, CASE WHEN (w.half + p.half) // 2 + 1 > 384 THEN g + 1 ELSE g END, CASE WHEN (w.half + p.half) // 2 + 1 > 384 THEN p.half ELSE w.half + p.half END FROM w JOIN parts p ON p.doc_id = w.doc_id AND p.i = w.i + 1)
SELECT doc_id, CAST(g AS BIGINT) AS chunk_idx, 't' || CASE WHEN g > 0 THEN '(续' || g || ')' ELSE '' END AS title, CAST(max(half) // 2 + 1 AS BIGINT) AS token_estimate, md5(string_agg(raw, chr(10) || chr(10) ORDER BY w.i)) AS content FROM w JOIN parts USING (doc_id, i) GROUP BY doc_id, g""".replace("max(half)", "max(w.half)"))
def split_large_chunks(spark, sf_dir):
    """A document's lines as the paragraphs of one chunk."""
    one = chunks.in_order(_paragraphs(spark, sf_dir), ["doc_id"])
    content = F.array_join(F.transform("chunks", lambda c: c["content"]), "\n\n")
    total = F.aggregate("chunks", F.lit(0).cast("long"), lambda s, c: s + c["half"])
    whole = one.select("doc_id", F.array(chunks._chunk(F.lit("t"), content, F.lit(1), F.size("chunks"), F.lit(1), total)).alias("chunks"))
    parts = chunks.exploded(whole.withColumn("chunks", chunks.split_large(F.col("chunks"))), ["doc_id"])
    return parts.select("doc_id", *_long("chunk_idx"), "title", *_long("token_estimate"), F.md5("content").alias("content"))


@query("""WITH RECURSIVE q AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem),
w AS (SELECT l_orderkey, i, n AS used, 0 AS bin, n FROM q WHERE i = 1 UNION ALL SELECT q.l_orderkey, q.i, CASE WHEN w.used + q.n > 60 AND w.used > 0 THEN q.n ELSE w.used + q.n END, CASE WHEN w.used + q.n > 60 AND w.used > 0 THEN bin + 1 ELSE bin END, q.n FROM w JOIN q ON q.l_orderkey = w.l_orderkey AND q.i = w.i + 1)
SELECT l_orderkey, CAST(bin AS BIGINT) AS bin, CAST(sum(n) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY l_orderkey, bin""")
def bin_pack_records(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("n"))))
    packed = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(rows, lambda x: x["n"]).alias("sizes"))
    each = packed.withColumn("bins", chunks.bins_in_order(F.col("sizes"), 60)).select("l_orderkey", F.explode(F.arrays_zip("sizes", "bins")).alias("x"))
    return each.groupBy("l_orderkey", F.col("x.bins").cast("long").alias("bin")).agg(F.sum("x.sizes").alias("total"), F.count("*").alias("n"))


@query("SELECT p_partkey, concat_ws(chr(10), 'name: ' || p_name, 'brand: ' || p_brand, 'size: ' || p_size) AS content FROM part")
def record_text(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    record = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("name"), "p_name", F.lit("brand"), "p_brand", F.lit("note"), F.lit(" "))
    return part.select("p_partkey", chunks.record_text(F.array(*map(F.lit, ("name", "note", "brand", "size", "color"))), record).alias("content"))


# ---------------------------------------------------------------- tables

@query("""WITH r AS (SELECT l_orderkey, l_returnflag AS flag, CAST(l_linenumber AS VARCHAR) AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS i FROM lineitem),
m AS (SELECT *, CASE WHEN lag(flag) OVER w IS NULL OR lag(flag) OVER w <> flag THEN 1 ELSE 0 END AS fresh FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY i)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY i) AS island FROM m)
SELECT l_orderkey, CAST(min(i) AS BIGINT) AS record_no, min(flag) AS flag, CASE WHEN count(DISTINCT line) = 1 THEN min(line) ELSE string_agg(line, ' | ' ORDER BY i) END AS lines FROM g GROUP BY l_orderkey, island""")
def span_groups(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    item = read(spark, sf_dir, "lineitem")
    rows = lines.dealt(item, item.count(), "l_orderkey").withColumn("record_no", F.row_number().over(order))
    found = rows.select("l_orderkey", "record_no", F.array(F.lit("flag"), F.lit("line")).alias("columns"), F.lit(True).alias("data_row_spans"), F.create_map(F.lit("flag"), "l_returnflag", F.lit("line"), F.col("l_linenumber").cast("string")).alias("record"))
    out = tables.group_spans(found, ["l_orderkey"])
    return out.select("l_orderkey", *_long("record_no"), F.col("record")["flag"].alias("flag"), F.col("record")["line"].alias("lines"))


PLAIN_SQL = r"regexp_replace(regexp_replace(html, '<br(?: ?/)?>', chr(10), 'g'), '<[^>]+>', '', 'g')"
#: The entities that pages have; the one for & last, as each is resolved once.
for _entity, _by in ((r"&copy;", "©"), (r"&middot;", "·"), (r"&quot;", '"'), (r"&amp;?", "&")):
    PLAIN_SQL = f"regexp_replace({PLAIN_SQL}, '{_entity}', '{_by}', 'g')"


@query(rf"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({PLAIN_SQL}, chr(160), ' '), '[\t\r\f\x0b]+', ' ', 'g'), '\n+', chr(10), 'g'), ' +', ' ', 'g'), '^\s+|\s+$', '', 'g') AS content FROM pages")
def html_clean(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", tx.clean_html(F.col("html")).alias("content"))


@query(r"SELECT page_id, CAST(i AS BIGINT) AS item, regexp_replace(items[i], '<[^>]+>', '', 'g') AS content FROM (SELECT page_id, items, unnest(range(1, len(items) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS items FROM pages))")
def html_items(spark, sf_dir):
    items = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<li>(.*?)</li>"), 1)).alias("p", "x"))
    return items.select("page_id", (F.col("p") + 1).cast("long").alias("item"), F.regexp_replace("x", "<[^>]+>", "").alias("content"))


# ---------------------------------------------------------------- roles

#: Words of the tables at hand, so that the scores of these queries differ from zero.
WORDS: roles.Words = [
    *((role, "body", word, weight) for role, word, weight in (("sop", "the", 1), ("sop", "step", 3), ("emergency", "and", 1), ("emergency", "alarm", 3), ("regulation", "of", 1), ("regulation", "shall", 3), ("directory", "der", 1), ("directory", "list", 2), ("knowledge", "die", 1), ("knowledge", "means", 3), ("equipment", "les", 1), ("equipment", "device", 4), ("reagent", "los", 1), ("reagent", "buffer", 4), ("notice", "un", 1), ("notice", "warning", 3))),
    *((role, "heading", f"src{k}", 2) for k, role in enumerate(DEFAULT.roles[:8], 1)),
]


def _values() -> str:
    rows = [f"('{role}', {DEFAULT.roles.index(role)}, '{scope}', '{word}', {weight})" for role, scope, word, weight in WORDS]
    return f"lexicon(role, role_ord, scope, keyword, weight) AS (VALUES {', '.join(rows)}), names(role, role_ord) AS (VALUES {', '.join(f'({r!r}, {i})' for i, r in enumerate(DEFAULT.roles))})"


STEP_SQL = r"(?:^|\n)\s*(?:\d+[.、)）]|[（(]\d+[)）]|[一二三四五六七八九十]+[、.]|第[一二三四五六七八九十\d]+步|[Ss]tep\s*\d+)"
DEFINITION_SQL = r"(?:^|\n)\s*(?:\d+\.\d+\s+\S|术语|定义|含义|是指|即：|即,)"
BODY_SQL = r"""body0 AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS l FROM documents),
body1 AS (SELECT *, list_position(list_transform(l[2:], lambda x: NOT (trim(x) = '' OR regexp_matches(trim(x), '^#{1,6}\s'))), true) AS pos FROM body0),
body AS (SELECT doc_id, source, CASE WHEN len(l) > 1 AND coalesce(pos, 0) > 0 THEN trim(array_to_string(l[pos + 1:], chr(10)), ' ' || chr(9) || chr(10) || chr(13)) ELSE text END AS body FROM body1)"""
JUNK_SQL = r"""junk0 AS (SELECT doc_id, body, list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '') AS l, length(regexp_replace(regexp_replace(regexp_replace(body, '!\[.*?\]\(.*?\)', '', 'g'), 'https?://\S+', '', 'g'), '\s+', '', 'g')) AS visible FROM body),
junk AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN 'empty' WHEN len(list_filter(l, lambda x: regexp_matches(trim(x), '^!\[.*?\]\('))) > 0.8 * len(l) THEN 'image_only' WHEN visible < 20 THEN 'too_short' WHEN len(list_filter(l, lambda x: regexp_matches(trim(x), '^\[?\d+\]'))) >= 2 AND len(list_filter(l, lambda x: regexp_matches(trim(x), '^\[?\d+\]'))) > 0.5 * len(l) THEN 'reference_section' END AS reason FROM junk0)"""
SCORES_SQL = rf"""{_values()}, {BODY_SQL}, {JUNK_SQL},
found AS (SELECT doc_id, role, sum(CASE WHEN scope = 'body' THEN least((length(body) - length(replace(body, keyword, ''))) // length(keyword), 3) * weight ELSE CASE WHEN contains(source, keyword) THEN 2 * weight ELSE 0 END END) AS score FROM body CROSS JOIN lexicon GROUP BY doc_id, role),
bonus AS (SELECT b.doc_id, role, CASE role WHEN 'sop' THEN CASE WHEN len(regexp_extract_all(body, '{STEP_SQL}')) >= 3 THEN 4 WHEN len(regexp_extract_all(body, '{STEP_SQL}')) >= 1 THEN 2 ELSE 0 END WHEN 'knowledge' THEN CASE WHEN regexp_matches(body, '{DEFINITION_SQL}') THEN 3 ELSE 0 END WHEN 'junk' THEN CASE WHEN reason IS NOT NULL THEN 20 ELSE 0 END ELSE 0 END AS bonus FROM body b JOIN junk USING (doc_id) CROSS JOIN names),
scores AS (SELECT n.doc_id, n.role, role_ord, CAST(coalesce(score, 0) + bonus AS BIGINT) AS score FROM bonus n LEFT JOIN found f ON f.doc_id = n.doc_id AND f.role = n.role JOIN names ON names.role = n.role)"""
BEST_SQL = f"""{SCORES_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, role_ord) AS place FROM scores),
best AS (SELECT doc_id, max(role) FILTER (place = 1) AS role, max(score) FILTER (place = 1) - max(score) FILTER (place = 2) AS confidence FROM placed GROUP BY doc_id)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.col("source").alias("heading_path"))
    return roles.scored(docs, WORDS, key="doc_id")


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.argmax(_scores(spark, sf_dir), key="doc_id")


@query(f"WITH {SCORES_SQL} SELECT doc_id, role, score FROM scores")
def role_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("doc_id", F.inline_outer("scores")).select("doc_id", "role", "score")


@query(f"WITH {BEST_SQL} SELECT doc_id, role, CAST(confidence AS BIGINT) AS confidence FROM best")
def role_argmax(spark, sf_dir):
    return _best(spark, sf_dir).select("doc_id", "role", *_long("confidence"))


@query(f"WITH {SCORES_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, role_ord) AS place FROM scores WHERE role <> 'junk') SELECT doc_id, string_agg(role, ',' ORDER BY place) AS roles FROM placed WHERE place <= 2 GROUP BY doc_id")
def role_top_two(spark, sf_dir):
    return roles.query_roles(_scores(spark, sf_dir), key="doc_id").select("doc_id", F.array_join("roles", ",").alias("roles"))


@query(f"WITH {BEST_SQL} SELECT doc_id, role, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS custom_id FROM best WHERE confidence < 3")
def low_margin(spark, sf_dir):
    return roles.low_margin(_best(spark, sf_dir), order="doc_id").select("doc_id", "role", *_long("custom_id"))


@query(f"WITH {BEST_SQL}, low AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS custom_id FROM best WHERE confidence < 3), answers AS (SELECT doc_id AS custom_id, CASE WHEN quality = 1 THEN 'sop' END AS named FROM labels) SELECT b.doc_id, coalesce(named, role) AS role, CASE WHEN named IS NULL THEN 'rule' ELSE 'llm' END AS tagged_by FROM best b LEFT JOIN low USING (doc_id) LEFT JOIN answers ON answers.custom_id = low.custom_id")
def backfill(spark, sf_dir):
    best = stage(_best(spark, sf_dir), "best")
    answers = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("custom_id"), F.when(F.col("quality") == 1, "Role: SOP!").otherwise("?").alias("answer"))
    return roles.backfill(best, roles.low_margin(best, order="doc_id"), answers, key="doc_id").select("doc_id", "role", "tagged_by")


@query(f"WITH {BEST_SQL} SELECT role, CAST(count(*) AS BIGINT) AS n FROM best GROUP BY role")
def role_distribution(spark, sf_dir):
    return roles.distribution(_best(spark, sf_dir))


@query(f"WITH {BODY_SQL.replace('CASE WHEN len(l) > 1', 'CASE WHEN false')}, {JUNK_SQL} SELECT doc_id, reason FROM junk")
def junk_filter(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", roles.junk_reason(F.col("text")).alias("reason"))


# ---------------------------------------------------------------- catalog

UPSERT_SQL = "catalog AS (SELECT p_name, max_by(p_brand, p_partkey) AS p_brand, max_by(p_size, p_partkey) AS p_size, min(p_partkey) AS p_partkey FROM part GROUP BY p_name)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.upsert(read(spark, sf_dir, "part").select("p_name", "p_brand", "p_size", "p_partkey"), "p_name", "p_partkey")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.create_map(F.lit("culture"), "p_brand", F.lit("animal"), F.lit("BSL-1"))
    return _parts(spark, sf_dir).select(F.col("p_name").alias("cn_name"), F.lit("").alias("en_name"), level.alias("lab_level"), F.col("p_partkey").alias("ord"))


@query(f"WITH {UPSERT_SQL} SELECT * FROM catalog")
def catalog_upsert(spark, sf_dir):
    return _parts(spark, sf_dir)


@query("SELECT p_partkey, 'animal' AS activity, p_brand AS level FROM part UNION ALL SELECT p_partkey, 'culture', CAST(p_size AS VARCHAR) FROM part WHERE p_size > 25")
def catalog_unpivot(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    record = F.create_map(F.lit("实验活动所需实验室等级/病毒培养a"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise(""), F.lit("实验活动所需实验室等级/动物感染"), "p_brand", F.lit("备注"), F.lit("x"))
    return part.select("p_partkey", F.explode(catalog.levels(record)).alias("activity", "level"))


@query(f"WITH {UPSERT_SQL} SELECT q.p_partkey AS query_id, c.p_name AS cn_name FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name ELSE p_name || ' x' END AS name FROM part) q JOIN catalog c ON c.p_name = q.name")
def lookup_exact(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" x"))).alias("name"))
    return catalog.lookup_exact(names, _catalog(spark, sf_dir))


@query(f"WITH {UPSERT_SQL}, q AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS name FROM part), m AS (SELECT name, p_name, row_number() OVER (PARTITION BY name ORDER BY length(p_name) DESC, p_partkey) AS n FROM q JOIN catalog ON contains(p_name, name) OR contains(name, p_name)) SELECT name AS query_id, p_name AS cn_name FROM m WHERE n = 1")
def lookup_contains(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("name")).distinct()
    return catalog.lookup_contains(names.select(F.col("name").alias("query_id"), "name"), _catalog(spark, sf_dir))


@query()
def lookup_similarity(spark, sf_dir):
    names = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.lower("n_name").alias("name"))
    return catalog.lookup_similar(names, _catalog(spark, sf_dir), Settings(similarity_min=0.3))


@query()
def lookup_cascade(spark, sf_dir):
    """Part names with their letters in disorder at the end, so that each level finds some."""
    name = F.when(F.col("p_size") < 17, F.col("p_name")).when(F.col("p_size") < 34, F.split("p_name", " ")[0]).otherwise(F.concat(F.substring("p_name", 2, 100), F.lit("q")))
    names = read(spark, sf_dir, "part").select(name.alias("name")).distinct()
    return catalog.lookup(names.select(F.col("name").alias("query_id"), "name"), _catalog(spark, sf_dir))


@query("SELECT o_custkey, string_agg(DISTINCT level, ' ' ORDER BY level) FILTER (level <> 'BSL-1') AS levels FROM (SELECT o_custkey, 'BSL-' || left(o_orderpriority, 1) AS level FROM orders) GROUP BY o_custkey")
def level_union(spark, sf_dir):
    per = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.map_from_entries(F.collect_set(F.struct("o_orderpriority", F.concat(F.lit("BSL-"), F.substring("o_orderpriority", 1, 1), F.lit("ab"))))).alias("m"))
    return per.select("o_custkey", catalog.level_of(F.col("m"), F.lit("")).alias("levels"))


@query(f"WITH {UPSERT_SQL} SELECT q.p_partkey AS query_id, concat_ws(' ', c.p_name, CASE WHEN q.p_size % 2 = 0 THEN c.p_brand END, q.p_type) AS search_query FROM part q JOIN catalog c USING (p_name)")
def query_enrich(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    asked = part.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("pathogen"), F.lit("culture").alias("activity"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("sop"))).otherwise(F.array(F.lit("sop"), F.lit("directory"))).alias("roles"), F.col("p_type").alias("query"))
    return catalog.enrich(asked, _catalog(spark, sf_dir)).select("query_id", "search_query")


# ---------------------------------------------------------------- routing

#: Rules that the conversations at hand set off.
RULES = [
    {"command": "ShowProgress", "triggers": ["(show|zeig|muestra).*(step|progress)", "(显示|查看).*(步骤|进度)", "^T[hi].*ed"], "excludes": ["(if|wenn|如果|万一)"]},
    {"command": "CurrentOperation", "triggers": ["(current|now).*(do|step)", "(现在|这一步).*(怎么做|做什么)", "onnt"], "excludes": ["(if|如果)", "whth"]},
    {"command": "NameDevice", "triggers": ["(what|which)(device|instrument)", "auxeau"], "excludes": []},
    {"command": "SwitchScene", "triggers": ["(switch|open|start).*(scene|experiment)", "schein"], "excludes": []},
]


def _route_sql(table: list[dict] = RULES) -> str:
    out = "CASE "
    for rule in table:
        trigger = " OR ".join(f"regexp_matches(q, '{p}')" for p in rule["triggers"])
        exclude = " OR ".join(f"regexp_matches(q, '{p}')" for p in rule["excludes"]) or "false"
        out += f"WHEN NOT ({exclude}) AND ({trigger}) THEN '{rule['command']}' "
    return out + "END"


ROUTED = rf"routed AS (SELECT conv_id, turn, text, {_route_sql()} AS command FROM (SELECT *, regexp_replace(text, '\s+', '', 'g') AS q FROM conversations))"


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.router(read(spark, sf_dir, "conversations").withColumn("query", F.col("text")), RULES)


@query(f"WITH {ROUTED} SELECT conv_id, turn, command, CAST(CASE WHEN command IS NOT NULL THEN 0.95 END AS DOUBLE) AS confidence FROM routed")
def route_rules(spark, sf_dir):
    return _routed(spark, sf_dir).select("conv_id", "turn", "command", "confidence")


@query(f"WITH {ROUTED} SELECT conv_id, turn, CASE WHEN command IS NOT NULL THEN 'funcall' WHEN length(text) % 3 <> 0 AND length(text) % 5 <> 0 THEN 'direct' WHEN length(text) % 7 = 0 THEN 'need_rag' WHEN length(text) % 4 = 0 THEN 'direct_fallback' WHEN length(text) % 11 = 0 THEN 'rag_raw' ELSE 'rag' END AS answer_type FROM routed")
def answer_branch(spark, sf_dir):
    n = F.length("text")
    return _routed(spark, sf_dir).select("conv_id", "turn", routing.branch(F.col("command"), n % 3 == 0, n % 5 == 0, n % 7 != 0, n % 4, n % 11 != 0).alias("answer_type"))


ANSWER = "CASE o_orderstatus WHEN 'F' THEN '[NEED_RAG: SOP, unknown ,Notice]' || chr(10) || 'PATHOGEN: p' || o_custkey || chr(10) || 'ACTIVITY: Culture ' || chr(10) || 'QUERY：' || o_orderpriority WHEN 'O' THEN '[NEED_RAG:equipment]' || chr(10) || 'EQUIPMENT: e' || o_custkey ELSE ' plain 我不确定 ' END"


@query(rf"""WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, {ANSWER} AS output FROM orders)
SELECT o_orderkey, regexp_matches(output, '\[NEED_RAG:([^\]]+)\]') AS needs_rag, CASE o_orderstatus WHEN 'F' THEN 'sop,notice' WHEN 'O' THEN 'equipment' ELSE '' END AS roles, nullif(trim(regexp_extract(output, 'PATHOGEN[:：]\s*(.+)', 1)), '') AS pathogen, CASE o_orderstatus WHEN 'F' THEN 'culture' END AS activity, nullif(trim(regexp_extract(output, 'EQUIPMENT[:：]\s*(.+)', 1)), '') AS equipment, CASE WHEN o_orderstatus IN ('F', 'O') THEN coalesce(nullif(trim(regexp_extract(output, 'QUERY[:：]\s*(.+)', 1)), ''), 'asked') END AS slot_query, o_orderstatus NOT IN ('F', 'O') AS hedging, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN trim(output) END AS answer FROM a""")
def slot_parse(spark, sf_dir):
    outputs = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(ANSWER.replace("chr(10)", "'\\n'")).alias("output"), F.lit("asked").alias("query"))
    return routing.slots(outputs).select("o_orderkey", "needs_rag", F.array_join("roles", ",").alias("roles"), "pathogen", "activity", "equipment", "slot_query", "hedging", "answer")


# ---------------------------------------------------------------- search

def _search_inputs(spark: SparkSession, sf_dir: str):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("lang").alias("role"))
    benchmark = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = vectors.select(F.col("chunk_id").alias("query_id"), "vector").join(small(benchmark.select("query_id")), "query_id", "left_semi")
    return docs, benchmark, vectors, asked


COSINE = "round(list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 9)"
VECTORS = "vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), asked AS (SELECT vec_id AS query_id, v FROM vectors WHERE vec_id IN (SELECT item_id FROM benchmark))"
POSTINGS = r"""tokens AS (SELECT doc_id, lang, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS t FROM documents),
sizes AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tokens), terms AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS term FROM benchmark),
postings AS (SELECT doc_id, lang, dl, term, count(*) AS tf FROM (SELECT doc_id, lang, len(t) AS dl, unnest(t) AS term FROM tokens) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
weights AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, sizes GROUP BY term, n),
bm25 AS (SELECT item_id, doc_id, lang, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM terms JOIN weights USING (term) JOIN postings USING (term), sizes GROUP BY item_id, doc_id, lang)"""
#: The languages as roles, in the order that decides ties.
LANGS = ("fr", "en", "es", "de")
HYBRID = f"""{VECTORS}, {POSTINGS},
d AS (SELECT query_id, e.vec_id AS doc_id, lang, {COSINE} AS score FROM asked q, vectors e JOIN documents ON doc_id = e.vec_id),
dr AS (SELECT query_id, lang, doc_id, rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, doc_id) AS rk FROM d) WHERE rk <= 12),
br AS (SELECT item_id AS query_id, lang, doc_id, rk FROM (SELECT *, row_number() OVER (PARTITION BY item_id, lang ORDER BY score DESC, doc_id) AS rk FROM bm25) WHERE rk <= 12),
orders(lang, role_ord) AS (VALUES {", ".join(f"('{lang}', {place})" for place, lang in enumerate(LANGS))}),
fused AS (SELECT query_id, lang, doc_id, dr.rk AS drk, br.rk AS brk, round(coalesce(0.4 / (60 + dr.rk), 0) + coalesce(0.6 / (60 + br.rk), 0), 9) AS score FROM dr FULL JOIN br USING (query_id, lang, doc_id)),
hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, role_ord, drk NULLS LAST, brk NULLS LAST, doc_id) AS rank FROM fused JOIN orders USING (lang)) WHERE rank <= 12)"""


@query(f"WITH {VECTORS}, s AS (SELECT query_id, e.vec_id AS chunk_id, {COSINE} AS score FROM asked q, vectors e) SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 12")
def dense_topk(spark, sf_dir):
    _, _, vectors, asked = _search_inputs(spark, sf_dir)
    return search.dense(vectors, asked, DEFAULT.top_k).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {POSTINGS} SELECT item_id AS query_id, doc_id AS chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm25) WHERE rank <= 12")
def bm25_topk(spark, sf_dir):
    docs, benchmark, _, _ = _search_inputs(spark, sf_dir)
    return search.bm25(docs, benchmark, DEFAULT.top_k).select("query_id", "chunk_id", "score", "rank")


def _index(spark: SparkSession, docs: DataFrame) -> str:
    """An index of the documents in three inserts, one of them done twice; the name of its tables."""
    name = f"index_{uuid.uuid4().hex}"
    postings.create(spark, name, path=f"{scratch(spark)}/{name}", id_type="bigint")
    for key, own in (("fr", docs.where("role = 'fr'")), ("en", docs.where("role = 'en'")), ("fr", docs.where("role = 'fr'")), ("rest", docs.where("role not in ('fr', 'en')"))):
        postings.insert(own, name, key)
    return name


@query(ORACLES["bm25_topk"])
def bm25_indexed(spark, sf_dir):
    docs, benchmark, _, _ = _search_inputs(spark, sf_dir)
    return postings.search(benchmark, _index(spark, docs), DEFAULT.top_k).select("query_id", "chunk_id", "score", "rank")


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark, vectors, asked = _search_inputs(spark, sf_dir)
    return retrieve.hybrid(docs, vectors.join(docs.select("chunk_id", "role"), "chunk_id"), benchmark, asked, Settings(roles=LANGS))


@query(f"WITH {HYBRID} SELECT query_id, doc_id AS chunk_id, lang AS role, score, CAST(rank AS INTEGER) AS rank FROM hybrid")
def hybrid_search(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("query_id", "chunk_id", "role", "score", "rank")


@query(f"WITH {HYBRID} SELECT query_id, doc_id AS chunk_id, lang AS role, score, CAST(rank AS INTEGER) AS rank FROM hybrid")
def hybrid_indexed(spark, sf_dir):
    """The same search over an index instead of the texts."""
    docs, benchmark, vectors, asked = _search_inputs(spark, sf_dir)
    return retrieve.hybrid(docs, vectors.join(docs.select("chunk_id", "role"), "chunk_id"), benchmark, asked, Settings(roles=LANGS), index=_index(spark, docs)).select("query_id", "chunk_id", "role", "score", "rank")


@query(f"WITH {HYBRID} SELECT query_id, doc_id AS chunk_id, lang AS role, CAST(drk AS INTEGER) AS dense_rank, CAST(brk AS INTEGER) AS bm25_rank, score FROM fused")
def rrf_fusion(spark, sf_dir):
    docs, benchmark, vectors, asked = _search_inputs(spark, sf_dir)
    dense = search.dense(vectors.join(docs.select("chunk_id", "role"), "chunk_id"), asked, DEFAULT.top_k, role="role")
    return fusion.fuse(dense, search.bm25(docs, benchmark, DEFAULT.top_k, role="role")).select("query_id", "chunk_id", "role", "dense_rank", "bm25_rank", "score")


# ---------------------------------------------------------------- promotion, budget, context: blocks of four documents

def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.expr("doc_id div 4").alias("block_id"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("role"), F.col("source").alias("heading_path"), F.col("lang").alias("source_file"), F.lit(1).alias("start_line"), F.col("doc_id").alias("chunk_idx"), F.col("text").alias("content"), tx.token_estimate(F.col("text")).alias("token_estimate"))


CHUNKS_SQL = f"chunks AS (SELECT doc_id // 4 AS block_id, doc_id, lang, content, {half('content')} // 2 + 1 AS tokens, {half('content')} AS half FROM (SELECT *, text AS content FROM documents)), able AS (SELECT block_id, count(*) AS n, count(DISTINCT lang) AS r, sum(tokens) AS t, sum(half) // 2 + 1 AS whole FROM chunks GROUP BY block_id)"


@query(f"WITH {CHUNKS_SQL} SELECT block_id, CAST(n AS BIGINT) AS chunk_count, CAST(r AS BIGINT) AS roles, CAST(t AS BIGINT) AS tokens, n >= 2 AND r = 1 AND t <= 2000 AS promotable FROM able")
def block_promotable(spark, sf_dir):
    return fusion.promotable(_blocks(spark, sf_dir)).select("block_id", *_long("chunk_count", "roles", "tokens"), "promotable")


PROMOTED = f"""{HYBRID}, {CHUNKS_SQL}, hits AS (SELECT h.query_id, h.rank, h.doc_id, block_id, tokens AS original, a.whole, coalesce(n >= 2 AND r = 1 AND t <= 2000, false) AS promoted, n FROM hybrid h JOIN chunks c ON c.doc_id = h.doc_id JOIN able a USING (block_id)),
promoted AS (SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, promoted, CASE WHEN promoted THEN whole ELSE original END AS tokens, original, CASE WHEN promoted THEN n ELSE 1 END AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id, block_id ORDER BY rank) AS k FROM hits) WHERE NOT promoted OR k = 1)"""


@query(f"WITH {PROMOTED} SELECT query_id, rank, doc_id AS chunk_id, promoted, CAST(tokens AS BIGINT) AS tokens, CAST(original AS BIGINT) AS original_tokens, CAST(n AS BIGINT) AS n_chunks FROM promoted")
def promote_blocks(spark, sf_dir):
    hits = _hybrid(spark, sf_dir).select("query_id", "rank", "chunk_id", "score")
    out = fusion.promote(hits, _blocks(spark, sf_dir))
    return out.select("query_id", *_long("rank"), "chunk_id", "promoted", *_long("tokens", "original_tokens"), F.size("chunk_ids").cast("long").alias("n_chunks"))


@query("""WITH RECURSIVE h AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, CAST(floor(o_totalprice / 100) AS BIGINT) AS tokens, CAST(floor(o_totalprice / 400) AS BIGINT) AS original, o_orderstatus = 'F' AS promoted FROM orders),
w AS (SELECT o_custkey, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS took, false AS demoted FROM (SELECT DISTINCT o_custkey FROM orders)
UNION ALL SELECT h.o_custkey, h.i, w.used + CASE WHEN w.used + h.tokens <= 10000 THEN h.tokens WHEN h.promoted AND w.used + h.original <= 10000 THEN h.original ELSE 0 END, CASE WHEN w.used + h.tokens <= 10000 THEN h.tokens WHEN h.promoted AND w.used + h.original <= 10000 THEN h.original END, w.used + h.tokens > 10000 FROM w JOIN h ON h.o_custkey = w.o_custkey AND h.i = w.i + 1)
SELECT o_custkey AS query_id, CAST(i AS INTEGER) AS rank, took AS tokens, demoted FROM w WHERE i > 0 AND took IS NOT NULL""")
def token_budget(spark, sf_dir):
    """A customer's orders as hits."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    hits = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.row_number().over(order).alias("rank"), F.floor(F.col("o_totalprice") / 100).alias("tokens"), F.floor(F.col("o_totalprice") / 400).alias("original_tokens"), (F.col("o_orderstatus") == "F").alias("promoted"))
    return fusion.budget(hits)


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    hits = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.row_number().over(order).alias("rank"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).otherwise("").alias("heading_path"), F.col("o_orderstatus").alias("source_file"), F.col("o_orderkey").cast("string").alias("content"), F.array(F.col("o_orderkey"), F.col("o_custkey")).alias("chunk_ids"))
    return fusion.context(hits)


@query("SELECT o_custkey AS query_id, string_agg('[' || i || ']' || CASE WHEN o_orderstatus <> 'P' THEN ' ' || o_orderpriority ELSE '' END || ' (' || o_orderstatus || ')' || chr(10) || o_orderkey, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) AS context FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) GROUP BY o_custkey")
def context_assembly(spark, sf_dir):
    return _context(spark, sf_dir).select("query_id", "context")


@query("SELECT o_custkey AS query_id, string_agg(o_orderkey || ',' || o_custkey, ',' ORDER BY o_orderkey) AS sources FROM orders GROUP BY o_custkey")
def source_ids(spark, sf_dir):
    return _context(spark, sf_dir).select("query_id", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS prompt FROM conversations GROUP BY conv_id")
def conversation_prompt(spark, sf_dir):
    return prompts.conversation(read(spark, sf_dir, "conversations"))


# ---------------------------------------------------------------- store

def _store(spark: SparkSession, sf_dir: str) -> str:
    """The documents as a chunk store, a row each; the name of its table."""
    name = f"store_{uuid.uuid4().hex}"
    store.ensure(spark, name, path=f"{scratch(spark)}/{name}")
    none = F.lit("")
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"), F.lit(0).cast("long").alias("role_confidence"), none.alias("block_id"), F.col("source").alias("source_file"), F.array("source").alias("breadcrumb"), F.col("source").alias("heading_path"), F.lit(1).cast("long").alias("start_line"), F.lit(1).cast("long").alias("end_line"), F.col("n_chars").alias("token_estimate"), F.lit("rule").alias("tagged_by"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"), F.col("lang").alias("role"))
    store.insert(rows, name)
    return name


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'de' AND source IN ('src1', 'src2', 'src3')")
def store_filter(spark, sf_dir):
    found = store.scan(spark, _store(spark, sf_dir), {"role": "de", "source_file": ["src1", "src2", "src3"]}, ("chunk_id", "source_file", "token_estimate"))
    return found.select(F.col("chunk_id").cast("long").alias("doc_id"), F.col("source_file").alias("source"), F.col("token_estimate").alias("n_chars"))


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang")
def store_count(spark, sf_dir):
    return store.scan(spark, _store(spark, sf_dir), columns=("role",)).groupBy(F.col("role").alias("lang")).agg(F.count("*").alias("n"))


@query('SELECT CAST(count(*) AS BIGINT) AS "rows", CAST(count(*) FILTER (embedding IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (len(embedding) = 0) AS BIGINT) AS empty, CAST(min(len(embedding)) AS BIGINT) AS least, CAST(max(len(embedding)) AS BIGINT) AS most FROM embeddings')
def vector_check(spark, sf_dir):
    return search.vector_check(read(spark, sf_dir, "embeddings").select(F.col("embedding").alias("vector"))).select(*_long("rows", "missing", "empty", "least", "most"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def dynamic_json(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
