"""Named queries on what stands between the stages: files that are written and read back, results of models, the tagging driver, scenario texts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import text as tx
from ..operators import catalog, lines, models, outline, prompts, roles, store
from ..sources import arrays, batches, files
from ..staging import scratch, stage
from ..streaming import changes
from . import ingest, retrieve
from . import queries as q
from . import whole_queries as w

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

read = q.read


def query(sql: str):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return add


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


def _folder(spark: SparkSession, tag: str) -> str:
    return f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- array files

#: Bytes of a stretch in the query on cut files: records are cut again and again.
STRETCH = 65536


@query("""SELECT o_orderkey, '}{"[' || o_orderpriority AS priority, o_custkey FROM orders""")
def array_records(spark, sf_dir):
    """Orders as JSON arrays, read in stretches of bytes that run through records; brackets and quotes within strings too."""
    path = _folder(spark, "orders")
    priority = F.concat(F.lit('}{"['), "o_orderpriority")
    arrays.save_array(read(spark, sf_dir, "orders").select("o_orderkey", F.struct(priority.alias("priority"), F.array("o_custkey").alias("customers")).alias("order")), path)
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", STRETCH)
    try:
        rows, _ = arrays.read(spark, path, "o_orderkey bigint, `order` struct<priority:string,customers:array<bigint>>")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    return rows.select("o_orderkey", "order.priority", F.get("order.customers", F.lit(0)).alias("o_custkey"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, p_name AS content, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS role, CAST(CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS BIGINT) AS role_confidence, CASE WHEN p_size % 3 = 0 THEN 'llm' ELSE 'rule' END AS tagged_by FROM part")
def tagged_file(spark, sf_dir):
    """Tagged chunks as an array file: numbers as text, what is missing or no number gets its default."""
    path = _folder(spark, "tagged")
    confidence = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("none")
    arrays.save_array(read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("chunk_id"), F.col("p_name").alias("content"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("role"), confidence.alias("role_confidence"), F.when(F.col("p_size") % 3 == 0, "llm").alias("tagged_by")), path)
    return files.tagged(spark, path).select("chunk_id", "content", "role", "role_confidence", "tagged_by")


@query(f"WITH {q.OUTLINE_BLOCKS} SELECT CAST(doc AS VARCHAR) AS source_file, string_agg(CASE WHEN k = 1 THEN '  ' ELSE '' END || '- ' || title || ' [' || start_line || '-' || CAST(coalesce(until, n) AS BIGINT) || ']', chr(10) ORDER BY start_line) AS outline FROM blocks JOIN ends USING (doc) GROUP BY doc")
def outline_tree(spark, sf_dir):
    """The report of each document's blocks."""
    found = outline.blocks(q._outline_lines(spark, sf_dir), doc="doc")
    return ingest.tree(found.withColumn("source_file", F.col("doc").cast("string")))


# ---------------------------------------------------------------- lines

#: Second lines of a part's text, and whether they are noise; the tail makes the later ones noise too.
SECOND = [("Tel：010", True), ("版本号：1", True), ("www.a.com", True), ("参考文献", True), ("第 1 页 共 2 页", True), ("plain", False), ("x@y.com", True), ("see Tel：010", False)]
SECOND_SQL = "CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN '{line}'" for k, (line, _) in enumerate(SECOND)) + " END"


@query(f"""SELECT p_partkey, CAST(i AS BIGINT) AS line_no, CASE i WHEN 1 THEN false WHEN 2 THEN p_partkey % 8 IN ({', '.join(str(k) for k, (_, noise) in enumerate(SECOND) if noise)}) ELSE p_partkey % 8 = 3 END AS is_noise, i = 3 AND length(trim(repeat(p_name || ' ', 1 + p_size % 5))) >= {DEFAULT.numbered_item_min} AS is_item FROM part, range(1, 4) t(i)""")
def line_kinds(spark, sf_dir):
    """Lines of each kind of noise, the tail that makes all later ones noise, and numbered items with long bodies."""
    item = F.concat(F.lit("7、"), F.trim(F.repeat(F.concat("p_name", F.lit(" ")), (F.col("p_size") % 5 + 1).cast("int"))))
    docs = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\n", F.lit("first"), F.expr(SECOND_SQL), item).alias("text"))
    parsed = lines.parse(lines.explode_lines(docs, doc="p_partkey"), doc="p_partkey")
    return parsed.select("p_partkey", *_long("line_no"), "is_noise", tx.is_numbered_item(F.col("cleaned")).alias("is_item"))


@query("""WITH now AS (SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN p_name || chr(10) || p_type WHEN p_partkey % 10 = 0 THEN p_brand ELSE p_name || chr(10) || p_brand END AS text, CASE WHEN p_size % 3 = 1 OR p_partkey % 10 = 0 THEN 2 ELSE 1 END AS since FROM part WHERE p_size % 3 <> 0)
SELECT CAST(p_partkey AS VARCHAR) AS source_file, CAST(i AS BIGINT) AS line_no, split_part(text, chr(10), i) AS raw, CAST(since AS BIGINT) AS since FROM now, range(1, 3) t(i) WHERE split_part(text, chr(10), i) <> ''""")
def ingest_changes(spark, sf_dir):
    """Lines of parts as documents, brought up to date after a third was edited, a third deleted and a tenth came anew: only what changed is worked on again."""
    part = read(spark, sf_dir, "part").withColumn("source_file", F.col("p_partkey").cast("string"))
    edited, new = F.col("p_size") % 3 == 1, F.col("p_partkey") % 10 == 0
    plain = F.when(new, F.col("p_brand")).otherwise(F.concat_ws("\n", "p_name", "p_brand"))
    first = part.where(~new).withColumn("stamp", F.lit("1")).withColumn("text", plain)
    second = part.where(F.col("p_size") % 3 != 0).withColumn("stamp", F.when(edited, "2").otherwise("1")).withColumn("text", F.when(edited, F.concat_ws("\n", "p_name", "p_type")).otherwise(plain))
    target = _folder(spark, "followed")
    for docs in (first, second):
        changes.sync(docs.select("source_file", "stamp"), lambda wanted, docs=docs: docs.select("source_file", "text").join(wanted, "source_file", "left_semi"), lambda found: {"lines": lines.explode_lines(found)}, target)
    return changes.table(spark, target, "lines").select("source_file", *_long("line_no"), "raw", "since")


# ---------------------------------------------------------------- models

@query("SELECT p_partkey, p_name AS answer FROM part")
def model_answers(spark, sf_dir):
    """Prompts to a model, partition by partition; this one says the last line again."""
    asked = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Say:\n"), "p_name").alias("prompt"))
    return models.with_answers(asked, models.Echo(), "prompt").select("p_partkey", "answer")


@query("SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, CAST(p_partkey AS DOUBLE) AS first, CAST(p_size AS DOUBLE) AS second FROM part")
def embedding_results(spark, sf_dir):
    """Result lines of a batch to vectors, and these to their chunks; a broken line among them is left out."""
    part = read(spark, sf_dir, "part")
    line = F.format_string('{"custom_id":"%s","response":{"body":{"data":[{"embedding":[%s,%s]}]}}}', F.col("p_partkey").cast("string"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string"))
    path = _folder(spark, "results")
    part.select(line.alias("value")).unionByName(part.select(F.lit("{broken").alias("value"))).write.text(path)
    vectors = files.batch_embeddings(spark, path).withColumnRenamed("custom_id", "chunk_id")
    out = store.with_vectors(part.select(F.col("p_partkey").cast("string").alias("chunk_id")), vectors)
    return out.select("chunk_id", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[1].cast("double").alias("second"))


class Moody:
    """An endpoint that says a question again, but not always: by the number of the request it never answers, answers only in the third attempt, twice, first without choices or first with a line that is cut off."""

    def run(self, lines: list[str], attempt: int) -> Iterable[str]:
        for line in lines:
            request = json.loads(line)
            key = request["custom_id"]
            kind = int(key) % 7
            if kind == 0 or kind == 1 and attempt < 2:
                continue
            choices = [] if kind == 3 and attempt == 0 else [{"message": {"content": request["body"]["messages"][-1]["content"]}}]
            found = json.dumps({"custom_id": key, "response": {"body": {"choices": choices}}})
            yield found[:25] if kind == 4 and attempt == 0 else found
            if kind == 2:
                yield found


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority || ' ' || o_orderkey END AS answer, CASE WHEN o_orderkey % 7 = 0 THEN 'missing' ELSE 'answered' END AS outcome, CAST(CASE o_orderkey % 7 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 1 END AS BIGINT) AS attempts FROM orders")
def batch_attempts(spark, sf_dir):
    """A question for each order through the batch protocol with its ledger, to an endpoint that drops, repeats and breaks lines."""
    key = F.col("o_orderkey").cast("string")
    asked = read(spark, sf_dir, "orders").select(key.alias("custom_id"), F.array(prompts.message("user", F.concat("o_orderpriority", F.lit(" "), key))).alias("messages"))
    lines = files.chat_requests(asked, "any", 64, 0.0).select(F.get_json_object("value", "$.custom_id").alias("custom_id"), "value")
    out = batches.ask(lines, Moody(), _folder(spark, "batches"), most_bytes=1 << 20)
    return out.select(F.col("custom_id").cast("long").alias("o_orderkey"), "answer", "outcome", "attempts")


# ---------------------------------------------------------------- tagging

@query(f"""{w.INGEST}, chunk_docs AS (SELECT b || '_block' || (i - 1) || '_chunk0' AS doc_id, b || ' > ' || title AS source, content AS text, start_line FROM t),
{q.BEST_SQL.replace('FROM documents', 'FROM chunk_docs')}
SELECT doc_id AS chunk_id, source AS heading_path, role, CAST(confidence AS BIGINT) AS role_confidence, CAST({q.half('text')} // 2 + 1 AS BIGINT) AS token_estimate, CAST(start_line AS BIGINT) AS start_line, 'rule' AS tagged_by FROM chunk_docs JOIN best USING (doc_id)""")
def tagged_chunks(spark, sf_dir):
    """The tagging driver: from Markdown over blocks and chunks to ids, ways and the rules' roles."""
    blocks, chunks = ingest.text_chunks(w._brand_docs(spark, sf_dir))
    out = ingest.tagged(blocks, chunks, q.WORDS)
    return out.select("chunk_id", "heading_path", "role", *_long("role_confidence", "token_estimate", "start_line"), "tagged_by")


@query(f"""{w.INGEST}, chunk_docs AS (SELECT b || '_block' || (i - 1) || '_chunk0' AS doc_id, b || ' > ' || title AS source, content AS text FROM t),
{q.BEST_SQL.replace('FROM documents', 'FROM chunk_docs')}, low AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS custom_id FROM best WHERE confidence < 3)
SELECT doc_id AS chunk_id, CASE WHEN custom_id % 2 = 0 THEN 'notice' ELSE role END AS role, CASE WHEN custom_id % 2 = 0 THEN 'llm' ELSE 'rule' END AS tagged_by FROM best LEFT JOIN low USING (doc_id)""")
def tagging_rounds(spark, sf_dir):
    """The driver's second half: chunks whose roles are close are asked about, the answers come back as result lines, half of them of no use, and fill in."""
    blocks, chunks = ingest.text_chunks(w._brand_docs(spark, sf_dir))
    tagged = stage(ingest.tagged(blocks, chunks, q.WORDS).withColumnRenamed("role_confidence", "confidence"), "tagged")
    low = stage(roles.low_margin(tagged), "low")
    line = F.format_string('{"custom_id":"%s","response":{"body":{"choices":[{"message":{"content":"%s"}}]}}}', F.col("custom_id").cast("string"), F.when(F.col("custom_id") % 2 == 0, "It is Notice.").otherwise("?"))
    answers = files.parse_answers(low.select(line.alias("value")))
    return roles.backfill(tagged, low, answers).select("chunk_id", "role", "tagged_by")


# ---------------------------------------------------------------- catalog, scenarios, degraded search

@query("""WITH r AS (SELECT trim(regexp_replace(p_brand || ' ' || p_type || ' ab', '[a-z]+$', '')) AS cn_name, p_name AS en_name, CASE WHEN p_size > 25 THEN p_type ELSE '' END AS hazard_class, CAST(p_size AS VARCHAR) AS level, CASE WHEN p_size % 2 = 0 THEN 'B' ELSE '' END AS category, p_partkey AS ord FROM part)
SELECT cn_name, max_by(en_name, ord) AS en_name, max_by(hazard_class, ord) AS hazard_class, max_by(level, ord) AS culture, max_by(category, ord) AS category, min(ord) AS ord FROM r GROUP BY cn_name""")
def catalog_build(spark, sf_dir):
    """A catalog from table records: names without footnote letters, levels by activity, transport, one entry a name."""
    col = lambda name, value: (F.lit(name), value)
    record = F.create_map(
        *col(catalog.NAMES[0], F.concat("p_brand", F.lit(" "), "p_type", F.lit(" ab"))), *col(catalog.SECOND_NAMES[0], F.concat(F.lit(" "), "p_name")), *col(catalog.CLASS, F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("")),
        *col(catalog.LEVEL_PREFIX + "病毒培养a", F.col("p_size").cast("string")), *col("A/B", F.when(F.col("p_size") % 2 == 0, " B ").otherwise("")), *col(catalog.UN_NUMBER, F.lit("UN1")),
    )
    out = catalog.build(read(spark, sf_dir, "part").select(record.alias("record"), F.col("p_partkey").alias("ord")))
    return out.select("cn_name", "en_name", "hazard_class", F.col("lab_level")["culture"].alias("culture"), F.col("transport.category").alias("category"), "ord")


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 3 THEN NULL WHEN 2 THEN NULL ELSE s_name END AS title, CASE s_suppkey % 4 WHEN 3 THEN NULL WHEN 2 THEN 'one' ELSE 'one,two ' || s_suppkey END AS steps FROM supplier")
def scenario_texts(spark, sf_dir):
    """Scenario files as they come: whole, without the outer brace, cut short within a list, with nothing to read."""
    kind, key = F.col("s_suppkey") % 4, F.col("s_suppkey").cast("string")
    title = F.concat(F.lit('title: "'), "s_name", F.lit('"\n'))
    steps = F.concat(F.lit('"experiment_supplies": ["a"], "experiment_steps": ["one", "two '), key)
    text = F.when(kind == 0, F.concat(title, F.lit("context: `{"), steps, F.lit('"]}`'))).when(kind == 1, F.concat(title, F.lit("context: `"), steps, F.lit('"]'))).when(kind == 2, F.concat(F.lit("context: `{"), steps)).otherwise("nothing")
    parsed = read(spark, sf_dir, "supplier").select("s_suppkey", files.scenario_parse(text).alias("x"))
    return parsed.select("s_suppkey", "x.title", F.array_join("x.steps", ",").alias("steps"))


@query(f"WITH {q.HYBRID.replace('WHERE vec_id IN (SELECT item_id FROM benchmark)', 'WHERE false')} SELECT query_id, doc_id AS chunk_id, lang AS role, score, CAST(rank AS INTEGER) AS rank FROM hybrid")
def words_only_search(spark, sf_dir):
    """Queries whose vectors couldn't be made have hits by words only."""
    docs, benchmark, vectors, asked = q._search_inputs(spark, sf_dir)
    found = retrieve.hybrid(docs, vectors.join(docs.select("chunk_id", "role"), "chunk_id"), benchmark, asked.where("false"), Settings(roles=q.LANGS))
    return found.select("query_id", "chunk_id", "role", "score", "rank")
