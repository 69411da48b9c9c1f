"""One query an operator, over its whole table, with production parameters; and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, graph, jaccard, merges, negatives, packing, pii, quality, secrets, suffix, urls, warc

#: The rules of the URL filter: fixed values.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op2_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest(read(spark, sf_dir, "embeddings"))


def op3_pii_lstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(documents, pii.fit(documents)).drop("text")


def op4_tiktoken_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op5_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    # strings of 400 bytes go; passages of over 50 words are often shorter, and are counted
    return suffix.deduplicate(documents, passages=suffix.PASSAGE).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "n_passages")


def op7_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.join(documents, jaccard.Rule(words=3, num=90, den=100)).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), urls.rule_table(spark, URL_RULES))


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.judge(documents).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words_left", "kept")


def op11_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def op12_heap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_va_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings").withColumn("label", label))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_ownership, op2_graph_ann, op3_pii_lstm_crf, op4_tiktoken_bpe, op5_warc_segments, op6_suffix_dedup, op7_certified_packing, op8_jaccard_join, op9_url_rules, op10_line_quality, op11_weighted_lloyd, op12_heap_counts, op13_va_negatives)}

RULES_SQL = ", ".join(f"('{verdict}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{rule}')" for verdict, rule in URL_RULES)
WORDS_SQL = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

FINITE_SQL = "len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"


def _lloyd_sql() -> str:
    """Ten rounds, one after the other, and the last assignment."""
    steps = [f"""q AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, sha256('{centroids.SEED}:' || vec_id) AS h, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {centroids.DIMENSIONS} AND {FINITE_SQL})""",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM q QUALIFY c < {centroids.CLUSTERS})"]
    for k in range(centroids.ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(q.v) AS v, min(struct_pack(d := list_sum(list_transform(list_zip(q.v, c{k}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := c)) AS best FROM q CROSS JOIN c{k} GROUP BY r)")
        steps.append(f"s{k} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{k}) GROUP BY c, j)")
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{k} o LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM s{k} GROUP BY c) m USING (c))")
    last = centroids.ROUNDS
    return f"""WITH {", ".join(steps[:-2])}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{last} JOIN c{last} c ON c.c = best.c"""


ORACLES: dict[str, str] = {
    "op5_warc_segments": """WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages), w AS (SELECT digest, max(page_id) AS last FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to, 'ok' AS status FROM d LEFT JOIN w USING (digest)""",
    "op8_jaccard_join": rf"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
class AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(b), d.doc_id)) AS class_id FROM documents d LEFT JOIN l ON a = d.doc_id AND same GROUP BY d.doc_id),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
linked AS (SELECT a, count(DISTINCT class_id) AS n FROM l JOIN class ON class.doc_id = b WHERE NOT same GROUP BY a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id, any_value(class_id) AS class_id, CAST(coalesce(any_value(linked.n), 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id LEFT JOIN class USING (doc_id) LEFT JOIN linked ON linked.a = d.doc_id GROUP BY d.doc_id""",
    "op9_url_rules": rf"""WITH rules(verdict, host, path, rule) AS (VALUES {RULES_SQL}), u AS (SELECT page_id, coalesce(lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, any_value(u.host) AS host, any_value(u.path) AS path, max_by(rule, length(rule)) AS rule, coalesce(max_by(verdict, length(rule)), 'allow') AS verdict FROM u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY page_id""",
    "op10_line_quality": rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS_SQL.format("coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) AS x FROM d WHERE len(w) >= 8),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(8) t(k) GROUP BY doc_id),
lines AS (SELECT DISTINCT source, text, unnest(l) AS raw, unnest(range(len(l))) AS at FROM d),
normal AS (SELECT source, text, trim(regexp_replace(lower(raw), '[0-9\x20\x09-\x0D]+', ' ', 'g')) AS line, len({WORDS_SQL.format('raw')}) AS words FROM lines),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM d GROUP BY source),
often AS (SELECT source, line FROM normal JOIN hosts USING (source) GROUP BY source, line, n HAVING count(DISTINCT text) > {quality.LINE_DOCUMENTS} AND count(DISTINCT text) > CAST({quality.LINE_SHARE} AS DOUBLE) * n),
removed AS (SELECT source, text, sum(words) AS n FROM normal SEMI JOIN often USING (source, line) GROUP BY source, text),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(w) - coalesce(r.n, 0) AS BIGINT) AS words_left FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN removed r USING (source, text)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND 100 * words_left >= 30 * n_words AS kept FROM judged""",
    "op11_weighted_lloyd": _lloyd_sql(),
    "op13_va_negatives": f"""WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({negatives.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND {FINITE_SQL}),
p AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positive AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score FROM positive JOIN p USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM ranked WHERE rank <= 10""",
}
