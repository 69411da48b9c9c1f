"""An index of postings that lives in the store: inserts extend it, and a search reads the terms of its queries and scores only groups of chunks that can still be among the best."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..staging import discard, small, stage
from .search import terms, top

#: Folders that terms are dealt to: a search doesn't list or open those that it doesn't ask for.
BUCKETS = 64
#: Chunks of a group, about; a row holds what one term has in one group.
GROUP = 128
#: Groups that a task counts and lists at most, about.
GROUPS_A_TASK = 16
#: Groups whose rows of a bucket go into one file.
GROUPS_A_FILE = 1 << 16
#: Up to so many terms of a batch are named in the scan, so that Parquet skips row groups without them.
NAMED_TERMS = 2000
#: What sums of parts in another order may differ by.
SLACK = 1e-6


def create(spark: SparkSession, name: str, path: str | None = None, id_type: str = "string") -> None:
    """Two tables, unless they are there: name_postings has a row for each term, role and group of chunks; name_inserts a row for each insert that counts."""
    tables = {
        "postings": (f"term string, insert string, role string, chunks bigint, n bigint, most_tf bigint, least_dl bigint, ids array<{id_type}>, tfs array<bigint>, dls array<bigint>, bucket int", ["bucket"]),
        "inserts": ("key string, insert string, n bigint, total bigint", []),
    }
    for kind, (schema, by) in tables.items():
        if not spark.catalog.tableExists(f"{name}_{kind}"):
            writer = spark.createDataFrame([], schema).write.partitionBy(*by).format("parquet")
            (writer.option("path", f"{path}/{kind}") if path else writer).saveAsTable(f"{name}_{kind}")


def drop(spark: SparkSession, name: str) -> None:
    for kind in ("postings", "inserts"):
        spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", {"name": f"{name}_{kind}"})


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def grouped(docs: DataFrame, groups: int) -> DataFrame:
    """term, role, chunks, n, most_tf, least_dl, ids, tfs, dls of chunks (chunk_id, text, role): the postings of a term in a role and a group of chunks (chunks: the group's number).

    Groups are dealt by a hash of the chunk, so that a stop word has as many rows as there are groups and no task gets all of
    its postings. The largest frequency and the shortest text bound what the group's chunks can get from the term, whatever
    the collection's average length becomes.

    Texts move once, to the task of their group, which counts and lists all that the group has: occurrences and counts, which
    are many times as much, aren't shuffled. There are as many tasks as keep a task's groups bounded."""
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(min(usual, groups), -(-groups // GROUPS_A_TASK))
    dealt = docs.select("chunk_id", F.coalesce("role", F.lit("")).alias("role"), "text", F.pmod(F.xxhash64("chunk_id"), F.lit(groups)).alias("chunks")).repartition(tasks, "chunks")
    tokens = dealt.select("chunk_id", "role", "chunks", terms(F.col("text")).alias("tokens"))
    each = tokens.select("chunk_id", "role", "chunks", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
    counted = each.groupBy("chunks", "term", "role", "chunk_id", "dl").agg(F.count("*").alias("tf"))
    rows = F.array_sort(F.collect_list(F.struct("chunk_id", "tf", "dl")))
    one = counted.groupBy("chunks", "term", "role").agg(F.count("*").alias("n"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"), rows.alias("rows"))
    return one.select("term", "role", "chunks", "n", "most_tf", "least_dl", F.col("rows.chunk_id").alias("ids"), F.col("rows.tf").alias("tfs"), F.col("rows.dl").alias("dls"))


def insert(docs: DataFrame, name: str, key: str | None = None) -> str:
    """Adds chunks (chunk_id, text, role) and returns the insert's key.

    The postings are written first and the row that makes them count last: searches see all of an insert or nothing. An insert
    that broke off is done again under its key; what the broken one left is never read, and a key counts once. Chunk ids must
    be new: what changes is another chunk."""
    spark = docs.sparkSession
    key = key or uuid.uuid4().hex
    if spark.table(f"{name}_inserts").where(F.col("key") == key).limit(1).count():
        return key
    attempt = uuid.uuid4().hex
    n = docs.count()
    rows = grouped(docs, max(1, -(-n // GROUP))).withColumn("insert", F.lit(attempt)).withColumn("bucket", bucket(F.col("term")))
    placed = rows.repartition("bucket", F.floor(F.col("chunks") / GROUPS_A_FILE)).sortWithinPartitions("bucket", "term", "role")
    placed.select(*spark.table(f"{name}_postings").columns).write.insertInto(f"{name}_postings")
    # all occurrences are in the lists: no text is taken apart a second time for their number
    own = F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)
    total = spark.table(f"{name}_postings").where(F.col("insert") == attempt).agg(F.coalesce(F.sum(own), F.lit(0))).first()[0]
    spark.createDataFrame([(key, attempt, n, total)], "key string, insert string, n bigint, total bigint").write.insertInto(f"{name}_inserts")
    return key


def inserts(spark: SparkSession, name: str) -> DataFrame:
    """insert, n, total of the inserts that count, each key once."""
    return spark.table(f"{name}_inserts").groupBy("key").agg(F.min_by(F.struct("insert", "n", "total"), "insert").alias("x")).select("x.*")


def _wanted(postings: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of the batch's terms: other buckets aren't opened, and row groups without its terms are skipped where they are few enough to name. At most BUCKETS numbers and NAMED_TERMS terms get to the driver."""
    numbers = [row.b for row in words.select(bucket(F.col("term")).alias("b")).distinct().collect()]
    out = postings.where(F.col("bucket").isin(*numbers)) if numbers else postings.where("false")
    named = [row.term for row in words.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
    if len(named) <= NAMED_TERMS:
        return out.where(F.col("term").isin(*named)) if named else out
    return out.join(small(words.select("term").distinct()), "term", "left_semi")


def search(queries: DataFrame, name: str, k: int, settings: Settings = DEFAULT, asked: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, role, score, rank: the k best chunks by BM25, of each query, or with asked (query_id, role) of each of its roles. The rows are those of search.bm25 over all inserted texts.

    The terms' rows without their lists give document counts, and for each query and group of chunks the most that one of its
    chunks can score. The groups with the highest bounds, k of them, are scored first; the k-th best score there is a score
    that the best have at least, and of the other groups only those whose bound reaches it are scored. Nothing is left out
    that could be among the best, ties included."""
    spark, k1, b = queries.sparkSession, settings.bm25_k1, settings.bm25_b
    words = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    counted = small(inserts(spark, name))
    rows = _wanted(spark.table(f"{name}_postings"), words).join(counted.select("insert"), "insert", "left_semi")
    heads = stage(rows.select("term", "role", "insert", "chunks", "n", "most_tf", "least_dl"), "heads")
    sizes = counted.agg(F.sum("n").alias("all"), (F.sum("total") / F.sum("n")).alias("avgdl"))
    weights = heads.groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(sizes))
    weights = weights.select("term", "avgdl", F.log(1 + (F.col("all") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    wanted, on, by = words.join(weights, "term"), ["term"], ["query_id"]
    if asked is not None:
        wanted, on, by = wanted.join(small(asked.select("query_id", "role")), "query_id"), ["term", "role"], ["query_id", "role"]
    wanted = small(stage(wanted, "wanted"))
    part = lambda tf, dl: F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))
    place = ["query_id", "role", "insert", "chunks"]
    bounds = heads.join(wanted, on).groupBy(*place).agg(F.sum(part(F.col("most_tf"), F.col("least_dl"))).alias("bound"))
    ranked = stage(bounds.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("bound"), "insert", "chunks", "role"))), "bounds")
    discard(heads)

    def scored(chosen: DataFrame) -> DataFrame:
        lists = rows.join(wanted, on).join(small(chosen.select(*place)), place)
        each = lists.select("query_id", "role", "idf", "avgdl", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("x"))
        return each.groupBy("query_id", F.col("x.ids").alias("chunk_id"), "role").agg(F.sum(part(F.col("x.tfs"), F.col("x.dls"))).alias("score"))

    first = stage(scored(ranked.where(F.col("place") <= k)), "scored")
    least = stage(top(first, k, by, "score", "rank", "chunk_id").groupBy(*by).agg(F.when(F.count("*") == k, F.min("score")).alias("least")), "least")
    rest = ranked.where(F.col("place") > k).join(small(least), by, "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
    rest = stage(rest.select(*place), "rest")
    discard(ranked, least)
    both = first.unionByName(scored(rest)).withColumn("score", F.round("score", 9))
    return top(both, k, by, "score", "rank", "chunk_id").select("query_id", "chunk_id", "role", "score", "rank")
