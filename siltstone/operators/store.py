"""The chunk store: a table partitioned by role, so that a search of one role reads only its files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "chunk_id string, content string, role_confidence bigint, block_id string, source_file string, breadcrumb array<string>, heading_path string, start_line bigint, end_line bigint, token_estimate bigint, tagged_by string, embedding array<float>, role string"


def ensure(spark: SparkSession, name: str, schema: str = SCHEMA, path: str | None = None) -> bool:
    """Creates the table, in a folder of its own if named, unless it is there; whether it did."""
    if spark.catalog.tableExists(name):
        return False
    writer = spark.createDataFrame([], schema).write.partitionBy("role").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return True


def drop(spark: SparkSession, name: str) -> None:
    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", {"name": name})


def insert(rows: DataFrame, name: str) -> int:
    """Appends rows (columns by name; arrays stay arrays) and returns how many, counted as they are written."""
    counted = Observation("inserted")
    columns = rows.sparkSession.table(name).columns
    rows.select(*columns).observe(counted, F.count(F.lit(1)).alias("n")).write.insertInto(name)
    return counted.get["n"]


def scan(spark: SparkSession, name: str, where: dict[str, object] | None = None, columns: Iterable[str] = ("*",), limit: int | None = None) -> DataFrame:
    """Rows whose columns equal a value or are in a list of values. Values are literals of the plan, never parts of a text of SQL; role prunes partitions."""
    out = spark.table(name)
    for column, value in (where or {}).items():
        out = out.where(F.col(column).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(column).eqNullSafe(F.lit(value)))
    out = out.select(*columns)
    return out if limit is None else out.limit(limit)


def count(spark: SparkSession, name: str) -> int:
    return spark.table(name).count() if spark.catalog.tableExists(name) else 0


def with_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vectors (chunk_id, embedding); a chunk without one fails the write."""
    joined = chunks.join(vectors.select("chunk_id", "embedding"), "chunk_id", "left")
    return joined.withColumn("embedding", F.when(F.col("embedding").isNull(), F.raise_error(F.concat(F.lit("no vector for "), "chunk_id"))).otherwise(F.col("embedding")).cast("array<float>"))
