"""Ingest that follows its sources: new and changed ones replace their rows, deleted ones take theirs along, and readers see one version of all tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files
from ..staging import discard, small, stage

SOURCE = "source_file string, stamp string, since bigint"
VERSION = "version bigint"

#: Up to so many changed files are named in the scan, so that the others aren't opened.
NAMED_FILES = 2000

Work = Callable[[DataFrame], dict[str, DataFrame]]


def latest(spark: SparkSession, target: str) -> int:
    """The version that readers see; 0 before the first. Versions count once their row is there, which is written last."""
    spark.createDataFrame([], VERSION).write.mode("ignore").parquet(f"{target}/versions")
    return spark.read.schema(VERSION).parquet(f"{target}/versions").agg(F.max("version")).first()[0] or 0


def _sources(spark: SparkSession, target: str, version: int) -> DataFrame:
    return spark.read.schema(SOURCE).parquet(f"{target}/sources/version={version}") if version else spark.createDataFrame([], SOURCE)


def sources(spark: SparkSession, target: str) -> DataFrame:
    """source_file, stamp, since (the version that its rows are from) of what is in the latest version."""
    return _sources(spark, target, latest(spark, target))


def _commit(spark: SparkSession, target: str, version: int, rows: dict[str, DataFrame], listed: DataFrame) -> int:
    """Tables, then the list of sources, then the row that makes the version count. What a run that was cut off has left is overwritten."""
    for name, frame in rows.items():
        frame.write.mode("overwrite").parquet(f"{target}/tables/{name}/version={version}")
    listed.write.mode("overwrite").parquet(f"{target}/sources/version={version}")
    spark.createDataFrame([(version,)], VERSION).coalesce(1).write.mode("append").parquet(f"{target}/versions")
    return version


def sync(seen: DataFrame, load: Callable[[DataFrame], DataFrame], work: Work, target: str) -> int:
    """Brings the tables under target up to the sources seen (source_file, stamp) and returns the version, the same if nothing is new.

    load gives the documents (source_file, text) of some sources (source_file), of which only new ones and those with another
    stamp are asked for; work turns documents into tables by name, whose rows keep their source_file. Null names are left out,
    of equal ones the greatest stamp counts, null stamps are empty. Only what changed is worked on; the list of all sources is
    written anew. One writer at a time; a run that was cut off changes nothing that readers see and can be repeated."""
    spark = seen.sparkSession
    last = latest(spark, target)
    now = stage(seen.where("source_file is not null").groupBy("source_file").agg(F.coalesce(F.max("stamp"), F.lit("")).alias("stamp")), "seen")
    before = _sources(spark, target, last)
    old = before.select("source_file", F.col("stamp").alias("known"), "since")
    listed = stage(now.join(old, "source_file", "left").withColumn("same", F.col("stamp").eqNullSafe(F.col("known"))), "listed")
    changed = listed.where("not same").select("source_file")
    if last and changed.isEmpty() and before.join(now, "source_file", "left_anti").isEmpty():
        discard(now, listed)
        return last
    version = last + 1
    since = F.when(F.col("same"), F.col("since")).otherwise(F.lit(version)).cast("long")
    _commit(spark, target, version, work(load(changed)), listed.select("source_file", "stamp", since.alias("since")))
    discard(now, listed)
    return version


def table(spark: SparkSession, target: str, name: str) -> DataFrame:
    """The rows of a table in the latest version, with since. Folders of versions that no source is from aren't opened."""
    listed = sources(spark, target)
    alive = [r.since for r in listed.select("since").distinct().collect()]
    rows = spark.read.parquet(f"{target}/tables/{name}").withColumn("since", F.col("version").cast("long")).where(F.col("version").isin(alive)).drop("version")
    return rows.join(small(listed.select("source_file", "since")), ["source_file", "since"], "left_semi")


def compact(spark: SparkSession, target: str, names: tuple[str, ...]) -> int:
    """Writes the rows of all tables as one new version, so that none is spread over many folders, and empties the folders of older ones: readers that began before must be done."""
    last = latest(spark, target)
    if not last:
        return 0
    old = [r.version for r in spark.read.schema(VERSION).parquet(f"{target}/versions").distinct().collect()]
    listed = _sources(spark, target, last).withColumn("since", F.lit(last + 1).cast("long"))
    version = _commit(spark, target, last + 1, {name: table(spark, target, name).drop("since") for name in names}, listed)
    for gone in old:
        for name in names:
            path = f"{target}/tables/{name}/version={gone}"
            spark.createDataFrame([], table(spark, target, name).drop("since").schema).write.mode("overwrite").parquet(path)
    return version


def stamps(spark: SparkSession, folder: str) -> DataFrame:
    """source_file, stamp of the Markdown files of a folder: when they were changed and their size. Contents aren't read; a change that keeps both isn't seen."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    return found.select(F.col("_metadata.file_name").alias("source_file"), F.concat_ws(" ", F.unix_millis("modificationTime"), "length").alias("stamp"))


def sync_folder(spark: SparkSession, folder: str, work: Work, target: str) -> int:
    """sync for the Markdown files of a folder."""

    def load(changed: DataFrame) -> DataFrame:
        docs = files.markdown(spark, folder)
        named = [r.source_file for r in changed.limit(NAMED_FILES + 1).collect()]
        if len(named) <= NAMED_FILES:
            return docs.where(F.col("source_file").isin(named))
        return docs.join(small(changed), "source_file", "left_semi")

    return sync(stamps(spark, folder), load, work, target)


def follow(spark: SparkSession, folder: str, work: Work, target: str, checkpoint: str, every: str = "1 minute") -> StreamingQuery:
    """Syncs a folder again and again: a stream that only keeps time. What a restart finds undone is done by the next sync, which compares with the latest version."""

    def tick(batch: DataFrame, number: int) -> None:
        sync_folder(spark, folder, work, target)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
