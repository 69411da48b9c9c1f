"""Tables between the steps of a plan, in the folder that the cluster shares."""

from __future__ import annotations

import gc
import re
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where nothing is named and all runs in one process (tests).
LOCAL_SCRATCH = "/tmp/checkpoints/siltstone"

#: A side of a join is broadcast only when its measured size is below this; otherwise the join shuffles.
BROADCAST_BYTES = 16 << 20

_STAGED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one only where driver and tasks are one process. Without a shared folder a cluster can't go on: tasks would read files that others wrote to their own disks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^]]*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_SCRATCH).rstrip("/") + "/siltstone"


def stage(df: DataFrame, tag: str, release: bool = False) -> DataFrame:
    """Cuts the lineage: writes a table into the shared folder and reads it back.

    Lost executors cost only the tasks that were running; what is written stays until it is discarded. With release, Spark is
    led to drop the shuffle files behind it at once (it does so when their plans are collected as garbage)."""
    path = f"{scratch(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = getattr(df.sparkSession, "_jvm", None)
    if release and jvm is not None:
        gc.collect()
        jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _STAGED[out] = path
    return out


def staged(df: DataFrame, tag: str) -> DataFrame:
    """The table if it is staged already, else its staged form."""
    return df if df in _STAGED else stage(df, tag)


def discard(*staged: DataFrame) -> None:
    """Empties staged tables that nothing will read again: what was built on them must be staged itself."""
    for df in staged:
        if path := _STAGED.pop(df, None):
            df.sparkSession.range(0).write.mode("overwrite").parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes all staged tables. For the end of an application: frames that were built on them can't be read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _width(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
        return 8 * F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0)) + 24
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return 2 * F.octet_length(F.to_json(F.struct(name))) + 32
    return F.lit(8)


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows as Spark holds them, about, by a pass over them."""
    total = F.sum(sum((_width(f"`{f.name}`", f.dataType) for f in df.schema), F.lit(24)).cast("long"))
    return df.agg(total).first()[0] or 0


def small(df: DataFrame) -> DataFrame:
    """Marks a side for broadcasting if its measured bytes, twice for the hash table, stay below the bound."""
    return F.broadcast(df) if 2 * measured_bytes(df) <= BROADCAST_BYTES else df
