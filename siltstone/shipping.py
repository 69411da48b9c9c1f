"""Makes the package importable in Python workers, wherever the driver was started from."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import SparkSession

_shipped: weakref.WeakSet[SparkContext] = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the workers once for each application, by Spark's own file server."""
    context = spark.sparkContext
    if context in _shipped:
        return
    package = Path(__file__).resolve().parent
    # on the driver only, which serves it to the executors until it ends
    folder = tempfile.mkdtemp(prefix="siltstone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    bundle = Path(folder) / "siltstone.zip"
    with zipfile.ZipFile(bundle, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent).as_posix())
    context.addPyFile(str(bundle))
    _shipped.add(context)
