"""Sends this package to the executors, which need not have it installed, and bounds what a worker gets at once."""

from __future__ import annotations

import atexit
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the Python files of the application, once for each."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    with tempfile.NamedTemporaryFile(prefix="pagerefine-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for path in sorted(_PACKAGE.rglob("*.py")):
            z.write(path, str(Path(_PACKAGE.name) / path.relative_to(_PACKAGE)))
    context.addPyFile(f.name)
    atexit.register(Path(f.name).unlink, missing_ok=True)  # served from there as long as the driver runs
    _sent.add(context.applicationId)


#: Rows and bytes of an Arrow batch on its way to a worker; bound what the JVM and the worker hold of long texts.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to these, where they are higher."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
