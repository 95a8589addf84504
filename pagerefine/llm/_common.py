"""Helpers shared by the training-data operators: shared-folder tables and Arrow row streams."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagerefine.functions.shipping import ship, small_batches

#: Rows that one Python step turns into an output batch; bounds a worker's memory with long texts.
ROWS_PER_STEP = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session, whose executors are the driver itself, gets a folder of its own; on a cluster
    that would be a machine's own disk, so it is an error there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="pagerefine-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: A table of at most so many rows and bytes of Parquet is broadcast; a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 250_000, 4 << 20


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df below the shared folder and read it back: cuts the lineage, survives lost executors.

    The tasks that compute df write its files, as many as there are; where the number of rows is known, at most one
    for each half million, so that the rounds over a small table don't make thousands. Spark removes the shuffle files
    of what was written only once the driver's collector finds them unused, so that is asked for after a large table.
    """
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    (df if rows is None else df.coalesce(1 + rows // 500_000)).write.parquet(path)
    if rows is None:
        spark._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables of which nothing is read again: all that was made of them is stored itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, to be broadcast if its rows, counted from Parquet footers, and its files' bytes are few enough."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= BROADCAST_BYTES and df.count() <= most else df


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow, with this package on the executors, in small batches."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches):
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system; an idle worker would keep it beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def steps(batches: Iterator[pa.RecordBatch], rows: int = ROWS_PER_STEP) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of at most `rows` rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def binary(column: pa.Array) -> list:
    """The UTF-8 bytes of a string column, None for nulls; nothing is decoded."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def ascii_lower(text):
    """Lower-case A-Z alone, unlike lower(), which changes other letters too and so is for texts of ASCII, where it is faster."""
    mapped = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(mapped)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
