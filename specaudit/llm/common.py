"""Helpers shared by the corpus operators: shared storage, ASCII folding, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import string
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handed to one vectorised step of a Python worker, in bytes.
SLICE_BYTES = 16 << 20
#: Size of an Arrow batch sent to a Python worker, so that long texts do not fill its memory.
BATCH_BYTES = "16m"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is ``spark.checkpoint.dir``. Only a local-mode session that has none gets a temporary one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="corpus-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    atexit.register(lambda: __import__("shutil").rmtree(own.removeprefix("file://"), ignore_errors=True))
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialise` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            with contextlib.suppress(Exception):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans, which it does when the driver collects them as garbage."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch (rows alone say nothing about memory when texts are long), and let Python
    workers import this package from where the driver has it."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def text_of(docs: DataFrame) -> Column:
    """The text, empty for null."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def row_key(docs: DataFrame) -> Column:
    """128 bits that stand for a row's id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit("")), F.lit("\x1f"), text_of(docs))))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts come to about max_bytes each; a row is never cut.

    Runs are copies: some string kernels of the Arrow library misread arrays that start inside another's buffer.
    """
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    groups = np.cumsum(sizes, dtype=np.int64) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch if b - a == batch.num_rows else batch.take(pa.array(range(a, b)))
