"""Shared helpers of the training-data operators: tables, shared folder, hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the operators' contracts name it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is what the cluster names in ``spark.checkpoint.dir``. Only where that is unset and all runs on one machine
    (tests), a temporary folder is made, set for the session and removed at exit; a cluster without one is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
        path = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def unused(name: str, columns: list[str]) -> str:
    """``name``, marked until no column has it; names are compared without case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back.

    It cuts the lineage: a lost executor costs a re-read of this table, never a rerun of what made it,
    and what a task drew (block numbers, partition numbers) is fixed once its files are committed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files behind a table that ``stored`` made and nothing will read again."""
    jvm = df.sparkSession._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def slices(batches, max_rows: int = 512, max_bytes: int = 4 << 20, size_of: str = "text"):
    """Arrow batches cut so that ``size_of`` holds about ``max_bytes`` in each; one row at least."""
    for batch in batches:
        n, start = batch.num_rows, 0
        if not n:
            continue
        k = batch.schema.get_field_index(size_of)
        per_row = max(1, batch.column(k).nbytes // n) if k >= 0 else 1
        step = int(max(1, min(max_rows, max_bytes // per_row)))
        while start < n:
            yield batch.slice(start, step)
            start += step


def released() -> None:
    """Gives freed memory of a Python worker back to the system; workers live on and serve later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL("libc.so.6").malloc_trim(0)
