"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space and U+0009 to U+000D.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str | Column) -> Column:
    """The text itself, with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.array_remove(F.split(text, WHITE_SPACE, -1), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a local one is set for a local master only."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="leaksieve-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's ``options``, and read it back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*stages: DataFrame) -> None:
    """Delete what ``stage`` wrote, where nothing reads it any more."""
    for df in stages:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def column(name: str) -> Column:
    """The column of just this name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(df: DataFrame, name: str = "rest") -> Column:
    """All of a row's columns as one, so that columns added beside it can't clash with any; ``rest.*`` brings them back."""
    return F.struct(*(column(c) for c in df.columns)).alias(name)


def kept(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, over its tasks. A worker keeps one at a time."""
    name = f"_leaksieve_{name}"
    for other in [m for m in sys.modules if m.startswith("_leaksieve_") and m != name]:
        del sys.modules[other]
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def give_back() -> None:
    """Return freed memory to the system: Python workers live on after a task, and so would its peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, small enough to hold what comes of them. What other operators kept goes first."""
    if keep is None:
        kept("nothing")
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)
    give_back()
