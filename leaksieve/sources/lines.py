"""Texts to a relation of numbered lines: unit_id, file, ext, line_no, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, is_excluded, split_lines

ALLOW, SKIP_FILE = "leaksieve:allow", "leaksieve:skip-file"
# What is passed over where no settings say otherwise.
EXCLUDE_DIRS, EXCLUDE_FILES = ("node_modules", ".git", "dist", "build", "__pycache__", ".venv", "target"), ("*.lock", "*.min.js", "*.map")


def spread(source: DataFrame) -> DataFrame:
    """A source of fewer partitions than there are cores, dealt out over them: one small file is else one task."""
    cores = source.sparkSession.sparkContext.defaultParallelism
    return source.repartition(cores) if source.rdd.getNumPartitions() < cores else source


def snippets(docs: DataFrame, text_col: str, unit: Column, ext: str = "", file: Column | None = None) -> DataFrame:
    """unit_id, file, ext, text: each row's text as one unit, whole."""
    return docs.select(unit.cast("string").alias("unit_id"), (file if file is not None else F.lit(None).cast("string")).alias("file"), F.lit(ext).alias("ext"), F.coalesce(text_col, F.lit("")).alias("text"))


def snippet_lines(docs: DataFrame, text_col: str, unit: Column, ext: str = "", file: Column | None = None) -> DataFrame:
    """Lines of each row's text as one unit. Markers aren't looked at."""
    lines = docs.select(unit.cast("string").alias("unit_id"), (file if file is not None else F.lit(None).cast("string")).alias("file"), F.posexplode(split_lines(F.col(text_col))))
    return lines.select("unit_id", "file", F.lit(ext).alias("ext"), (F.col("pos") + 1).alias("line_no"), F.col("col").alias("text"))


def file_lines(files: DataFrame, exclude_dirs=EXCLUDE_DIRS, exclude_files=EXCLUDE_FILES, unit: str = "tree") -> DataFrame:
    """Lines of ``path, text`` rows: excluded paths and files with the skip marker are left out, lines with the allow marker too."""
    kept = files.where(~is_excluded(F.col("path"), exclude_dirs, exclude_files) & ~F.col("text").contains(SKIP_FILE))
    lines = kept.select(F.col("path").alias("file"), F.posexplode(split_lines(F.col("text"))))
    return lines.where(~F.col("col").contains(ALLOW)).select(
        F.lit(unit).alias("unit_id"), "file", extension(F.col("file")).alias("ext"), (F.col("pos") + 1).alias("line_no"), F.col("col").alias("text")
    )


def without_ignored(files: DataFrame, ignored: DataFrame) -> DataFrame:
    """``files`` without the paths of ``ignored`` (path), however they're written."""
    from ..functions.text import normalised_path

    names = ignored.select(normalised_path(F.col("path")).alias("_n")).distinct()
    return files.withColumn("_n", normalised_path(F.col("path"))).join(names, "_n", "left_anti").drop("_n")


SAMPLE = "code string, label string, category string, _bad string"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """A labelled corpus of JSON lines: id, code, label, category, and usable (whether it parsed and has a known label)."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    parsed = rows.select(F.from_json("value", SAMPLE, {"columnNameOfCorruptRecord": "_bad"}).alias("x"), F.xxhash64("value").cast("string").alias("id")).select("id", "x.*")
    label = F.lower("label")
    usable = F.col("_bad").isNull() & F.col("code").isNotNull() & label.isin("leak", "clean")
    return parsed.select("id", "code", label.alias("label"), "category", F.coalesce(usable, F.lit(False)).alias("usable"))
