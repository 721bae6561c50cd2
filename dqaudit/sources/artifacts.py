"""Outputs of extraction tools: <root>/<sample id>/<tool>.txt or .md."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqaudit.functions.text import py_strip
from dqaudit.sources.annotations import _whole

TOOLS = "sample_key string, tool string, text string"


def tool_rows(files: DataFrame) -> DataFrame:
    """(sample_key, tool, text) of files (sample_key, file_name, text): without index.md, stems that begin with ground_truth, and blank
    files; words hyphenated at line ends are joined; of <tool>.md and <tool>.txt the latter counts."""
    name = F.col("file_name")
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    own = files.where(name.rlike(r"\.(?:txt|md)$") & (name != "index.md") & ~stem.startswith("ground_truth")).where(py_strip(F.col("text")) != "")
    own = own.groupBy("sample_key", stem.alias("tool")).agg(F.max_by("text", "file_name").alias("text"))
    return own.withColumn("text", F.replace(F.col("text"), F.lit("-\n"), F.lit("")))


def load_tools(spark: SparkSession, root: str) -> DataFrame:
    files = [str(p.resolve()) for p in Path(root).glob("*/*") if p.suffix in (".txt", ".md") and p.is_file()]
    if not files:
        return spark.createDataFrame([], TOOLS)
    parts = F.split("path", "/")
    return tool_rows(_whole(spark, files).select(F.element_at(parts, -2).alias("sample_key"), F.element_at(parts, -1).alias("file_name"), "text"))


def attach(records: DataFrame, sample_id: str, root: str) -> DataFrame:
    """Adds __artifacts_dir__ where <root>/<sample id> is a folder."""
    names = [(p.name, str(p)) for p in Path(root).iterdir() if p.is_dir()]
    at = records.sparkSession.createDataFrame(names, "__key string, __artifacts_dir__ string")
    return records.join(F.broadcast(at) if len(names) <= 100_000 else at, F.col(sample_id).cast("string") == F.col("__key"), "left").drop("__key")


def attached(records: DataFrame) -> DataFrame:
    """attached, total."""
    return records.agg(F.count("__artifacts_dir__").alias("attached"), F.count("*").alias("total"))
