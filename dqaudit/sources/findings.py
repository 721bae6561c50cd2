"""Findings that a scan saved."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqaudit.model import FINDING

RESERVED = ("scan_summary.json", "samples.json", "triage.json")


def scan_dirs(paths: list[str]) -> list[str]:
    """A folder with scan_summary.json is one scan, else its direct subfolders with one are."""
    out: list[str] = []
    for p in map(Path, paths):
        out += [str(p)] if (p / "scan_summary.json").exists() else [str(c) for c in sorted(p.iterdir()) if (c / "scan_summary.json").exists()]
    return out


def load_findings(spark: SparkSession, folder: str) -> DataFrame:
    """The envelope with id: the running number over the files in the order of their names."""
    files = [str(p) for p in sorted(Path(folder).glob("*.json")) if p.name not in RESERVED]
    kind = "array<struct<id:bigint,scanner:string,severity:string,category:string,explanation:string,sample_index:bigint,sample_id:string,line:int,metadata:string>>"
    if not files:
        return spark.createDataFrame([], FINDING + ", id bigint")
    raw = spark.read.text(files, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.from_json("value", kind).alias("r"))
    raw = raw.withColumn("r", F.coalesce("r", F.raise_error(F.concat("file", F.lit(" is not a list of findings"))).cast(kind)))
    sizes = raw.select("file", F.size("r").alias("n"))
    from pyspark.sql import Window as W

    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    out = raw.join(before, "file").select("before", F.posexplode("r").alias("at", "f"))
    return out.select("f.scanner", "f.severity", "f.category", "f.explanation", "f.sample_index", "f.sample_id", "f.line", "f.metadata", F.coalesce("f.id", F.col("before") + F.col("at")).alias("id"))


def load_summary(folder: str) -> dict:
    return json.loads((Path(folder) / "scan_summary.json").read_text())
