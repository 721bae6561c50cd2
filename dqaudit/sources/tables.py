"""Tables on disk: Parquet, JSON lines, CSV and text, by path or by format; and the catalog of what is there."""

from __future__ import annotations

import importlib.util
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqaudit.plans.fields import with_index

FORMATS = {".parquet": "parquet", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".csv": "csv", ".tsv": "csv", ".orc": "orc", ".txt": "text"}
SPLITS = ("train", "test", "validation", "valid", "val", "dev")
_split = re.compile(r"(?:^|[/_.-])(" + "|".join(SPLITS) + r")(?=$|[/_.-])")


def format_of(path: str) -> str:
    """By suffix; of a folder by the first data file in it."""
    names = [path] if os.path.isfile(path) else [str(p) for p in sorted(Path(path).rglob("*")) if p.suffix in FORMATS]
    for n in [path, *names]:
        if Path(n).suffix in FORMATS:
            return FORMATS[Path(n).suffix]
    raise ValueError(f"no data files in {path}")


def load_table(spark: SparkSession, path: str, split: str | None = None, config: str | None = None, limit: int | None = None, format: str | None = None) -> DataFrame:
    """A dataset on disk with sample_index in the order of files and rows; config and split are folders below the path, a split may also be
    the beginning of file names.  limit keeps the first rows.  Image columns stay undecoded structs."""
    at = path
    for part in (config, split):
        if part and os.path.isdir(os.path.join(at, part)):
            at = os.path.join(at, part)
    kind = format or format_of(at)
    reader = spark.read
    if kind == "csv":
        reader = reader.options(header=True, inferSchema=True, multiLine=True, escape='"', sep="\t" if at.endswith(".tsv") else ",")
    if split and os.path.isdir(at) and not at.rstrip("/").endswith(split) and any(p.name.startswith(split) for p in Path(at).rglob("*")):
        reader = reader.option("pathGlobFilter", f"{split}*").option("recursiveFileLookup", True)
    elif os.path.isdir(at) and not any(p.suffix in FORMATS or "=" in p.name for p in Path(at).iterdir()):
        reader = reader.option("recursiveFileLookup", True)  # its data lies in folders that aren't partitions
    df = with_index(reader.format(kind).load(at))
    return spread(df if limit is None else df.where(F.col("sample_index") < limit))


#: Bytes of a table for each of the session's cores below which it is dealt out anew.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it is so small that its files' splits would leave most of them idle; larger tables stay as they are split."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL else df


def source_type(spec: str) -> str:
    """local (a folder of annotations), task (name@function, or an importable package's task) or tables."""
    if os.path.isdir(spec):
        return "local" if any(Path(spec).glob("*.json")) and not any(Path(spec).glob("*.parquet")) else "tables"
    if os.path.exists(spec):
        return "tables"
    head = spec.split("/")[0]
    if "@" in spec or (re.fullmatch(r"[A-Za-z_]\w*", head) and "/" in spec and importlib.util.find_spec(head) is not None):
        return "task"
    return "tables"


def splits_of(paths: list[str]) -> list[str]:
    """Splits that paths of data files name."""
    return sorted({m[1] for p in paths for m in _split.finditer(p)})


def configs_of(paths: list[str]) -> list[str]:
    """Folders above the data files that aren't splits."""
    return sorted({parts[-2] for p in paths if len(parts := p.strip("/").split("/")) > 1 and parts[-2] not in (*SPLITS, "data")})


_seen: dict[tuple[str, int, float], dict] = {}


def describe(path: str) -> dict:
    """Size, splits and configs of a dataset folder, kept by (path, size, time of change)."""
    files = [p for p in sorted(Path(path).rglob("*")) if p.suffix in FORMATS]
    size, changed = sum(p.stat().st_size for p in files), max((p.stat().st_mtime for p in files), default=0.0)
    key = (path, size, changed)
    if key not in _seen:
        names = [str(p.relative_to(path)) for p in files]
        _seen[key] = {"name": Path(path).name, "size": size, "files": len(files), "splits": splits_of(names), "configs": configs_of(names)}
    return _seen[key]


def list_datasets(spark: SparkSession, root: str, like: str | None = None) -> DataFrame:
    """name, size, files, splits, configs of the folders and files below root that hold data; like: part of the name in any case."""
    found = [describe(str(p)) if p.is_dir() else {"name": p.name, "size": p.stat().st_size, "files": 1, "splits": splits_of([p.name]), "configs": []} for p in sorted(Path(root).iterdir()) if (p.is_dir() and any(x.suffix in FORMATS for x in p.rglob("*"))) or p.suffix in FORMATS]
    df = spark.createDataFrame([tuple(d[k] for k in ("name", "size", "files", "splits", "configs")) for d in found], "name string, size bigint, files int, splits array<string>, configs array<string>")
    return df.where(F.contains(F.lower("name"), F.lower(F.lit(like)))) if like else df
