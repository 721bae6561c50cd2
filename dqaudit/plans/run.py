"""A scan: canonical records once, all scanners over them, one findings table."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dqaudit.model import FINDING, ORDER, FieldMap, Scanner, ScanRun
from dqaudit.plans.fields import canonical, resolve_fields
from dqaudit.plans.registry import builtin


def scan(df: DataFrame, fields: FieldMap, scanners: list[Scanner]) -> DataFrame:
    """Findings of all scanners with __ord (the scanner's place) and the columns of model.ORDER."""
    records = canonical(df, fields)
    parts = [s.plan(records, fields).withColumn("scanner", F.lit(s.name)).withColumn("__ord", F.lit(k)) for k, s in enumerate(scanners)]
    if not parts:
        spark: SparkSession = df.sparkSession
        return spark.createDataFrame([], FINDING + ", __phase int, __first bigint, __within int, __ord int")
    return reduce(DataFrame.unionByName, parts)


def materialized(df: DataFrame) -> DataFrame:
    """df cut by a checkpoint in the session's shared folder (spark.checkpoint.dir), so that what follows doesn't evaluate it again; df itself
    where a cluster's session names no such folder.  A local session without one uses a temporary folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        to = spark.conf.get("spark.checkpoint.dir", None)
        if to is None and sc.master != "local" and not sc.master.startswith("local["):
            return df
        if to is None:
            to = tempfile.mkdtemp(prefix="checkpoint")
        sc.setCheckpointDir(to)
    return df.checkpoint(eager=True)


def numbered(found: DataFrame) -> DataFrame:
    """Findings with id 0, 1, ... by scanner, pass, first encounter and sample.

    The number is a count of earlier (scanner, pass) groups' sizes plus a rank within the group's range of samples, so that no
    task orders all findings.
    """
    keys = ["__ord", "__phase", "__first", "sample_index", "__within"]
    step = 1 << 20
    f = found.withColumn("__range", F.floor(F.coalesce("__first", F.lit(-1)) / step))
    group = ["__ord", "__phase", "__range"]
    sizes = f.groupBy(*group).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy(*group).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    at = F.row_number().over(W.partitionBy(*group).orderBy(*keys[2:])) - 1
    out = f.withColumn("__at", at).join(F.broadcast(before), group)
    return out.withColumn("id", F.col("__before") + F.col("__at")).drop("__range", "__before", "__at")


def run(df: DataFrame, fields: FieldMap | None = None, scanners: list[Scanner] | None = None, dataset_name: str = "dataset", split: str | None = None, source_type: str = "tables", revision: str | None = None, config: str | None = None) -> ScanRun:
    """Scans df; roles are detected where fields is None, and all built-in scanners run by default."""
    fields = fields or resolve_fields([c for c in df.columns if not c.startswith("__")])
    scanners = list(builtin().values()) if scanners is None else scanners
    found = numbered(materialized(scan(df, fields, scanners)))
    return ScanRun(dataset_name, split, df.count(), found, source_type, revision, config, [s.name for s in scanners])


def envelope(found: DataFrame) -> DataFrame:
    """Without the ordering columns."""
    return found.drop(*ORDER, "__ord")
