"""Triage of findings, clean exports and the joins that a viewer shows.  Findings have ``id``; a triage table is (finding_id, status)."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dqaudit.model import severity_rank

STATES = ("confirmed", "dismissed", "pending")
TRIAGE = "finding_id bigint, status string"


def enriched(found: DataFrame, triage: DataFrame) -> DataFrame:
    """Findings with status, pending where there is none."""
    t = triage.select(F.col("finding_id").alias("__fid"), F.col("status").alias("__s"))
    return found.join(t, F.col("id") == F.col("__fid"), "left").withColumn("status", F.coalesce("__s", F.lit("pending"))).drop("__fid", "__s")


def upsert(triage: DataFrame, finding_id: int, status: str) -> DataFrame:
    """pending deletes the entry, other states set it; an unknown state is an error."""
    if status not in STATES:
        raise ValueError(f"status {status!r} isn't one of {STATES}")
    rest = triage.where(F.col("finding_id") != finding_id)
    return rest if status == "pending" else rest.unionByName(triage.sparkSession.createDataFrame([(finding_id, status)], TRIAGE))


def save_triage(triage: DataFrame, path: str | Path) -> None:
    Path(path).write_text(json.dumps({str(r["finding_id"]): r["status"] for r in triage.collect()}, indent=2))


def load_triage(spark: SparkSession, path: str | Path) -> DataFrame:
    rows = json.loads(Path(path).read_text()) if Path(path).exists() else {}
    return spark.createDataFrame([(int(k), v) for k, v in rows.items()], TRIAGE)


def clean_indices(found: DataFrame, triage: DataFrame, total: int) -> DataFrame:
    """sample_index of the samples without a confirmed finding, in order; dataset-level findings (-1) take none out."""
    bad = enriched(found, triage).where("status = 'confirmed'").select("sample_index").distinct()
    return found.sparkSession.range(total).withColumnRenamed("id", "sample_index").join(bad, "sample_index", "left_anti").orderBy("sample_index")


def filtered(found: DataFrame, scanner: str | None = None, severity: str | None = None, status: str | None = None) -> DataFrame:
    for c, v in (("scanner", scanner), ("severity", severity), ("status", status)):
        if v is not None:
            found = found.where(F.col(c) == v)
    return found


def samples_with_findings(found: DataFrame, total: int) -> DataFrame:
    """sample_index of all samples with badges: severity and scanner of its findings, worst first."""
    b = found.where("sample_index >= 0").groupBy("sample_index").agg(F.array_sort(F.collect_list(F.struct(severity_rank(F.col("severity")).alias("rank"), "scanner", "severity"))).alias("badges"))
    none = F.array().cast("array<struct<rank:int,scanner:string,severity:string>>")
    return found.sparkSession.range(total).withColumnRenamed("id", "sample_index").join(b, "sample_index", "left").withColumn("badges", F.coalesce("badges", none)).withColumn("n_findings", F.size("badges"))


def scanner_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("scanner").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "scanner")


def triage_counts(found: DataFrame, triage: DataFrame) -> DataFrame:
    e = enriched(found, triage)
    return e.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATES])


def of_sample(found: DataFrame, sample_index: int) -> DataFrame:
    return found.where(F.col("sample_index") == sample_index)


def neighbours(found: DataFrame) -> DataFrame:
    """Findings with previous and next id of the filtered list; the ends keep their own.

    Ids are dense, so a range of them is a partition; its ends look into the neighbouring ranges' first and last ids.
    """
    step = 1 << 16
    f = found.withColumn("__range", F.floor(F.col("id") / step))
    ends = f.groupBy("__range").agg(F.min("id").alias("__low"), F.max("id").alias("__high"))
    order = W.orderBy("__range")
    ends = ends.select("__range", F.lag("__high").over(order).alias("__before"), F.lead("__low").over(order).alias("__after"))
    at = W.partitionBy("__range").orderBy("id")
    f = f.withColumns({"__p": F.lag("id").over(at), "__n": F.lead("id").over(at)}).join(F.broadcast(ends), "__range")
    return f.withColumns({"previous_id": F.coalesce("__p", "__before", "id"), "next_id": F.coalesce("__n", "__after", "id")}).drop("__range", "__before", "__after", "__p", "__n")


def body_line(line: Column, offset: Column) -> Column:
    return line - F.coalesce(offset, F.lit(0))


def dataset_list(found_by_dataset: DataFrame) -> DataFrame:
    """One row for each slug: total, high, medium, low."""
    return found_by_dataset.groupBy("slug").agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")])


def slug(name: str) -> str:
    return name.replace("/", "--")
