"""Roles, findings and runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("high", "medium", "low")
CATEGORIES = ("label_quality", "question_quality", "distribution", "format", "leakage")
FINDING = "scanner string, severity string, category string, explanation string, sample_index bigint, sample_id string, line int, metadata string"
#: Columns that order the findings of a scanner: its passes, the place of first encounter, the sample, and the place within it.
ORDER = ("__phase", "__first", "__within")


@dataclass(frozen=True)
class FieldMap:
    """Which columns are question, answer, id and image."""

    question: str
    answer: str
    id: str | None = None
    image: str | None = None


@dataclass(frozen=True)
class Scanner:
    """A named plan from canonical records (see plans.fields.canonical) to findings (see findings())."""

    name: str
    plan: Callable[[DataFrame, FieldMap], DataFrame]
    description: str = ""
    needs_model: bool = False


@dataclass
class ScanRun:
    dataset_name: str
    split: str | None
    total_samples: int
    findings: DataFrame
    source_type: str = "tables"
    revision: str | None = None
    config: str | None = None
    scanners: list[str] = field(default_factory=list)

    def by_scanner(self) -> DataFrame:
        return self.findings.groupBy("scanner").agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])

    def by_severity(self) -> DataFrame:
        return self.findings.groupBy("severity").agg(F.count("*").alias("total"))


def severity_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).when(c == "low", 2)


def findings(df: DataFrame, scanner: str, severity: Column | str, category: str, explanation: Column, metadata: dict[str, Column], line: Column | None = None, phase: Column | int = 0, first: Column | None = None, within: Column | int = 0) -> DataFrame:
    """Packs typed columns into the uniform envelope; df has sample_index and sample_id."""
    packed = F.to_json(F.struct(*[c.alias(k) for k, c in metadata.items()]), {"ignoreNullFields": "false"}) if metadata else F.lit("{}")
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        F.lit(scanner).alias("scanner"), as_col(severity).alias("severity"), F.lit(category).alias("category"), explanation.alias("explanation"),
        F.col("sample_index").cast("bigint").alias("sample_index"), F.col("sample_id").cast("string").alias("sample_id"), (F.lit(None) if line is None else line).cast("int").alias("line"), packed.alias("metadata"),
        as_col(phase).cast("int").alias("__phase"), (F.col("sample_index") if first is None else first).cast("bigint").alias("__first"), as_col(within).cast("int").alias("__within"),
    )
