"""Report aggregations and sinks."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dqaudit.model import SEVERITIES, ScanRun, severity_rank
from dqaudit.plans.fields import samples
from dqaudit.plans.run import envelope


def summary_by_scanner(found: DataFrame) -> DataFrame:
    return found.groupBy("scanner").agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def summary_by_severity(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("total"))


def summary_rollup(found: DataFrame) -> DataFrame:
    """Counts by scanner and severity, with subtotals (null severity) and the total (both null)."""
    return found.rollup("scanner", "severity").agg(F.count("*").alias("total"))


def top_per_scanner(found: DataFrame, n: int = 5) -> DataFrame:
    """The first n findings of each scanner by severity and then id; rank begins at 1 and more says how many are left out."""
    at = W.partitionBy("scanner").orderBy(severity_rank(F.col("severity")), "id")
    r = found.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= n)
    return r.join(F.broadcast(found.groupBy("scanner").agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))), "scanner")


def write_partitioned(found: DataFrame, path: str) -> None:
    """At scale: one folder of JSON lines for each scanner."""
    envelope(found).write.mode("overwrite").partitionBy("scanner").json(path)


def default_output_dir(name: str, now: datetime | None = None) -> str:
    slug = re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-")
    return f"findings/{slug}_{(now or datetime.now(UTC)).strftime('%Y-%m-%dT%H-%M-%S')}"


def _as_dict(r: dict, typed_id: bool) -> dict:
    sid = r["sample_id"]
    return {"scanner": r["scanner"], "severity": r["severity"], "category": r["category"], "explanation": r["explanation"], "sample_index": r["sample_index"], "sample_id": int(sid) if typed_id and sid is not None else sid, "line": r["line"], "metadata": json.loads(r["metadata"])}


def with_members(rows: list[dict]) -> list[dict]:
    """Findings of duplicates with duplicate_indices, the sorted sample indices of their group, in place of the group's key."""
    members: dict[str, list[int]] = {}
    for r in rows:
        if "duplicate_group" in r["metadata"]:
            members.setdefault(r["metadata"]["duplicate_group"], []).append(r["sample_index"])
    for own in members.values():
        own.sort()
    return [{**r, "metadata": {("duplicate_indices" if k == "duplicate_group" else k): (members[v] if k == "duplicate_group" else v) for k, v in r["metadata"].items()}} for r in rows]


def save(run: ScanRun, output_dir: str | Path, records: DataFrame | None = None, fields=None, files_root: str | None = None) -> None:
    """<scanner>.json for each scanner with findings, scan_summary.json, REPORT.md and, with records, samples.json; for results that the driver can
    hold, as it collects them (write_partitioned is for others)."""
    out = Path(output_dir)
    out.mkdir(parents=True, exist_ok=True)
    typed = records is not None and fields is not None and (fields.id is None or dict(records.dtypes).get(fields.id) in ("int", "bigint", "smallint", "tinyint"))
    by: dict[str, list[dict]] = {}
    for r in run.findings.orderBy("id").toLocalIterator():
        by.setdefault(r["scanner"], []).append(_as_dict(r.asDict(), typed))
    by = {name: with_members(rows) for name, rows in by.items()}
    for name, rows in by.items():
        (out / f"{name}.json").write_text(json.dumps(rows, indent=2, default=str))
    count = lambda rows, s: sum(r["severity"] == s for r in rows)
    severities: dict[str, int] = {}
    for rows in by.values():
        for r in rows:
            severities[r["severity"]] = severities.get(r["severity"], 0) + 1
    summary = {
        "dataset_name": run.dataset_name, "split": run.split, "source_type": run.source_type, "revision": run.revision, "config": run.config, "files_root": files_root,
        "total_samples": run.total_samples, "total_findings": sum(map(len, by.values())), "by_scanner": {n: {"total": len(rows), **{s: count(rows, s) for s in SEVERITIES}} for n, rows in by.items()}, "by_severity": severities,
    }
    (out / "scan_summary.json").write_text(json.dumps(summary, indent=2))
    if records is not None and fields is not None:
        rows = [r.asDict(True) for r in samples(records, fields).orderBy("index").toLocalIterator()]
        (out / "samples.json").write_text(json.dumps(rows, indent=2, default=str))
    (out / "REPORT.md").write_text(markdown_report(run, by))


def _label(r: dict) -> str:
    return f"id={r['sample_id']}" if r["sample_id"] is not None else f"index={r['sample_index']}"


def markdown_report(run: ScanRun, by: dict[str, list[dict]]) -> str:
    rank = {s: k for k, s in enumerate(SEVERITIES)}
    total = sum(map(len, by.values()))
    out = [f"# Audit of {run.dataset_name}", "", f"Split: {run.split or '-'}", f"Samples: {run.total_samples:,}", f"Findings: {total:,}", "", "| Scanner | Total | High | Medium | Low |", "| --- | --- | --- | --- | --- |"]
    for name in sorted(by):
        out.append(f"| `{name}` | {len(by[name])} | " + " | ".join(str(sum(r["severity"] == s for r in by[name])) for s in SEVERITIES) + " |")
    for name in sorted(by):
        out += ["", f"## {name}", ""] + [f"- {r['severity'].upper()} ({_label(r)}): {r['explanation']}" for r in sorted(by[name], key=lambda r: rank[r["severity"]])]
    return "\n".join(out) + "\n"


def render(run: ScanRun, n: int = 5) -> str:
    """The terminal report: counts by scanner and each scanner's first n findings."""
    lines = [f"{run.dataset_name}: {run.total_samples:,} samples"]
    for r in summary_by_scanner(run.findings).orderBy("scanner").collect():
        lines.append(f"{r['scanner']:<24}{r['total']:>8} findings  high {r['high']}, medium {r['medium']}, low {r['low']}")
    last = None
    for r in top_per_scanner(run.findings, n).orderBy("scanner", "rank").collect():
        if r["scanner"] != last:
            last = r["scanner"]
            lines += ["", f"{last}" + (f" ({r['more']} more in the files)" if r["more"] else "")]
        lines.append(f"  {r['severity'].upper()} {_label(r.asDict())}: {r['explanation']}")
    return "\n".join(lines)


def render_saved(folder: str | Path) -> str:
    """The counts of a saved scan."""
    s = json.loads((Path(folder) / "scan_summary.json").read_text())
    lines = [f"{s['dataset_name']}: {s['total_samples']:,} samples, {s['total_findings']:,} findings"]
    return "\n".join(lines + [f"{n:<24}{c['total']:>8}  high {c['high']}, medium {c['medium']}, low {c['low']}" for n, c in sorted(s["by_scanner"].items())])
