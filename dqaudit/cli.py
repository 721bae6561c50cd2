"""The command line: ``python -m dqaudit scan|scanners|report|datasets``."""

from __future__ import annotations

import argparse
import importlib
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from dqaudit import ship
from dqaudit.model import FieldMap, Scanner
from dqaudit.operators import judge, report
from dqaudit.plans import registry, run
from dqaudit.plans.fields import resolve_fields
from dqaudit.sources import annotations, artifacts, chat, findings, tables


class UsageError(Exception):
    """What the user should put right."""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="dqaudit", description="Audits question/answer datasets.")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan", help="scan a dataset and save what is found")
    s.add_argument("dataset", help="a table's path, a folder of JSON annotations, or a task (module@function, file.py@function, package/task)")
    s.add_argument("--split", default="train")
    s.add_argument("--revision")
    s.add_argument("--config", help="a folder below the dataset")
    for role in ("question", "answer", "id", "image"):
        s.add_argument(f"--{role}-field", help="by name; question, answer and id are detected by default")
    s.add_argument("--scanners", help="names, joined by commas; all but model-judged ones by default")
    s.add_argument("--scanner-module", action="append", default=[], help="a module or file with further scanners; may be repeated")
    s.add_argument("--model", default=os.environ.get("DQAUDIT_MODEL"), help="module@function from (system message, prompt) to a reply")
    s.add_argument("--max-answer-words", type=int, default=4)
    s.add_argument("--files-root", help="folder with a folder of tool outputs for each sample")
    s.add_argument("--limit", type=int)
    s.add_argument("-o", "--output-dir")
    sub.add_parser("scanners", help="list the scanners")
    r = sub.add_parser("report", help="show a saved scan")
    r.add_argument("findings", nargs="+", help="folders of scans, or folders above them")
    d = sub.add_parser("datasets", help="list the datasets below a folder")
    d.add_argument("root")
    d.add_argument("--like")
    return p


def load(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, FieldMap, str, str | None]:
    """Records, roles, kind of source and split."""
    kind = tables.source_type(a.dataset)
    named = [a.question_field, a.answer_field, a.id_field, a.image_field]
    split = a.split
    if kind == "local":
        df, f = annotations.load_annotations(spark, a.dataset, a.limit)
        split = None
    elif kind == "task":
        df, f = chat.load_task(spark, a.dataset, a.limit)
    else:
        if not os.path.exists(a.dataset):
            raise UsageError(f"there is no {a.dataset}")
        df, f = tables.load_table(spark, a.dataset, a.split, a.config, a.limit), None
    if f is None or any(named):
        f = resolve_fields([c for c in df.columns if c != "sample_index"], *named)
    return df, f, kind, split


def chosen(a: argparse.Namespace, tools: DataFrame | None) -> list[Scanner]:
    plugins: dict[str, Scanner] = {}
    for m in a.scanner_module:
        try:
            plugins |= registry.load_plugins(m)
        except ImportError as e:
            raise UsageError(f"could not import {m}: {e}") from e
    models: dict[str, Scanner] = {}
    if a.model:
        if "@" not in a.model:
            raise UsageError("--model is module@function")
        module, name = a.model.rsplit("@", 1)
        ask = getattr(importlib.import_module(module), name)
        models = {n: make(ask) for n, make in judge.MODEL_SCANNERS.items()}
    names = [n.strip() for n in a.scanners.split(",")] if a.scanners else None
    picked = registry.select(names, registry.builtin(tools, a.max_answer_words) | models, plugins, models)
    if a.model and names and not any(n in models for n in names):
        picked += list(models.values())
    return picked


def scan(spark: SparkSession, a: argparse.Namespace) -> Path:
    df, f, kind, split = load(spark, a)
    tools = artifacts.load_tools(spark, a.files_root) if a.files_root else None
    if a.files_root:
        df = artifacts.attach(df, f.id or "sample_index", a.files_root)
        got = artifacts.attached(df).first()
        print(f"{got['attached']} of {got['total']} samples have a folder below {a.files_root}")
    scanners = chosen(a, tools)
    print(f"{a.dataset}: question {f.question}, answer {f.answer}" + (f", id {f.id}" if f.id else "") + f"; {len(scanners)} scanners")
    name = str(Path(a.dataset).resolve()) if kind == "local" else a.dataset
    r = run.run(df, f, scanners, name, split, kind, a.revision, a.config if kind == "tables" else None)
    print(report.render(r))
    out = Path(a.output_dir or report.default_output_dir(name.rstrip("/").rsplit("/", 1)[-1]))
    report.save(r, out, df, f, str(Path(a.files_root).resolve()) if a.files_root else None)
    print(f"saved to {out}")
    return out


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("dqaudit").getOrCreate()
    ship(spark)
    try:
        if a.command == "scan":
            scan(spark, a)
        elif a.command == "scanners":
            for r in registry.catalog(spark).collect():
                print(f"{r['name']:<24}{'model' if r['needs_model'] else 'plan':<8}{r['description']}")
        elif a.command == "report":
            folders = findings.scan_dirs(a.findings)
            if not folders:
                raise UsageError(f"no scan_summary.json in {', '.join(a.findings)}")
            print("\n\n".join(map(report.render_saved, folders)))
        else:
            for r in tables.list_datasets(spark, a.root, a.like).collect():
                print(f"{r['name']:<32}{r['size']:>14}  {', '.join(r['splits'])}")
    except (UsageError, ValueError) as e:
        print(f"dqaudit: {e}", file=sys.stderr)
        return 2
    return 0
