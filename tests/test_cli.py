"""The command line, exports, plugins, and running from another folder."""

import json
import subprocess
import sys
from pathlib import Path

import pytest

from dqaudit import cli
from dqaudit.plans import registry
from dqaudit.sources import chat, findings

ROOT = Path(__file__).resolve().parent.parent
PLUGIN = """
from pyspark.sql import functions as F
from dqaudit import scanner
from dqaudit.model import findings

@scanner("Answers that are X.")
def my_check(df, fields):
    return findings(df.where(F.col("a") == "X"), "my_check", "low", "format", F.col("a"), {})

@scanner("Nothing.")
def other(df, fields):
    return my_check.plan(df, fields).where("false")

SCANNERS = [my_check]
"""


@pytest.fixture
def dataset(spark, tmp_path):
    at = tmp_path / "data" / "dimensions"
    spark.createDataFrame([("is it one or two?", "two"), ("how many are there?", "about ten or twelve of them"), ("which?", "X")], "q string, a string").coalesce(1).write.parquet(str(at))
    return str(tmp_path / "data")


def scan(tmp_path, dataset, *args):
    out = tmp_path / "out"
    code = cli.main(["scan", dataset, "--question-field", "q", "--answer-field", "a", "-o", str(out), *args])
    return code, out


def test_config_is_used_and_saved(spark, tmp_path, dataset, capsys):
    code, out = scan(tmp_path, dataset, "--config", "dimensions", "--revision", "abc")
    assert code == 0
    summary = json.loads((out / "scan_summary.json").read_text())
    assert (summary["config"], summary["revision"], summary["split"], summary["total_samples"]) == ("dimensions", "abc", "train", 3)
    assert {"answer_length", "forced_choice_leakage"} <= set(summary["by_scanner"])
    assert (out / "REPORT.md").exists() and len(json.loads((out / "samples.json").read_text())) == 3
    assert cli.main(["report", str(tmp_path)]) == 0 and "3 samples" in capsys.readouterr().out
    assert cli.main(["report", str(tmp_path / "data")]) == 2


def test_config_is_none_by_default(spark, tmp_path, dataset):
    code, out = scan(tmp_path, dataset, "--scanners", "answer_length", "--max-answer-words", "6", "--limit", "2")
    summary = json.loads((out / "scan_summary.json").read_text())
    assert code == 0 and summary["config"] is None and summary["total_samples"] == 2 and summary["by_scanner"] == {}


def test_scanner_modules_and_models(spark, tmp_path, dataset, capsys, monkeypatch):
    (tmp_path / "plug.py").write_text(PLUGIN)
    code, out = scan(tmp_path, dataset, "--scanner-module", str(tmp_path / "plug.py"), "--scanners", "my_check")
    assert code == 0 and json.loads((out / "my_check.json").read_text())[0]["sample_index"] == 2
    assert scan(tmp_path, dataset, "--scanner-module", "definitely_not_a_module_xyz")[0] == 2
    assert scan(tmp_path, dataset, "--scanners", "nothing")[0] == 2 and scan(tmp_path, dataset, "--scanners", "ambiguity")[0] == 2
    assert "needs a model" in capsys.readouterr().err
    assert scan(tmp_path, str(tmp_path / "nowhere"))[0] == 2
    assert cli.main(["scanners"]) == 0 and "numeric_provenance" in capsys.readouterr().out
    assert cli.main(["datasets", str(tmp_path)]) == 0 and "data" in capsys.readouterr().out


def test_plugin_modules(tmp_path):
    """A SCANNERS list wins, else public scanners count; a module without any is an error."""
    for name, text, want in (("a", PLUGIN, {"my_check"}), ("b", PLUGIN.replace("SCANNERS = [my_check]", ""), {"my_check", "other"})):
        (tmp_path / f"{name}.py").write_text(text)
        got = registry.load_plugins(str(tmp_path / f"{name}.py"))
        assert {n for n in got if n != "scanner"} == want
    (tmp_path / "empty.py").write_text("X = 1\n")
    with pytest.raises(ValueError, match="no scanners"):
        registry.load_plugins(str(tmp_path / "empty.py"))


def test_exports():
    import dqaudit

    assert all(getattr(dqaudit, n) is not None for n in dqaudit.__all__ if n != "run") and callable(dqaudit.ship)
    with pytest.raises(AttributeError):
        dqaudit.nothing  # noqa: B018


def test_first_message_where_no_user_speaks(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "assistant", "hm"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "assistant", None)]
    got = chat.last_user_message(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {tuple(r) for r in got} == {(1, "be brief"), (2, "c"), (3, "")}


def test_metadata_keeps_its_types(spark):
    samples = [{"input": "i", "target": "t", "metadata": {"n": 3, "x": 1, "ok": True, "tags": ["a"], "s": "u", "mixed": 1}}, {"input": "j", "target": ["t"], "metadata": {"x": 0.5, "mixed": "m", "input": "no"}}, {"input": "k", "target": None}]
    df, f = chat.load_samples(spark, samples)
    assert {k: v for k, v in df.dtypes if k in ("n", "x", "ok", "tags", "s", "mixed")} == {"n": "bigint", "x": "double", "ok": "boolean", "tags": "string", "s": "string", "mixed": "string"}
    rows = [r.asDict() for r in df.orderBy("sample_index").collect()]
    assert (rows[0]["n"], rows[0]["x"], rows[0]["ok"], rows[0]["tags"], rows[0]["mixed"]) == (3, 1.0, True, '["a"]', "1") and rows[1]["input"] == "j" and rows[2]["n"] is None
    assert chat.load_samples(spark, [])[0].count() == 0 and f.question == "input"


def test_a_malformed_file_of_findings_is_named(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{nothing")
    with pytest.raises(Exception, match="bad.json"):
        findings.load_findings(spark, str(tmp_path)).collect()


def test_queries_run_from_another_folder(tmp_path):
    """Python workers get the package however the driver was started."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
print("ROWS", __spark_entry__.queries()["python_plugin"](spark, "/root/testdata/sf0.001").count())
"""
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=180, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert "ROWS" in got.stdout, got.stderr[-2000:]
