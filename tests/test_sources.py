"""Sources, sinks and streams that no other test touches."""

import json

import pytest

from dqaudit.model import FieldMap, Scanner
from dqaudit.operators import judge, profile, report, triage
from dqaudit.plans import fields, registry, run
from dqaudit.sources import artifacts, chat, findings, tables

QA = FieldMap("q", "a")


def test_artifacts_are_attached_and_read(spark, tmp_path):
    for sid, name, text in (("1", "ocr.txt", "one hy-\nphen"), ("1", "ocr.md", "older"), ("1", "layout.md", "two"), ("1", "index.md", "no"), ("1", "ground_truth.md", "no"), ("2", "ocr.txt", " \n"), ("3", "page.png", "x")):
        (tmp_path / sid).mkdir(exist_ok=True)
        (tmp_path / sid / name).write_text(text)
    got = {(r["sample_key"], r["tool"]): r["text"] for r in artifacts.load_tools(spark, str(tmp_path)).collect()}
    assert got == {("1", "ocr"): "one hyphen", ("1", "layout"): "two"}
    df = artifacts.attach(spark.createDataFrame([(1, "q"), (4, "q")], "id long, q string"), "id", str(tmp_path))
    assert {r["id"]: r["__artifacts_dir__"] for r in df.collect()} == {1: str(tmp_path / "1"), 4: None}
    assert tuple(artifacts.attached(df).first()) == (1, 2)
    (tmp_path / "empty").mkdir()
    assert artifacts.load_tools(spark, str(tmp_path / "empty")).count() == 0


def test_tasks_by_their_specs(spark, tmp_path, monkeypatch):
    text = "def my_task():\n    return {'dataset': [{'input': 'i', 'target': 't', 'id': 5}]}\n\ndef other():\n    return []\nother.is_task = True\nvalue = 3\n"
    (tmp_path / "tasks_of_mine.py").write_text(text)
    (tmp_path / "pack").mkdir()
    (tmp_path / "pack" / "__init__.py").write_text("")
    (tmp_path / "pack" / "named.py").write_text(text.replace("my_task", "named"))
    monkeypatch.syspath_prepend(str(tmp_path))
    for spec in ("tasks_of_mine@my_task", f"{tmp_path}/tasks_of_mine.py@my_task", "pack/named"):
        df, f = chat.load_task(spark, spec)
        assert [tuple(r) for r in df.select("input", "target", "id").collect()] == [("i", "t", "5")] and f == FieldMap("input", "target", "id")
    assert chat.load_task(spark, "tasks_of_mine@nothing")[0].count() == 0  # the only one that says it is a task
    with pytest.raises(ValueError, match="no task"):
        chat.load_task(spark, "nothing")
    assert tables.source_type("tasks_of_mine@my_task") == "task" and tables.source_type("pack/named") == "task"
    assert tables.source_type("owner/unknown") == "tables" and tables.source_type(str(tmp_path / "pack")) == "tables"


def test_scans_below_a_folder_and_the_catalog_of_tables(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / "scans" / name).mkdir(parents=True)
        if name != "c":
            (tmp_path / "scans" / name / "scan_summary.json").write_text(json.dumps({"dataset_name": name}))
    assert findings.scan_dirs([str(tmp_path / "scans"), str(tmp_path / "scans" / "a")]) == [str(tmp_path / "scans" / x) for x in "aba"]
    spark.range(3).coalesce(1).write.json(str(tmp_path / "data" / "Large" / "train"))
    (tmp_path / "data" / "small.csv").write_text("q,a\nx,y\n")
    got = {r["name"]: r for r in tables.list_datasets(spark, str(tmp_path / "data")).collect()}
    assert set(got) == {"Large", "small.csv"} and got["Large"]["splits"] == ["train"] and got["small.csv"]["files"] == 1
    assert [r["name"] for r in tables.list_datasets(spark, str(tmp_path / "data"), "LARGE").collect()] == ["Large"]
    assert tables.load_table(spark, str(tmp_path / "data" / "Large"), split="train").count() == 3
    assert tables.load_table(spark, str(tmp_path / "data" / "small.csv"), limit=1).first()["q"] == "x"


def test_partitioned_sink(spark, tmp_path):
    df = spark.createDataFrame([(0, "which one?", "a b c d e f"), (1, "which one?", "x")], "sample_index long, q string, a string")
    found = run.run(df, QA).findings
    report.write_partitioned(found, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == found.count() and {p.name for p in (tmp_path / "out").glob("scanner=*")} == {"scanner=answer_length", "scanner=duplicate_questions"}
    assert report.default_output_dir("My Data/set!").startswith("findings/my-data-set_")


def test_stub_judge_and_schema(spark):
    ask = judge.StubJudge([("why", "YES\nreasons")])
    assert ask(judge.SYSTEM, "tell why") == "YES\nreasons" and ask(judge.SYSTEM, "what").startswith("NO")
    df = spark.createDataFrame([(1, "x", True, 0.5, b"1", None)], "i int, s string, b boolean, f double, raw binary, __hidden string")
    assert [f["name"] for f in profile.schema_of(df)] == ["i", "s", "b", "f", "raw"]
    assert profile.display_width(spark.createDataFrame([(k, "x" * k) for k in range(1, 11)], "sample_index long, s string"), "s").first()["width"] == 9


def test_triage_views(spark):
    found = spark.createDataFrame([(0, "s", "high", 3), (1, "s", "low", -1), (2, "t", "low", 3)], "id long, slug string, severity string, sample_index long")
    assert {tuple(r) for r in triage.dataset_list(found).collect()} == {("s", 2, 1, 0, 1), ("t", 1, 0, 0, 1)}
    assert {r["id"] for r in triage.of_sample(found, 3).collect()} == {0, 2}
    with pytest.raises(ValueError, match="isn't one of"):
        triage.upsert(spark.createDataFrame([], triage.TRIAGE), 1, "maybe")


def test_first_of_each_on_a_stream(spark, tmp_path):
    from dqaudit.streaming.row_local import first_of_each

    rows = [(k, f"q{k % 3}", "a", f"2024-01-01 00:00:{k:02d}") for k in range(9)]
    spark.createDataFrame(rows, "n long, q string, a string, at string").selectExpr("n", "q", "a", "CAST(at AS timestamp) AS at").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n long, q string, a string, at timestamp").parquet(str(tmp_path / "in"))
    out = first_of_each(stream, QA, "n", "at", "1 hour").select("sample_index", "q_norm")
    q = out.writeStream.format("memory").queryName("first_of_each").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("first_of_each").collect()
    assert {r["q_norm"] for r in got} == {"q0", "q1", "q2"} and len(got) == 3


def test_all_scanners_agree_over_1_and_7_partitions(spark, tmp_path):
    rows = [(k, str(k), f"q{k % 7} this or that?", ("| a | b |\n| 1 |\n ﬁ 4417 word" if k % 5 == 0 else f"Answer {k % 5}." if k % 3 else "that"), b"\x89PNG\r\n\x1a\n" + b"0" * 20) for k in range(60)]
    df = spark.createDataFrame(rows, "sample_index long, id string, q string, a string, raw binary").selectExpr("*", "named_struct('bytes', raw, 'path', 'x.gif') AS img").drop("raw")
    tools = spark.createDataFrame([(str(k), t, f"this {t} text") for k in range(60) for t in "xy"], artifacts.TOOLS)
    f = FieldMap("q", "a", "id", "img")
    every: list[Scanner] = list(registry.builtin(tools).values())
    seen = [{tuple(r) for r in run.run(df.repartition(n), f, every).findings.select("id", "scanner", "severity", "sample_index", "line", "metadata").collect()} for n in (1, 7)]
    assert seen[0] == seen[1] and {"text_layer_recall", "numeric_provenance", "image_mime_type", "markdown_integrity", "duplicate_questions", "forced_choice_leakage"} <= {x[1] for x in seen[0]}
    assert len(every) == 12 and fields.samples(df, f).count() == 60
