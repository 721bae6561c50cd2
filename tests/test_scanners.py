"""Each scanner on small records: the cases that its semantics turn on."""

import json

import pytest
from pyspark.sql import functions as F

from dqaudit.model import FieldMap
from dqaudit.operators import artifact_scanners, judge, profile, report, triage
from dqaudit.plans import fields, registry, run
from dqaudit.sources import annotations, artifacts, chat, findings, tables

QA = FieldMap("q", "a", "id")


def records(spark, rows, kind="q string, a string, id string"):
    rows = [(*r, str(k)) if len(r) == 2 else r for k, r in enumerate(rows)]
    names = [k.split(":")[0] for k in kind.split(", ")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"sample_index bigint, {kind}")
    assert len(df.columns) == len(names) + 1
    return df


def scan(df, *names, f=QA, tools=None, **how):
    got = run.envelope(run.numbered(run.scan(df, f, registry.select(list(names), registry.builtin(tools, **how))))).orderBy("id").collect()
    return [{**r.asDict(), "metadata": json.loads(r["metadata"])} for r in got]


def test_answer_length(spark):
    df = records(spark, [("q", "a b c d"), ("q", " a  b\tc d e\n"), ("q", None), ("q", "")])
    (r,) = scan(df, "answer_length")
    assert (r["sample_index"], r["severity"], r["category"], r["metadata"]["word_count"]) == (1, "medium", "label_quality", 5)
    assert len(scan(df, "answer_length", max_answer_words=3)) == 2


def test_integer_zero_is_an_empty_answer(spark):
    df = spark.createDataFrame([(k, "q", k % 2) for k in range(20)], "sample_index bigint, q string, a int")
    (r,) = scan(df, "answer_distribution", f=FieldMap("q", "a"))
    assert r["metadata"]["total"] == 10 and r["metadata"]["most_common_answer"] == "1" and r["sample_index"] == -1 and r["sample_id"] is None


@pytest.mark.parametrize(("n", "found"), [(85, 1), (84, 0)])
def test_answer_distribution(spark, n, found):
    got = scan(records(spark, [("q", " X ")] * n + [("q", f"y{k}") for k in range(100 - n)] + [("q", "")] * 5), "answer_distribution")
    assert len(got) == found and all(r["metadata"]["most_common_answer"] == "x" and r["metadata"]["total"] == 100 and len(r["metadata"]["top_10"]) == 10 for r in got)


@pytest.mark.parametrize(("yes", "no", "found"), [(50, 0, 0), (51, 0, 1), (30, 30, 1)])
def test_binary_ratio(spark, yes, no, found):
    got = scan(records(spark, [("q", "Yes")] * yes + [("q", " no ")] * no + [("q", "other")] * (100 - yes - no)), "binary_question_ratio")
    assert len(got) == found and all(r["metadata"]["yes_count"] == yes and "always" in r["explanation"] for r in got)


def test_duplicates(spark):
    got = scan(records(spark, [("Q", "a"), (" q ", "A "), ("x", "1"), ("X", "2"), ("", "k"), (None, "k"), ("one", "1")]), "duplicate_questions")
    saved = report.with_members(got)
    assert len({r["metadata"]["duplicate_group"] for r in got}) == 3
    assert [(r["sample_index"], r["severity"], r["metadata"]["duplicate_indices"]) for r in saved] == [(0, "high", [0, 1]), (1, "high", [0, 1]), (2, "low", [2, 3]), (3, "low", [2, 3]), (4, "high", [4, 5]), (5, "high", [4, 5])]


def test_a_large_group_of_empty_questions(spark):
    df = spark.range(100_000).selectExpr("id AS sample_index", "'' AS q", "'a' AS a")
    got = run.scan(df, FieldMap("q", "a"), [registry.builtin()["duplicate_questions"]]).selectExpr("count(*) AS n", "max(length(metadata)) AS size", "count(DISTINCT get_json_object(metadata, '$.duplicate_group')) AS g").first()
    assert got["n"] == 100_000 and got["size"] < 200 and got["g"] == 1


def test_duplicates_with_images(spark):
    kind = "sample_index bigint, q string, a string, img struct<bytes:binary,path:string>"
    x, y = (b"1" * 20, "x.png"), (b"2" * 20, "y.png")
    df = spark.createDataFrame([(0, "q", "1", x), (1, "q", "2", x), (2, "q", "3", y), (3, "z", "1", None), (4, "z", "1", None), (5, "w", "1", x), (6, "w", "1", y)], kind)
    got = scan(df, "duplicate_questions", f=FieldMap("q", "a", None, "img"))
    assert sorted((r["sample_index"], r["severity"], r["metadata"]["duplicate_type"]) for r in got) == [(0, "high", "exact"), (0, "low", "question_reuse"), (1, "high", "exact"), (1, "low", "question_reuse"), (2, "low", "question_reuse"), (3, "high", "exact"), (4, "high", "exact"), (5, "medium", "question_reuse"), (6, "medium", "question_reuse")]
    assert sorted((r["sample_index"], r["metadata"]["duplicate_indices"]) for r in report.with_members(got)) == [(0, [0, 1]), (0, [0, 1, 2]), (1, [0, 1]), (1, [0, 1, 2]), (2, [0, 1, 2]), (3, [3, 4]), (4, [3, 4]), (5, [5, 6]), (6, [5, 6])]


def test_inconsistent_format(spark):
    got = scan(records(spark, [("q", "red")] * 9 + [("q", "Blue")]), "inconsistent_format")
    assert [(r["sample_index"], r["metadata"]["issue"]) for r in got] == [(9, "capitalisation")]
    got = scan(records(spark, [("q", "Red.")] * 8 + [("q", "Things etc."), ("q", "Bare")]), "inconsistent_format")
    assert [(r["sample_index"], r["metadata"]["issue"]) for r in got] == [(8, "trailing_punctuation"), (9, "trailing_punctuation")]
    (r,) = scan(records(spark, [("q", "word")] * 20 + [("q", "w " * 20)]), "inconsistent_format")
    assert (r["sample_index"], r["severity"], r["metadata"]["word_count"]) == (20, "medium", 20) and "standard deviation" in r["explanation"]
    assert scan(records(spark, [("q", "One")]), "inconsistent_format") == []


@pytest.mark.parametrize(("q", "a", "found"), [("is this an MRI or a CT scan?", "mri", 1), ("is this an MRI or a CT scan?", "scan", 1), ("is this an MRI or a CT scan?", "my ct scan", 1), ("is this an MRI or a CT scan?", "x-ray", 0), ("is this an MRI or a CT scan?", "", 1), ("A or B", "b", 0), ("or", "x", 0), ("a word for éor words", "words", 0)])
def test_forced_choice(spark, q, a, found):
    assert len(scan(records(spark, [(q, a)]), "forced_choice_leakage")) == found


def test_encoding_and_artifacts(spark):
    got = scan(records(spark, [("a\tb", "x\x7fy\x7f\x01"), ("a\nb", "a\rb")]), "encoding_issues")
    assert [(r["metadata"]["field"], r["metadata"]["bad_chars"]) for r in got] == [("question", ["'\\t'"]), ("answer", ["'\\x7f'", "'\\x01'"])]
    got = scan(records(spark, [("one\ntwo ﬁ\nthree �", "plain"), ("q", "a b")]), "extraction_artifacts")
    assert [(r["severity"], r["line"], len(r["metadata"]["artifacts"])) for r in got] == [("medium", 2, 2), ("low", 1, 1)]


@pytest.mark.parametrize(("path", "head", "found"), [("a.JPG", b"\x89PNG\r\n\x1a\n", 1), ("a.png", b"\x89PNG\r\n\x1a\n", 0), ("a.svg", b"\x89PNG\r\n\x1a\n", 1), ("a.webp", b"RIFF0000WEBP", 0), ("a.png", b"RIFF0000XXXX", 0), ("a.odd", b"BM", 0), ("a.gif", b"II*\x00", 1), (None, b"BM", 0)])
def test_image_types(spark, path, head, found):
    df = spark.createDataFrame([(0, "q", "a", (head + b"\0" * 20, path)), (1, "q", "a", (head[:8] + b"\0" * 3 if len(head) < 9 else head[:11], path)), (2, "q", "a", None)], "sample_index bigint, q string, a string, img struct<bytes:binary,path:string>")
    assert len(scan(df, "image_mime_type", f=FieldMap("q", "a", None, "img"))) == found


def test_image_data_uris(spark):
    import base64

    rows = [(0, "q", "a", "data:image/jpg;base64," + base64.b64encode(b"\xff\xd8\xff" + b"0" * 20).decode()), (1, "q", "a", "not an image")]
    df = spark.createDataFrame(rows, "sample_index bigint, q string, a string, img string")
    assert [r["metadata"]["declared_mime"] for r in scan(df, "image_mime_type", f=FieldMap("q", "a", None, "img"))] == ["image/jpg"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("| a | b |\n| --- | --- |\n| 1 | 2 |", []), ("| a | b |\n| 1 | 2 |", [("missing_delimiter", 1)]), ("x\n| a | b |\n|---|---|\n| 1 |\n|  |  |", [("column_mismatch", 4), ("empty_row", 5)]), ("| a | b |\n|---|---|\n||", [("column_mismatch", 3)]),
        ("| a | b |\n|---|\n| 1 | |", []), ("# a\n### b\n## c", [("heading_jump", 2)]), ("### first", []), ("![x]() and ![y]( ) and ![z](u)", [("empty_image", 1), ("empty_image", 1)]), ("| ![x]() | b |\n|---|---|", []), ("plain", []),
    ],
)
def test_markdown(spark, text, want):
    df = records(spark, [("q", text)]).withColumn("__md_body_offset__", F.lit(6))
    got = scan(df, "markdown_integrity")
    assert [(r["metadata"]["check"], r["line"] - 6) for r in got] == want


def test_tools_against_gold(spark):
    gold = "# Report\n\nThe quick brovn fox paid 1,250 and $x^{99}$ marks."
    df = records(spark, [("q", gold, "s1", "page_roundtrip"), ("q", gold, "s2", "page_x")], "q string, a string, id string, task_type string")
    files = spark.createDataFrame([("s1", "one.txt", "Report The quick brown fox paid 1250 and marks extra"), ("s1", "two.md", "report the qui-\nck fox paid 1,260 and marks extra"), ("s1", "index.md", "brovn"), ("s1", "ground_truth.txt", "brovn"), ("s1", "two.txt", "  \n"), ("s1", "one.md", "brovn 99")], "sample_key string, file_name string, text string")
    tools = artifacts.tool_rows(files)
    assert {(r["tool"], "brovn" in r["text"]) for r in tools.collect()} == {("one", False), ("two", False)}
    got = scan(df, "text_layer_recall", tools=tools)
    assert [(r["severity"], r["line"], r["metadata"]["unsupported_words"] or r["metadata"]["omitted_words"]) for r in got] == [("high", 3, ["brovn"]), ("medium", None, ["extra"])]
    assert scan(df, "numeric_provenance", tools=tools) == []
    lost = scan(df.withColumn("a", F.concat("a", F.lit("\n7,777 or 88"))), "numeric_provenance", tools=tools)
    assert [(r["line"], r["metadata"]["missing_numbers"]) for r in lost] == [(4, ["88", "7777"])]
    assert artifact_scanners.numeric_rows(fields.canonical(df.withColumn("ocr_resistant", F.lit(True)), QA), tools).count() == 0


def test_judged_scanners(spark):
    df = records(spark, [("is it?", "yes"), ("", "x"), ("why?", ""), ("fails", "x")])

    def model(system, prompt):
        assert "YES or NO" in system
        if "fails" in prompt:
            raise RuntimeError
        return " yes, unclear\nIt has two readings.\n" if "is it?" in prompt else "NO"

    rows = run.scan(df, QA, [make(model) for make in judge.MODEL_SCANNERS.values()]).collect()
    assert sorted((r["scanner"], r["sample_index"]) for r in rows) == [("ambiguity", 0), ("answerability", 0), ("label_correctness", 0)]
    assert all(json.loads(r["metadata"])["llm_reasoning"] == "It has two readings." for r in rows)
    with pytest.raises(ValueError, match="model"):
        registry.select(["ambiguity"], registry.builtin())
    with pytest.raises(ValueError, match="unknown"):
        registry.select(["nothing"], registry.builtin())


def test_partitions_change_nothing(spark):
    df = records(spark, [(f"q{k % 7} this or that", f"Answer {k % 5}." if k % 3 else "that") for k in range(60)])
    f = run.numbered(run.scan(df.repartition(7), QA, list(registry.builtin().values())))
    g = run.numbered(run.scan(df.coalesce(1), QA, list(registry.builtin().values())))
    key = lambda x: [(r["id"], r["scanner"], r["sample_index"]) for r in x.orderBy("id").collect()]
    assert key(f) == key(g) and [i for i, *_ in key(f)] == list(range(len(key(f))))


def test_roles():
    assert fields.resolve_fields(["Question", "ANSWER", "idx", "ID"]) == FieldMap("Question", "ANSWER", "idx")
    assert fields.resolve_fields(["prompt", "question", "gold", "label"]) == FieldMap("question", "label", None)
    assert fields.resolve_fields(["x", "y", "id"], "x", "y") == FieldMap("x", "y", None)
    for bad in ([], ["question"], ["answer"]):
        with pytest.raises(ValueError):
            fields.resolve_fields(bad)


def test_annotations(spark, tmp_path):
    (tmp_path / "gt.md").write_text("---\nk: v\nk: w\n---\n\n# Title\n| a |\n")
    (tmp_path / "a.json").write_text(json.dumps({"id": "s1", "task_type": "page_roundtrip", "element_type": None, "pdf_path": "corpus/fin.pdf", "page_number": 1, "ground_truth_markdown_path": "gt.md"}))
    (tmp_path / "b.json").write_text(json.dumps({"id": "s2", "ground_truth_table": {"markdown": "| x |"}}))
    (tmp_path / "list.json").write_text("[1]")
    (tmp_path / "provenance.json").write_text("{bad")
    df, f = annotations.load_annotations(spark, str(tmp_path))
    got = df.orderBy("sample_index").collect()
    assert f == FieldMap("__task__", "gold_markdown", "id") and [r["__task__"] for r in got] == ["page_roundtrip corpus/fin.pdf#page=1", "b"]
    assert got[0]["gold_markdown"].startswith("# Title") and got[0]["__md_body_offset__"] == 5 and got[0]["__frontmatter__"] == {"k": "w"} and got[1]["gold_markdown"] == "| x |"
    (tmp_path / "c.json").write_text("{bad")
    with pytest.raises(ValueError, match="c.json"):
        annotations.load_annotations(spark, str(tmp_path))


def test_samples_and_chat(spark):
    rows = [{"input": [{"role": "system", "content": "s"}, {"role": "user", "content": "one"}, {"role": "user", "content": [{"type": "text", "text": "two"}, {"type": "image"}]}], "target": ["t", "u"], "id": 1, "metadata": {"topic": "x", "input": "kept out"}}, {"input": "plain", "target": None}]
    df, f = chat.load_samples(spark, rows)
    got = df.orderBy("sample_index").collect()
    assert [(r["input"], r["target"], r["id"], r["topic"]) for r in got] == [("two", "t", "1", "x"), ("plain", "", None, None)] and f.question == "input"


def test_tables_and_saved_scans(spark, tmp_path):
    spark.range(10).selectExpr("id AS i", "concat('q', id) AS question", "concat('a b c d e ', id) AS answer").coalesce(1).write.parquet(str(tmp_path / "d/train"))
    df = tables.load_table(spark, str(tmp_path / "d"), split="train", limit=6)
    assert [r["sample_index"] for r in df.orderBy("i").collect()] == list(range(6))
    result = run.run(df, dataset_name="d")
    report.save(result, tmp_path / "out", df, FieldMap("question", "answer"))
    s = findings.load_summary(str(tmp_path / "out"))
    assert s["total_samples"] == 6 and s["by_scanner"]["answer_length"] == {"total": 6, "high": 0, "medium": 6, "low": 0}
    back = findings.load_findings(spark, str(tmp_path / "out"))
    assert back.count() == s["total_findings"] and "answer_length" in report.render_saved(tmp_path / "out") and (tmp_path / "out/REPORT.md").read_text().startswith("#")
    t = triage.upsert(triage.upsert(spark.createDataFrame([], triage.TRIAGE), 0, "confirmed"), 1, "dismissed")
    assert [r["sample_index"] for r in triage.clean_indices(back, t, 6).collect()] == [1, 2, 3, 4, 5]
    triage.save_triage(t, tmp_path / "triage.json")
    assert triage.triage_counts(back, triage.load_triage(spark, tmp_path / "triage.json")).first()[:2] == (1, 1)
    with pytest.raises(ValueError):
        triage.upsert(t, 0, "odd")
    x = profile.Explorer()
    sid = x.load(df)
    assert x.records(sid, 2, 3).count() == 3 and x.schema(sid).count() == 3 and x.scan(sid, ["answer_length"]).count() == 6


def test_plugins(spark, tmp_path):
    (tmp_path / "own.py").write_text("from dqaudit.plans.registry import python_scanner\n\ndef find(rows, fields):\n    for r in rows:\n        if r['a'] == 'bad':\n            yield {'sample_index': r['sample_index'], 'sample_id': r['sample_id'], 'explanation': 'bad'}\n\nown = python_scanner('own', find)\n")
    plugins = registry.load_plugins(str(tmp_path / "own.py"))
    chosen = registry.select(["own"], registry.builtin(), plugins)
    assert [r["sample_index"] for r in run.scan(records(spark, [("q", "bad"), ("q", "good")]), QA, chosen).collect()] == [0]


def test_row_scanners_on_a_stream(spark, tmp_path):
    from dqaudit.streaming.row_local import scan_stream

    spark.createDataFrame([(0, "x or y", "y"), (1, "q", "a b c d e")], "n bigint, q string, a string").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("n bigint, q string, a string").parquet(str(tmp_path / "in"))
    out = scan_stream(src, FieldMap("q", "a"), "n", ("answer_length", "forced_choice_leakage"))
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["scanner"], r["sample_index"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("forced_choice_leakage", 0), ("answer_length", 1)}


def test_long_runs_of_articles_and_punctuation(spark):
    # a run in the middle, at the beginning and at the end; by recursion the first ended the executor
    run_, marks = "the a " * 20_000, "?" * 200_000
    texts = [f"x {run_}y or red", f"blue or {run_}red", f"red {run_}or {run_}", f"red{marks}x or blue{marks}", f"a{' ' * 200_000}b or red"]
    got = scan(records(spark, [(t, "red") for t in texts]), "forced_choice_leakage")
    assert [r["sample_index"] for r in got] == [0, 1, 4]
    from dqaudit.operators.row_scanners import forced_choice_rows

    rows = {r["sample_index"]: r["options"] for r in forced_choice_rows(fields.canonical(records(spark, [(t, "red") for t in texts]), QA)).collect()}
    assert rows[1] == ["blue", "red"] and rows[4] == ["b", "red"] and rows[0][0] == f"x {run_}y"


def test_frontmatter_of_many_keys(spark):
    # each key was looked for in all later ones, which were made again from the whole text for each
    keys, lines = 20_000, "".join(f"k{k % 15_000}: {k}\n" for k in range(20_000))
    df = spark.createDataFrame([(f"---\n{lines}---\n\nbody",), ("---\n" + "x\n" * 50_000,)], "t string")
    a, b = df.select(annotations.split_frontmatter(F.col("t")).alias("s")).collect()
    assert len(a.s.frontmatter) == 15_000 and a.s.frontmatter["k3"] == "15003" and a.s.frontmatter["k14999"] == "14999" and (a.s.body, a.s.offset) == ("body", keys + 3)
    assert (b.s.frontmatter, b.s.offset) == ({}, 0) and len(b.s.body) == 100_004


def test_python_scanner_sees_bounded_batches(spark):
    # 64 MB of texts in one partition: a Python scanner gets a few MB at once, and each record once
    def seen(rows, f):
        size = sum(len(r["q"]) for r in rows)
        return [{"sample_index": r["sample_index"], "sample_id": r["sample_id"], "explanation": str(size), "line": None if k else 7} for k, r in enumerate(rows)]

    df = spark.range(640, numPartitions=1).select(F.col("id").alias("sample_index"), F.repeat(F.lit("x"), 100_000).alias("q"), F.lit("b").alias("a"), F.col("id").cast("string").alias("id"))
    got = run.scan(df, QA, [registry.python_scanner("seen", seen)]).collect()
    assert sorted(r.sample_index for r in got) == list(range(640)) and max(int(r.explanation) for r in got) <= registry.SLICE
    assert {r.line for r in got} == {7, None} and all(r.sample_id == str(r.sample_index) and r.severity == "low" for r in got)
    odd = df.limit(3).withColumn("at", F.current_timestamp())  # a type that Spark converts
    assert len(run.scan(odd, QA, [registry.python_scanner("seen", seen)]).collect()) == 3


def test_session_scan_runs_its_scanners_once(spark):
    # long white space within a text took the square of its length, and the scanners ran once for the numbers and once for the rows
    long = f"x{' ' * 200_000}y"
    e = profile.Explorer()
    got = e.scan(e.load(records(spark, [(long, "1"), (f" {long}\n", "1"), ("z", "2")]), question="q", answer="a"), ["duplicate_questions"])
    assert "md5" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.sample_index, r.severity) for r in got.orderBy("id").collect()] == [(0, "high"), (1, "high")]
