"""Queries of sources, text functions, triage and record views over whole tables, with SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqaudit.functions.images import data_url
from dqaudit.functions.text import find_line, py_lines
from dqaudit.functions.tokens import strip_markdown
from dqaudit.model import FieldMap
from dqaudit.operators import judge, profile, triage
from dqaudit.plans import fields, registry, run
from dqaudit.plans.queries import _A, _Q, CHOICE, DOCS, FOUND, IMAGES, MARKDOWN, PAIRS, QA, TRIAGE, _DUP, canon, query, rows, strip
from dqaudit.sources import annotations, artifacts, chat, tables

# --- sources ------------------------------------------------------------------------------------------------------------------


@query(sql="SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS sample_index FROM orders")
def dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return fields.with_index(orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "sample_index")


@query(sql="SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i < 1000")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row limit: the first 1000 in order."""
    own = fields.with_index(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), ["o_orderkey"])
    return own.where(F.col("sample_index") < 1000).select("o_orderkey")


@query(sql="SELECT count(*) AS n, min(sample_index) AS low, max(sample_index) AS high, count(DISTINCT sample_index) AS different, sum(length(text)) AS chars FROM (SELECT row_number() OVER () - 1 AS sample_index, text FROM documents)")
def table_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tables.load_table(spark, f"{sf_dir}/documents.parquet")
    return got.agg(F.count("*").alias("n"), F.min("sample_index").alias("low"), F.max("sample_index").alias("high"), F.count_distinct("sample_index").alias("different"), F.sum(F.length("text")).alias("chars"))


FRONT = """SELECT doc_id AS sample_index, CASE doc_id % 4
  WHEN 0 THEN concat('---', chr(10), 'source: ', source, chr(10), 'n : ', CAST(n_chars AS VARCHAR(20)), chr(10), 'lang: x', chr(10), 'lang: ', lang, chr(10), '---', chr(10), chr(10), text)
  WHEN 1 THEN concat('---', chr(10), 'lang: ', lang, chr(10), '---', chr(10), 'x', text) WHEN 2 THEN concat('---', chr(10), text) ELSE text END AS whole, lang, source, n_chars, text FROM {documents}"""


@query(FRONT, """SELECT sample_index, CASE WHEN sample_index % 4 < 2 THEN lang END AS lang, CASE WHEN sample_index % 4 = 0 THEN source END AS source, CASE WHEN sample_index % 4 = 0 THEN CAST(n_chars AS VARCHAR) END AS n,
  (CASE sample_index % 4 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 0 END)::INT AS offset_lines, md5(CASE sample_index % 4 WHEN 0 THEN text WHEN 1 THEN 'x' || text ELSE whole END) AS body FROM {r} AS r""")
def frontmatter(r: DataFrame) -> DataFrame:
    s = r.withColumn("s", F.explode(F.array(annotations.split_frontmatter(F.col("whole")))))
    front = F.col("s")["frontmatter"]
    return s.select("sample_index", *[F.try_element_at(front, F.lit(k)).alias(k) for k in ("lang", "source", "n")], F.col("s")["offset"].alias("offset_lines"), F.md5(F.col("s")["body"]).alias("body"))


@query(DOCS, "SELECT sample_index, concat_ws(' ', nullif(CASE WHEN sample_index % 3 > 0 THEN answer END, ''), concat('d', sample_index::VARCHAR, '.pdf#page=', (sample_index % 5)::VARCHAR)) AS task FROM {r} AS r")
def task_text(r: DataFrame) -> DataFrame:
    own = r.select("sample_index", F.when(F.col("sample_index") % 3 > 0, F.col("answer")).alias("task_type"), F.concat(F.lit("d"), F.col("sample_index").cast("string"), F.lit(".pdf")).alias("source"), (F.col("sample_index") % 5).alias("page_number"))
    return own.select("sample_index", annotations.task_of(own, F.lit("stem")).alias("task"))


@query(sql="SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'user'), arg_min(text, turn), '') AS question FROM conversations GROUP BY conv_id")
def chat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lists of messages."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return c.select("conv_id", chat.message_text(F.col("messages"), c.schema["messages"].dataType).alias("question"))


@query(sql="SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN text ELSE role END AS target FROM conversations")
def first_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    several = F.when(F.col("turn") % 3 == 1, F.array("text", "role")).when(F.col("turn") % 3 == 2, F.array("role")).otherwise(F.array().cast("array<string>"))
    c = c.withColumn("target", several)
    return c.select("conv_id", "turn", chat.first_target(F.col("target"), c.schema["target"].dataType).alias("target"))


FILES = """SELECT CAST(doc_id AS VARCHAR(20)) AS sample_key, file_name, CASE WHEN file_name = 'b.txt' AND doc_id % 2 = 0 THEN ' ' WHEN file_name = 'a.txt' THEN concat('hy-', chr(10), 'phen ', text) ELSE concat(file_name, text) END AS text
  FROM {documents} CROSS JOIN (SELECT 'a.md' AS file_name UNION ALL SELECT 'a.txt' UNION ALL SELECT 'b.txt' UNION ALL SELECT 'index.md' UNION ALL SELECT 'ground_truth_1.md' UNION ALL SELECT 'page.png') AS f"""


@query(FILES, "SELECT sample_key, file_name[1] AS tool, md5(replace(text, '-' || chr(10), '')) AS text FROM {r} AS r WHERE file_name = 'a.txt' OR (file_name = 'b.txt' AND text <> ' ')")
def tool_files(r: DataFrame) -> DataFrame:
    return artifacts.tool_rows(r).select("sample_key", "tool", F.md5("text").alias("text"))


# --- text ---------------------------------------------------------------------------------------------------------------------


@query(DOCS, "SELECT sample_index, nullif(list_position(list_transform(string_split(question, chr(10)), lambda x: contains(lower(x), answer)), true), 0)::INT AS line FROM {r} AS r")
def needle_lines(r: DataFrame) -> DataFrame:
    """The first line of each document that holds its language's code in any case."""
    return r.select("sample_index", find_line(py_lines(F.col("question")), F.upper("answer")).alias("line"))


MARKED = """SELECT sample_index, concat('# Title of **', CAST(sample_index AS VARCHAR(20)), '**', chr(10), answer, chr(10), 'see [this `link`](http://x.y/z) and ![an image](a.png)', chr(10), '$a_1$ costs $$5', chr(10), '6$$ or', chr(10), '##not a head') AS answer FROM ({m}) AS m"""


@query(MARKED.replace("{m}", MARKDOWN), r"""SELECT sample_index, md5(array_to_string(list_transform(list_filter(list_transform(
  string_split(regexp_replace(answer, '(?s:\$\$.*?\$\$)|\$[^$\n]*\$', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: NOT regexp_full_match(x, '\|[\s:|-]+')),
  lambda x: regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(x, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '^#{1,6}\s+', ''), '|', ' '), '\*\*|`', '', 'g')), chr(10))) AS plain FROM {r} AS r""")
def plain_markdown(r: DataFrame) -> DataFrame:
    return r.select("sample_index", F.md5(strip_markdown(F.col("answer"))).alias("plain"))


@query(IMAGES, """SELECT sample_index, 'data:' || CASE sample_index % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 4 THEN 'image/webp'
  ELSE CASE sample_index % 7 WHEN 0 THEN 'image/png' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/bmp' WHEN 4 THEN 'image/webp' WHEN 5 THEN 'image/tiff' ELSE 'image/jpeg' END END || ';base64,' || base64(unhex(hexed)) AS url FROM {r} AS r""")
def image_urls(r: DataFrame) -> DataFrame:
    return r.select("sample_index", data_url(F.col("path"), F.unhex("hexed")).alias("url"))


# --- judged -------------------------------------------------------------------------------------------------------------------


def _long(system: str, prompt: str) -> str:
    """A stub for a model, which fails where it isn't told what to do: long prompts are ambiguous."""
    if "YES or NO" not in system:
        raise ValueError("no system message")
    return "YES\nlong" if len(prompt) > 400 else "NO"


_FRAME = len("Could a careful reader understand this question in more than one way, so that different answers are right?\n\nQuestion: \nRecorded answer: \n\nYES if it is ambiguous, NO if it is clear.")


@query(PAIRS, f"SELECT sample_index, 'medium' AS severity, 'question_quality' AS category FROM {{r}} AS r WHERE {_Q} <> '' AND length({_Q}) + length({_A}) + {_FRAME} > 400")
def judged_ambiguity(r: DataFrame) -> DataFrame:
    return judge.ambiguity(_long).plan(canon(r), QA).select("sample_index", "severity", "category")


# --- runs and plugins ---------------------------------------------------------------------------------------------------------


def _every_97th(records: list[dict], f: FieldMap) -> list[dict]:
    return [{"sample_index": x["sample_index"], "sample_id": x["sample_id"], "severity": "high", "explanation": f"{len(x[f.question])} characters"} for x in records if len(x[f.question]) % 97 == 0]


@query(DOCS, "SELECT sample_index, sample_index::VARCHAR AS sample_id, 'every_97th' AS scanner, 'high' AS severity, length(question)::VARCHAR || ' characters' AS explanation FROM {r} AS r WHERE length(question) % 97 = 0")
def python_plugin(r: DataFrame) -> DataFrame:
    found = run.scan(r, QA, [registry.python_scanner("every_97th", _every_97th)])
    return found.select("sample_index", "sample_id", "scanner", "severity", "explanation")


@registry.scanner("Short questions.")
def short_question(df: DataFrame, f: FieldMap) -> DataFrame:
    from dqaudit.model import findings

    return findings(df.where(F.length("q") < 300), "short_question", "low", "question_quality", F.col("q"), {"length": F.length("q")})


@query(DOCS, f"SELECT sample_index, row_number() OVER (ORDER BY sample_index) - 1 AS id, 'short_question' AS scanner, '{{\"length\":' || length({strip('question')})::VARCHAR || '}}' AS metadata FROM {{r}} AS r WHERE length({strip('question')}) < 300".replace("{{", "{").replace("}}", "}"))
def declared_plugin(r: DataFrame) -> DataFrame:
    """A decorated plan among the scanners, with the numbers of a run."""
    return run.run(r, QA, [short_question]).findings.select("sample_index", "id", "scanner", "metadata")


@query(DOCS, "SELECT count(*) AS total_samples, 'docs' AS dataset_name, 'test' AS split, (SELECT count(*) FROM {r} AS x WHERE length(question) % 97 = 0) AS total_findings FROM {r} AS r")
def run_counts(r: DataFrame) -> DataFrame:
    got = run.run(r, QA, [registry.python_scanner("every_97th", _every_97th)], dataset_name="docs", split="test")
    return r.sparkSession.createDataFrame([(got.total_samples, got.dataset_name, got.split, got.findings.count())], "total_samples long, dataset_name string, split string, total_findings long")


@query(CHOICE, "SELECT sample_index AS \"index\", question, answer FROM {r} AS r")
def sample_records(r: DataFrame) -> DataFrame:
    return fields.samples(r, QA)


# --- triage -------------------------------------------------------------------------------------------------------------------


@query(TRIAGE, "SELECT finding_id, status FROM {r} AS r WHERE finding_id NOT IN (1, 2, 3) UNION ALL SELECT 1, 'confirmed' UNION ALL SELECT 3, 'dismissed'")
def triage_upsert(r: DataFrame) -> DataFrame:
    for at, status in ((1, "confirmed"), (2, "pending"), (3, "confirmed"), (3, "dismissed")):
        r = triage.upsert(r, at, status)
    return r


@query(FOUND, "SELECT scanner AS slug, count(*) AS total, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM {r} AS r GROUP BY scanner")
def datasets_with_findings(r: DataFrame) -> DataFrame:
    return triage.dataset_list(r.withColumnRenamed("scanner", "slug"))


@query(FOUND, "SELECT id, scanner, severity, sample_index FROM {r} AS r WHERE sample_index = 7")
def findings_of_sample(r: DataFrame) -> DataFrame:
    return triage.of_sample(r, 7)


@query(FOUND, "SELECT id, (sample_index - CASE WHEN id % 3 = 0 THEN 0 ELSE id % 5 END)::BIGINT AS body_line FROM {r} AS r")
def body_lines(r: DataFrame) -> DataFrame:
    return r.select("id", triage.body_line(F.col("sample_index"), F.when(F.col("id") % 3 != 0, F.col("id") % 5)).cast("bigint").alias("body_line"))


@query(FOUND, "SELECT id FROM {r} AS r WHERE severity = 'medium' AND scanner = 'view'")
def findings_filtered(r: DataFrame) -> DataFrame:
    return triage.filtered(r, scanner="view", severity="medium").select("id")


# --- record views -------------------------------------------------------------------------------------------------------------


@query(sql="SELECT * FROM (VALUES ('doc_id', 'int'), ('text', 'str'), ('lang', 'str'), ('source', 'str'), ('n_chars', 'int')) AS t(name, type)")
def table_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = profile.schema_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return spark.createDataFrame([(f["name"], f["type"]) for f in got], "name string, type string")


@query(sql="SELECT doc_id, octet_length(encode(text)) AS size, 'bytes' AS kind, lang FROM documents")
def safe_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes as what stands for them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode("text", "utf-8").alias("text"), "lang", F.lit(1).alias("__hidden"))
    safe = profile.json_safe(docs)
    return safe.select("doc_id", F.col("text")["size"].cast("bigint").alias("size"), F.col("text")["__type"].alias("kind"), "lang")


@query(sql="SELECT doc_id AS sample_index, lang, md5(text) AS text FROM documents WHERE doc_id = 7")
def one_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("doc_id", "sample_index")
    return profile.record(docs, 7).select("sample_index", "lang", F.md5("text").alias("text"))


@query(sql="SELECT quantile_disc(length(text), 0.9)::BIGINT AS width FROM documents WHERE doc_id < 50")
def grid_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a grid's first rows: the limit is the feature."""
    return profile.display_width(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", index="doc_id")


@query(sql="SELECT doc_id AS __index, lang, source FROM documents WHERE doc_id BETWEEN 20 AND 219")
def session_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a loaded session: the limit is the feature."""
    e = profile.Explorer()
    sid = e.load(spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("doc_id", "sample_index"), question="text", answer="lang")
    return e.records(sid, 20, 200).select("__index", "lang", "source")


@query(DOCS, _DUP + "SELECT sample_index, CASE WHEN agree THEN 'high' ELSE 'low' END AS severity FROM n JOIN g USING (q)")
def session_scan(r: DataFrame) -> DataFrame:
    e = profile.Explorer()
    return e.scan(e.load(r), ["duplicate_questions"]).select("sample_index", "severity")


# --- the catalogs -------------------------------------------------------------------------------------------------------------


@query(sql="SELECT 'text' AS question, 'label' AS answer, NULL::VARCHAR AS id")
def field_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fields.resolve_fields(spark.read.parquet(f"{sf_dir}/labels.parquet").columns + ["text", "label"])
    return spark.createDataFrame([(got.question, got.answer, got.id)], "question string, answer string, id string")


_NAMES = "answer_length duplicate_questions inconsistent_format answer_distribution binary_question_ratio forced_choice_leakage encoding_issues extraction_artifacts image_mime_type markdown_integrity text_layer_recall numeric_provenance"
_JUDGED = "ambiguity label_correctness answerability"


@query(sql=f"SELECT unnest(string_split('{_NAMES}', ' ')) AS name, false AS needs_model UNION ALL SELECT unnest(string_split('{_JUDGED}', ' ')), true")
def scanner_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.catalog(spark).select("name", "needs_model")
