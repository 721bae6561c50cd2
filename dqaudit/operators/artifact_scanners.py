"""Gold text against the outputs of extraction tools.

Both scanners take a tool table (sample_key, tool, text), see sources.artifacts, and join it with the records by id.  Tokens are made in one
pass over each side and travel as one array for a text: one exchange of each side, which aggregation and join share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqaudit.functions.text import find_line, py_lines
from dqaudit.functions.tokens import with_tokens
from dqaudit.model import FieldMap, Scanner, findings

LISTED_WORDS, LISTED_NUMBERS, KEPT = 12, 10, 50


def _truthy(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(False)
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    return F.coalesce(c != 0, F.lit(False)) if isinstance(kind, T.NumericType) else F.coalesce(c.cast("string") != "", F.lit(False))


def _gold(df: DataFrame) -> DataFrame:
    offset = F.coalesce(F.expr("try_cast(`__md_body_offset__` AS int)"), F.lit(0)) if "__md_body_offset__" in df.columns else F.lit(0)
    task = F.coalesce(F.col("task_type").cast("string"), F.lit("")) if "task_type" in df.columns else F.lit("")
    return df.where(~_truthy(df, "ocr_resistant")).select("sample_index", "sample_id", "a_raw", offset.alias("offset"), task.alias("task"))


def tool_tokens(tools: DataFrame, made: str) -> DataFrame:
    """sample_key, tools (sorted), every (tokens of any tool), each (tokens of all tools).  A record's tools are few, and a tool's tokens travel
    as one array."""
    own = with_tokens(tools.select("sample_key", "tool", F.coalesce("text", F.lit("")).alias("text")), "text", {"t": made}).select("sample_key", "tool", "t")
    got = own.groupBy("sample_key").agg(F.array_sort(F.collect_set("tool")).alias("tools"), F.collect_list("t").alias("ts"))
    each = F.aggregate(F.slice("ts", 2, F.greatest(F.size("ts") - 1, F.lit(0))), F.col("ts")[0], lambda x, y: F.array_intersect(x, y))
    return got.select("sample_key", "tools", F.array_distinct(F.flatten("ts")).alias("every"), each.alias("each"))


def recall_rows(df: DataFrame, tools: DataFrame, markdown: bool = True) -> DataFrame:
    """kind unsupported: gold words that no tool has, with the first's line; kind omitted (page tasks only): words that every tool
    and not the gold has.  words are sorted.  A gold text without words outside of math is left out.  With markdown=False the gold is plain
    text: its dollars, links and marks are text like any other."""
    made = {"gold": "gold_words", "covering": "covering_words"} if markdown else {"gold": "words", "covering": "words"}
    gold = with_tokens(_gold(df), "a_raw", made).where(F.size("gold") > 0)
    r = gold.join(tool_tokens(tools, "words"), F.col("sample_id") == F.col("sample_key"))
    kinds = F.array(
        F.struct(F.lit("unsupported").alias("kind"), F.array_sort(F.array_except("gold", "every")).alias("words")),
        F.struct(F.lit("omitted").alias("kind"), F.when(F.contains("task", F.lit("page")), F.array_sort(F.array_except("each", "covering"))).otherwise(F.array().cast("array<string>")).alias("words")),
    )
    r = r.withColumn("__k", F.explode(kinds)).select("*", "__k.kind", "__k.words").drop("__k").where(F.size("words") > 0)
    line = F.when(F.col("kind") == "unsupported", find_line(py_lines(F.col("a_raw")), F.col("words")[0]) + F.col("offset"))
    return r.withColumn("line", line)


def _listed(c: str, most: int) -> Column:
    more = F.size(c) - most
    return F.concat(F.array_join(F.slice(c, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))


def text_layer_recall(tools: DataFrame) -> Scanner:
    def plan(df: DataFrame, fields: FieldMap) -> DataFrame:
        r = recall_rows(df, tools)
        n, t = F.size("words").cast("string"), F.size("tools").cast("string")
        miss = F.col("kind") == "unsupported"
        why = F.when(miss, F.concat(n, F.lit(" gold words are in none of the "), t, F.lit(" tool outputs: "), _listed("words", LISTED_WORDS))).otherwise(F.concat(n, F.lit(" words that all "), t, F.lit(" tools found aren't in the gold: "), _listed("words", LISTED_WORDS)))
        meta = {"unsupported_words": F.when(miss, F.slice("words", 1, KEPT)), "omitted_words": F.when(~miss, F.slice("words", 1, KEPT)), "tools": F.col("tools")}
        return findings(r, "text_layer_recall", F.when(miss, "high").otherwise("medium"), "label_quality", why, meta, line=F.col("line"), within=F.when(miss, 0).otherwise(1))

    return Scanner("text_layer_recall", plan, "Gold words that no extraction tool saw, and words of all tools that the gold lacks.")


def numeric_rows(df: DataFrame, tools: DataFrame) -> DataFrame:
    """missing: gold numbers that no tool has, by length and text; line: of the first in its spelling in the gold."""
    gold = with_tokens(_gold(df), "a_raw", {"numbers": "gold_numbers"}).where(F.size("numbers") > 0)
    r = gold.join(tool_tokens(tools, "numbers"), F.col("sample_id") == F.col("sample_key"))
    missing = F.filter("numbers", lambda s: ~F.array_contains(F.col("every"), s.norm))
    ordered = F.array_sort(F.transform(missing, lambda s: F.struct(F.length(s.norm).alias("n"), s.norm.alias("norm"), s.spelling.alias("spelling"))))
    r = r.withColumn("__m", F.explode(F.array(ordered))).where(F.size("__m") > 0)  # made once: nothing moves through a generator
    line = find_line(py_lines(F.col("a_raw")), F.col("__m")[0]["spelling"]) + F.col("offset")
    return r.withColumn("missing", F.transform("__m", lambda s: s.norm)).withColumn("line", line).drop("__m")


def numeric_provenance(tools: DataFrame) -> Scanner:
    def plan(df: DataFrame, fields: FieldMap) -> DataFrame:
        r = numeric_rows(df, tools)
        why = F.concat(F.size("missing").cast("string"), F.lit(" numbers of the gold are in none of the "), F.size("tools").cast("string"), F.lit(" tool outputs: "), _listed("missing", LISTED_NUMBERS))
        return findings(r, "numeric_provenance", "high", "label_quality", why, {"missing_numbers": F.slice("missing", 1, KEPT), "tools": F.col("tools")}, line=F.col("line"))

    return Scanner("numeric_provenance", plan, "Gold numbers that no extraction tool saw.")
