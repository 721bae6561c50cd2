"""Model-judged scanners: prompts and verdicts are Column expressions, only the model's calls run in Python.

A judge is any picklable callable from a system message and a prompt to a reply (None, an empty reply or an exception: no verdict).
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqaudit.functions.text import py_strip, truthy_str
from dqaudit.model import FieldMap, Scanner, findings

Judge = Callable[[str, str], str]
CONCURRENCY = 20
SYSTEM = "You review items of evaluation datasets. Say YES or NO in the first line, and your reasons in the lines after it."
CONTEXT = ("context", "passage", "paragraph", "text", "document", "input_text")


def flagged(reply: Column) -> Column:
    """Whether the reply's first line, stripped, begins with YES in any case."""
    return F.coalesce(F.upper(py_strip(F.split(py_strip(reply), r"\n")[0])).startswith("YES"), F.lit(False))


def reasoning(reply: Column) -> Column:
    """The stripped reply after its first line; empty for a reply of one line."""
    return py_strip(F.regexp_replace(py_strip(reply), r"^[^\n]*\n?", ""))


def judged(df: DataFrame, judge: Judge, concurrency: int = CONCURRENCY) -> DataFrame:
    """df with reply; at most ``concurrency`` calls are under way in a task.  A call that fails leaves an empty reply."""

    def ask(prompt: str) -> str:
        try:
            return judge(SYSTEM, prompt) or ""
        except Exception:
            logging.getLogger(__name__).exception("a judge's call failed")
            return ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                yield b.assign(reply=list(pool.map(ask, b["prompt"])))

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("reply", T.StringType())]))


def ambiguity_prompts(df: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Could a careful reader understand this question in more than one way, so that different answers are right?\n\nQuestion: "), F.col("q"), F.lit("\nRecorded answer: "), F.col("a"), F.lit("\n\nYES if it is ambiguous, NO if it is clear."))
    return df.where("q <> ''").withColumn("prompt", text)


def label_prompts(df: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Is the recorded answer to this question wrong?\n\nQuestion: "), F.col("q"), F.lit("\nRecorded answer: "), F.col("a"), F.lit("\n\nYES if it is wrong, NO if it is right or can't be told."))
    return df.where("q <> '' AND a <> ''").withColumn("prompt", text)


def answerability_prompts(df: DataFrame, fields: FieldMap) -> DataFrame:
    """context_field: the first of CONTEXT that is a column, neither question nor answer, and not blank in the record."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in CONTEXT if c in kinds and c not in (fields.question, fields.answer)]
    value = {c: py_strip(truthy_str(F.col(c), kinds[c])) for c in cols}
    none = F.lit(None).cast("string")
    df = df.where("q <> ''").withColumn("context_field", F.coalesce(*[F.when(v != "", F.lit(c)) for c, v in value.items()], none)).withColumn("__context", F.coalesce(*[F.when(v != "", v) for v in value.values()], none))
    item = F.concat(F.lit("\n\nQuestion: "), F.col("q"), F.lit("\nRecorded answer: "), F.col("a"))
    with_ = F.concat(F.lit("Is the context below insufficient to answer the question?\n\nContext: "), F.col("__context"), item, F.lit("\n\nYES if it can't be answered from the context, NO if it can."))
    without = F.concat(F.lit("Does this question lack something that is needed to answer it, such as a text or picture that it refers to?"), item, F.lit("\n\nYES if it can't be answered as it stands, NO if it can."))
    return df.withColumn("prompt", F.when(F.col("context_field").isNotNull(), with_).otherwise(without)).drop("__context")


def _scanner(name: str, category: str, severity: str, prompts, say: str, what: str) -> Callable[..., Scanner]:
    def make(judge: Judge, concurrency: int = CONCURRENCY) -> Scanner:
        def plan(df: DataFrame, fields: FieldMap) -> DataFrame:
            rows = prompts(df, fields)
            keep = ["sample_index", "sample_id", "q", "a", "prompt", *(["context_field"] if "context_field" in rows.columns else [])]
            r = judged(rows.select(*keep), judge, concurrency).where(flagged(F.col("reply"))).withColumn("why", reasoning(F.col("reply")))
            meta = {"question": F.col("q"), "answer": F.col("a"), "llm_reasoning": F.col("why"), "llm_raw_response": F.col("reply")}
            if "context_field" in keep:
                meta |= {"has_context": F.col("context_field").isNotNull(), "context_field": F.col("context_field")}
            return findings(r, name, severity, category, F.concat(F.lit(say), F.col("why")), meta)

        return Scanner(name, plan, what, needs_model=True)

    return make


ambiguity = _scanner("ambiguity", "question_quality", "medium", lambda df, f: ambiguity_prompts(df), "The model finds the question ambiguous: ", "Questions that a model finds ambiguous.")
label_correctness = _scanner("label_correctness", "label_quality", "high", lambda df, f: label_prompts(df), "The model finds the recorded answer wrong: ", "Answers that a model finds wrong.")
answerability = _scanner("answerability", "question_quality", "medium", answerability_prompts, "The model finds that the question can't be answered: ", "Questions that a model finds unanswerable.")
MODEL_SCANNERS = {"ambiguity": ambiguity, "label_correctness": label_correctness, "answerability": answerability}


class StubJudge:
    """Answers by the first of its (part of the prompt, reply) rules that fits; for tests and dry runs."""

    def __init__(self, rules: list[tuple[str, str]], default: str = "NO\nNothing found."):
        self.rules, self.default = rules, default

    def __call__(self, system: str, prompt: str) -> str:
        return next((reply for part, reply in self.rules if part in prompt), self.default)
