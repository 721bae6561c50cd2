"""Resolution of roles, and the canonical projection that all scanners share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dqaudit.functions.text import plain_str, py_strip, truthy_str, word_count
from dqaudit.model import FieldMap

QUESTION = ("question", "prompt", "input", "text", "query", "instruction")
ANSWER = ("answer", "label", "target", "output", "response", "gold")
ID = ("id", "sample_id", "idx", "index", "qid")


def detect(columns: list[str], candidates: tuple[str, ...]) -> str | None:
    """The first candidate that is a column as it is written, else the first in any case (of two such columns the later)."""
    for c in candidates:
        if c in columns:
            return c
    lower = {c.lower(): c for c in columns}
    return next((lower[c] for c in candidates if c in lower), None)


def auto_detect(columns: list[str]) -> FieldMap:
    q, a = detect(columns, QUESTION), detect(columns, ANSWER)
    if q is None or a is None:
        what = " and ".join(n for n, c in (("question", q), ("answer", a)) if c is None)
        raise ValueError(f"no {what} column among {columns}; name it explicitly")
    return FieldMap(q, a, detect(columns, ID))


def resolve_fields(columns: list[str], question: str | None = None, answer: str | None = None, id: str | None = None, image: str | None = None) -> FieldMap:
    """Explicit roles first; with both question and answer given nothing is detected, else the rest is.  An image is never detected."""
    if not columns:
        raise ValueError("the dataset is empty")
    for role, c in (("question", question), ("answer", answer), ("id", id), ("image", image)):
        if c is not None and c not in columns:
            raise ValueError(f"{role} column {c!r} isn't among {columns}")
    if question and answer:
        return FieldMap(question, answer, id, image)
    q, a = question or detect(columns, QUESTION), answer or detect(columns, ANSWER)
    if q is None or a is None:
        auto_detect([c for c in columns])
        raise ValueError(f"no question or answer column among {columns}")
    return FieldMap(q, a, id or detect(columns, ID), image)


def with_index(df: DataFrame, order_by: list[str] | None = None, name: str = "sample_index") -> DataFrame:
    """Adds a dense 0-based index.

    With order_by: the rank in that order, from counts of range partitions and a number within each, so that no task holds the table;
    without: the order of the source's partitions and rows.
    """
    src = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by) if order_by else df
    src = src.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    counts = src.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__low"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__part", "__low", "__before")
    return src.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at") - F.col("__low")).drop("__part", "__at", "__low", "__before")


def canonical(df: DataFrame, fields: FieldMap) -> DataFrame:
    """df with sample_index (added in source order where absent), sample_id, q_raw, a_raw (unstripped), q, a (stripped), q_norm, a_norm
    (lower case) and a_words; its own columns stay."""
    if "sample_index" not in df.columns:
        df = with_index(df)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    sid = F.col(f"`{fields.id}`").cast("string") if fields.id else F.col("sample_index").cast("string")
    out = df.withColumns({"sample_id": sid, "q_raw": truthy_str(F.col(f"`{fields.question}`"), kinds[fields.question]), "a_raw": truthy_str(F.col(f"`{fields.answer}`"), kinds[fields.answer])})
    out = out.withColumns({"q": py_strip(F.col("q_raw")), "a": py_strip(F.col("a_raw"))})
    return out.withColumns({"q_norm": F.lower("q"), "a_norm": F.lower("a"), "a_words": word_count(F.col("a"))})


def samples(df: DataFrame, fields: FieldMap) -> DataFrame:
    """index, question, answer and, where it is mapped, id of all records; null renders as None."""
    if "sample_index" not in df.columns:
        df = with_index(df)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cols = [F.col("sample_index").alias("index")] + [plain_str(F.col(f"`{c}`"), kinds[c]).alias(n) for n, c in (("question", fields.question), ("answer", fields.answer))]
    return df.select(*cols, *([F.col(f"`{fields.id}`").alias("id")] if fields.id else []))
