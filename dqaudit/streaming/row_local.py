"""Record-local scanners on streams: they keep no state, so their plans run on readStream as they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqaudit.functions.text import py_strip, truthy_str, word_count
from dqaudit.model import FieldMap
from dqaudit.plans.registry import ROW_LOCAL, builtin
from dqaudit.plans.run import envelope


def stream_records(df: DataFrame, fields: FieldMap, index: str) -> DataFrame:
    """The canonical columns of a stream, which must bring a number for each record."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    sid = F.col(fields.id).cast("string") if fields.id else F.col(index).cast("string")
    out = df.withColumns({"sample_index": F.col(index).cast("bigint"), "sample_id": sid, "q_raw": truthy_str(F.col(fields.question), kinds[fields.question]), "a_raw": truthy_str(F.col(fields.answer), kinds[fields.answer])})
    out = out.withColumns({"q": py_strip(F.col("q_raw")), "a": py_strip(F.col("a_raw"))})
    return out.withColumns({"q_norm": F.lower("q"), "a_norm": F.lower("a"), "a_words": word_count(F.col("a"))})


def scan_stream(df: DataFrame, fields: FieldMap, index: str, names: tuple[str, ...] = ROW_LOCAL) -> DataFrame:
    """Findings of a stream; write it with writeStream in append mode."""
    records, own = stream_records(df, fields, index), builtin()
    return envelope(reduce(DataFrame.unionByName, [own[n].plan(records, fields) for n in names]))


def first_of_each(df: DataFrame, fields: FieldMap, index: str, time: str, delay: str) -> DataFrame:
    """Of records that repeat a question within the delay the first, with state bounded by the watermark."""
    records = stream_records(df, fields, index).withColumn("__q", F.md5("q_norm"))
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark(["__q"]).drop("__q")
