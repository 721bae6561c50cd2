"""Column profiles, paging and JSON-safe rendering of records."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqaudit.functions.images import data_url
from dqaudit.model import FieldMap
from dqaudit.plans import registry, run
from dqaudit.plans.fields import resolve_fields, with_index

PAGE, MOST = 100, 500
PROFILE = "name string, type string, null_count bigint, total bigint, min_length bigint, max_length bigint, avg_length double, unique_count bigint, min double, max double, mean double"


def label(kind: T.DataType) -> str:
    """A column type's label."""
    if isinstance(kind, T.StructType):
        return "image" if {"bytes", "path"} <= set(kind.fieldNames()) else "dict"
    if isinstance(kind, T.MapType):
        return "dict"
    if isinstance(kind, T.ArrayType):
        return "list"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "int"
    if isinstance(kind, T.FloatType | T.DoubleType):
        return "float"
    return "image" if isinstance(kind, T.BinaryType) else "str"


def shown(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if not f.name.startswith("__")]


def schema_of(df: DataFrame) -> list[dict]:
    """name and type of the columns, from metadata alone."""
    return [{"name": f.name, "type": label(f.dataType)} for f in shown(df)]


def profile(df: DataFrame) -> DataFrame:
    """One row for each column: counts, lengths (to one decimal) and distinct values of text, range and mean (to four) of numbers.

    Counts, lengths and ranges of all columns are one aggregation; distinct values are counted by column, each over its md5.
    """
    fields = shown(df)
    if not fields:
        return df.sparkSession.createDataFrame([], PROFILE)
    aggs: list[Column] = []
    for k, f in enumerate(fields):
        c, what = F.col(f"`{f.name}`"), label(f.dataType)
        text, number = what == "str", what in ("int", "float")
        n = F.length(c.cast("string"))
        aggs.append(F.struct(
            F.lit(k).alias("k"), F.lit(f.name).alias("name"), F.lit(what).alias("type"), F.count_if(c.isNull()).alias("null_count"), F.count(F.lit(1)).alias("total"),
            (F.min(n) if text else F.lit(None)).cast("bigint").alias("min_length"), (F.max(n) if text else F.lit(None)).cast("bigint").alias("max_length"), (F.round(F.sum(n) / F.count(c), 1) if text else F.lit(None)).cast("double").alias("avg_length"),
            (F.min(c) if number else F.lit(None)).cast("double").alias("min"), (F.max(c) if number else F.lit(None)).cast("double").alias("max"), (F.round(F.avg(c), 4) if number else F.lit(None)).cast("double").alias("mean"),
        ))
    out = df.agg(F.array(*[a.alias(f"c{k}") for k, a in enumerate(aggs)]).alias("__a")).select(F.explode("__a").alias("__r")).select("__r.*")
    texts = [(k, f) for k, f in enumerate(fields) if label(f.dataType) == "str"]
    if texts:
        each = [df.select(F.md5(F.col(f"`{f.name}`").cast("string")).alias("h")).where("h IS NOT NULL").distinct().agg(F.count("*").alias("unique_count")).select(F.lit(k).alias("k"), "unique_count") for k, f in texts]
        out = out.join(F.broadcast(reduce(DataFrame.unionByName, each)), "k", "left")
    else:
        out = out.withColumn("unique_count", F.lit(None).cast("bigint"))
    return out.select(*[x.split()[0] for x in PROFILE.split(", ")])


def json_safe(df: DataFrame) -> DataFrame:
    """Without hidden columns; images and bytes as what stands for them."""

    def safe(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if label(f.dataType) == "image" and isinstance(f.dataType, T.StructType):
            return F.when(c.isNotNull(), F.struct(F.lit("image").alias("__type"), c["path"].alias("path"))).alias(f.name)
        if isinstance(f.dataType, T.BinaryType):
            return F.when(c.isNotNull(), F.struct(F.lit("bytes").alias("__type"), F.length(c).alias("size"))).alias(f.name)
        if isinstance(f.dataType, T.NumericType | T.BooleanType | T.StringType | T.ArrayType | T.MapType | T.StructType):
            return c.alias(f.name)
        return c.cast("string").alias(f.name)

    return df.select(*[safe(f) for f in shown(df)])


def page(df: DataFrame, offset: int = 0, limit: int = PAGE, index: str = "sample_index") -> DataFrame:
    """Records offset to offset + limit (MOST at most) with __index, by a range predicate on the index."""
    lo, n = max(0, offset), max(1, min(limit, MOST))
    own = df.where((F.col(index) >= lo) & (F.col(index) < lo + n))
    return json_safe(own.withColumnRenamed(index, "page_index")).withColumnRenamed("page_index", "__index").orderBy("__index")


def record(df: DataFrame, at: int, index: str = "sample_index") -> DataFrame:
    """One record, its images as data URLs."""
    own = df.where(F.col(index) == at)
    for f in shown(df):
        if label(f.dataType) == "image" and isinstance(f.dataType, T.StructType) and isinstance(f.dataType["bytes"].dataType, T.BinaryType):
            c = F.col(f"`{f.name}`")
            own = own.withColumn(f.name, F.when(c["bytes"].isNotNull(), data_url(F.coalesce(c["path"], F.lit("")), c["bytes"])))
    return own.select(*[f.name for f in shown(own)])


def display_width(df: DataFrame, column: str, rows: int = 50, index: str = "sample_index") -> DataFrame:
    """The 90th percentile of the lengths of a column's first rows, which a grid takes for its width."""
    own = df.where(F.col(index) < rows).select(F.length(F.coalesce(F.col(column).cast("string"), F.lit(""))).alias("n"))
    return own.agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY n)").cast("bigint").alias("width"))


class Explorer:
    """Sessions over tables: loaded, profiled, paged and scanned by id."""

    def __init__(self) -> None:
        self.sessions: dict[str, tuple[DataFrame, FieldMap]] = {}

    def load(self, df: DataFrame, **roles: str | None) -> str:
        try:
            fields = resolve_fields([f.name for f in shown(df)], **roles)
        except ValueError:
            if any(roles.values()):
                raise
            fields = FieldMap("", "")
        sid = uuid.uuid4().hex
        self.sessions[sid] = (df if "sample_index" in df.columns else with_index(df), fields)
        return sid

    def _of(self, sid: str) -> tuple[DataFrame, FieldMap]:
        if sid not in self.sessions:
            raise KeyError(f"no session {sid}")
        return self.sessions[sid]

    def schema(self, sid: str) -> DataFrame:
        return profile(self._of(sid)[0].drop("sample_index"))

    def records(self, sid: str, offset: int = 0, limit: int = PAGE) -> DataFrame:
        return page(self._of(sid)[0], offset, limit)

    def record(self, sid: str, at: int) -> DataFrame:
        return record(self._of(sid)[0], at)

    def scan(self, sid: str, names: list[str] | None = None, judge=None) -> DataFrame:
        df, fields = self._of(sid)
        if not fields.question:
            raise ValueError("the session has no question and answer columns")
        from dqaudit.operators.judge import MODEL_SCANNERS

        models = {n: make(judge) for n, make in MODEL_SCANNERS.items()} if judge else {}
        default = registry.builtin()
        chosen = registry.select(names, default | models if names else default)
        return run.envelope(run.numbered(run.materialized(run.scan(df, fields, chosen))))
