"""Folders of JSON annotations with Markdown sidecars."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqaudit.functions.text import SPACES, py_strip
from dqaudit.model import FieldMap
from dqaudit.plans.fields import with_index

_KEEP_ENDS = r"(?<=[\n\x0b\x0c\x1c\x1d\x1e\x85  ])|(?<=\r)(?!\n)"


def _kept_lines(c: Column) -> Column:
    """str.splitlines(keepends=True)."""
    return F.filter(F.split(c, _KEEP_ENDS, -1), lambda x: x != "")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value made once for each row: a lambda evaluates what it only mentions again for each item."""
    return F.transform(F.array(value), then)[0]


def split_frontmatter(text: Column) -> Column:
    """struct(frontmatter map, body, offset): the flat ``key: value`` lines between a first line --- and the next one, the text after it
    (and after one blank line), and the number of lines before the body.  Without both fences the text is all body.  Of keys that
    repeat the last counts."""
    kind = "struct<frontmatter:map<string,string>,body:string,offset:int>"

    def front(lines: Column, close: Column) -> Column:
        inner = F.filter(F.slice(lines, 2, F.greatest(close - 2, F.lit(0))), lambda x: F.contains(x, F.lit(":")))
        pairs = F.transform(inner, lambda x, i: F.struct(py_strip(F.substring_index(x, ":", 1)).alias("k"), i.alias("i"), py_strip(F.regexp_replace(x, r"(?s)^[^:]*:", "")).alias("v")))
        # sorted by key and place, the last of a key is the one before another key
        last = _once(F.array_sort(pairs), lambda s: F.filter(s, lambda p, j: F.coalesce(F.get(s, j + 1)["k"] != p["k"], F.lit(True))))
        placed = F.array_sort(F.transform(last, lambda p: F.struct(p["i"].alias("i"), p["k"].alias("k"), p["v"].alias("v"))))
        return F.map_from_entries(F.transform(placed, lambda p: F.struct(p["k"], p["v"])))

    def parts(lines: Column, close: Column) -> Column:
        n = F.size(lines)
        blank = py_strip(F.coalesce(F.get(lines, close), F.lit("x"))) == ""
        offset = close + F.when(blank & (close < n), 1).otherwise(0)
        fenced = _once(offset, lambda o: F.struct(front(lines, close).alias("frontmatter"), F.array_join(F.slice(lines, o + 1, F.greatest(n - o, F.lit(0))), "").alias("body"), o.alias("offset")).cast(kind))
        return F.when(close > 1, fenced)

    def opened(lines: Column) -> Column:
        rest = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
        close = F.array_position(F.transform(rest, lambda x: py_strip(x) == "---"), True).cast("int") + 1  # 1-based line of the closing fence
        return F.when(py_strip(F.coalesce(F.get(lines, F.lit(0)), F.lit(""))) == "---", _once(close, lambda c: parts(lines, c)))

    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    whole = F.struct(none.alias("frontmatter"), text.alias("body"), F.lit(0).alias("offset")).cast(kind)
    return F.coalesce(F.when(F.ltrim(text, F.lit(SPACES)).startswith("---"), _once(_kept_lines(text), opened)), whole)


def _whole(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path (plain) and text (with \\n line ends) of files."""
    df = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("__uri"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"))
    return df.select(F.url_decode(F.regexp_replace(F.replace(F.col("__uri"), F.lit("+"), F.lit("%2B")), "^file:/*", "/")).alias("path"), "text")


def _present(c: Column, kind: T.DataType) -> Column:
    """Whether a value counts as true."""
    if isinstance(kind, T.StringType):
        return c.isNotNull() & (c != "")
    return c.isNotNull() & (c != 0) if isinstance(kind, T.NumericType) else c.isNotNull()


def task_of(df: DataFrame, stem: Column) -> Column:
    """task_type, element_type and source#page=n, as far as they are there, else the file's stem."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = [F.when(_present(F.col(c), kinds[c]), F.col(c).cast("string")) for c in ("task_type", "element_type") if c in kinds]
    sources = [F.when(_present(F.col(c), kinds[c]), F.col(c).cast("string")) for c in ("pdf_path", "source") if c in kinds]
    if sources:
        page = F.concat(F.lit("#page="), F.col("page_number").cast("string")) if "page_number" in kinds else F.lit(None).cast("string")
        source = F.coalesce(*sources)
        parts.append(F.concat(source, F.coalesce(page, F.lit(""))))
    return F.coalesce(F.nullif(F.concat_ws(" ", *parts), F.lit("")), stem) if parts else stem


def load_annotations(spark: SparkSession, folder: str, limit: int | None = None) -> tuple[DataFrame, FieldMap]:
    """Every *.json of the folder but provenance.json, in the order of names, is a record; JSON that isn't an object is left out, invalid JSON is
    an error that names the file.  The first ``*_markdown_path`` that is a text names the sidecar with the gold text; without one
    ground_truth_table.markdown is it.  The id is mapped if all records have one."""
    files = sorted(str(p.resolve()) for p in Path(folder).glob("*.json") if p.name != "provenance.json")
    if not files:
        raise ValueError(f"no JSON annotations in {folder}")
    raw = _whole(spark, files).withColumn("v", F.try_parse_json("text"))
    bad = raw.where("v IS NULL").select("path").orderBy("path").first()
    if bad:
        raise ValueError(f"{bad['path']} is not valid JSON")
    raw = raw.where(F.schema_of_variant("v").startswith("OBJECT"))
    kind = raw.agg(F.schema_of_variant_agg("v")).first()[0]
    if not kind or not kind.startswith("OBJECT"):
        raise ValueError(f"no JSON annotations in {folder}")
    struct = T._parse_datatype_string(kind.replace("OBJECT<", "STRUCT<").replace(": VOID", ": STRING"))
    df = raw.withColumn("r", F.from_json("text", struct)).select("path", "text", *[F.col("r")[f.name].alias(f.name) for f in struct.fields if f.name not in ("path", "text")])
    keys = [f.name for f in struct.fields if f.name.endswith("_markdown_path") and isinstance(f.dataType, T.StringType)]
    rel = F.lit(None).cast("string")
    if keys:
        value = F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k))])
        rel = value[F.get(F.filter(F.json_object_keys("text"), lambda k: F.array_contains(F.array(*[F.lit(x) for x in keys]), k) & value[k].isNotNull()), F.lit(0))]
    df = df.withColumn("__rel", rel)
    named = [(r["path"], posixpath.normpath(posixpath.join(posixpath.dirname(r["path"]), r["__rel"]))) for r in df.where("__rel IS NOT NULL").select("path", "__rel").toLocalIterator()]
    pairs = spark.createDataFrame(named, "path string, __markdown_path__ string")
    there = sorted({m for _, m in named if os.path.exists(m)})
    gold = _whole(spark, there).select(F.col("path").alias("__markdown_path__"), split_frontmatter(F.col("text")).alias("__s")) if there else spark.createDataFrame([], "__markdown_path__ string, __s struct<frontmatter:map<string,string>,body:string,offset:int>")
    df = df.join(pairs, "path", "left").join(gold, "__markdown_path__", "left")
    table = struct["ground_truth_table"].dataType if "ground_truth_table" in struct.names else None
    embedded = F.col("ground_truth_table")["markdown"] if isinstance(table, T.StructType) and "markdown" in table.names and isinstance(table["markdown"].dataType, T.StringType) else F.lit(None).cast("string")
    answer = F.when(F.col("__rel").isNotNull(), F.coalesce(F.col("__s")["body"], F.lit(""))).otherwise(F.coalesce(embedded, F.lit("")))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "")
    df = df.withColumns({"gold_markdown": answer, "__task__": task_of(df, stem), "__frontmatter__": F.col("__s")["frontmatter"], "__md_body_offset__": F.col("__s")["offset"], "__json_path__": F.col("path")})
    df = with_index(df.drop("__rel", "__s", "text"), ["path"]).drop("path")
    if limit is not None:
        df = df.where(F.col("sample_index") < limit)
    has_id = "id" in struct.names and df.where("id IS NULL").first() is None
    return df, FieldMap("__task__", "gold_markdown", "id" if has_id else None)
