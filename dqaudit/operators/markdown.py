"""Structure of Markdown answers: lines are exploded once, tables are runs of lines, headings look back at the last one.

All windows are partitioned by the record and carry one row for each line that matters (table rows and headings), so nothing
is shuffled but lines of records that hold Markdown at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dqaudit.functions.text import WS, py_lines, py_repr, py_strip
from dqaudit.model import FieldMap, Scanner, findings

_IMAGE = r"!\[[^\]]*\]\(([^)]*)\)"
_DELIMITER = rf"^{WS}*\|?{WS[:-1]}:|-]+\|?{WS}*$"  # one class: Java walks a loop over a group by recursion


def cells(row: Column) -> Column:
    """Stripped cells without the outer pipes."""
    return F.transform(F.split(F.regexp_replace(py_strip(row), r"^\|+|\|+$", ""), r"\|", -1), py_strip)


def markdown_lines(df: DataFrame) -> DataFrame:
    """sample_index, sample_id, offset, line_no (1-based), line of the answers that hold | or # or ![ ."""
    offset = F.coalesce(F.expr("try_cast(`__md_body_offset__` AS int)"), F.lit(0)) if "__md_body_offset__" in df.columns else F.lit(0)
    a = F.col("a_raw")
    own = df.where(a.contains("|") | a.contains("#") | a.contains("![")).select("sample_index", "sample_id", offset.alias("offset"), F.posexplode(py_lines(a)).alias("__p", "line"))
    stripped = py_strip(F.col("line"))
    table = stripped.startswith("|") & (F.length(stripped) - F.length(F.replace(stripped, F.lit("|"), F.lit(""))) >= 2)
    return own.select("sample_index", "sample_id", "offset", (F.col("__p") + 1).alias("line_no"), "line", table.alias("is_table"))


def table_rows(lines: DataFrame) -> DataFrame:
    """Rows of tables: block, place in it, header_line, n_cols of the header, delimited (the second row is a delimiter row)."""
    at = W.partitionBy("sample_index").orderBy("line_no")
    rows = lines.where("is_table").withColumn("block", F.col("line_no") - F.row_number().over(at)).withColumn("cells", cells(F.col("line"))).withColumn("n_cells", F.size("cells"))
    block = W.partitionBy("sample_index", "block").orderBy("line_no")
    whole = block.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("place", F.row_number().over(block))
    second = F.max(F.when(F.col("place") == 2, F.col("line").rlike(_DELIMITER) & F.contains("line", F.lit("-")))).over(whole)
    return rows.withColumns({"header_line": F.first("line_no").over(block), "n_cols": F.first("n_cells").over(block), "delimited": F.coalesce(second, F.lit(False))})


_TYPED = ("sample_index", "sample_id", "offset", "check", "severity", "line_no", "expected", "actual", "detail", "within")


def _typed(df: DataFrame, check: str, severity: str, expected: Column, actual: Column, detail: Column, within: Column | None = None) -> DataFrame:
    return df.select("sample_index", "sample_id", "offset", F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.col("line_no").cast("int").alias("line_no"), expected.cast("int").alias("expected"), actual.cast("int").alias("actual"), detail.cast("string").alias("detail"), (F.lit(0) if within is None else within).cast("int").alias("within"))


def missing_delimiter(rows: DataFrame) -> DataFrame:
    none = F.lit(None)
    return _typed(rows.where("place = 1 AND NOT delimited"), "missing_delimiter", "medium", none, none, none)


def _body(rows: DataFrame) -> DataFrame:
    return rows.where("place > CASE WHEN delimited THEN 2 ELSE 1 END")


def column_mismatch(rows: DataFrame) -> DataFrame:
    return _typed(_body(rows).where("n_cells <> n_cols"), "column_mismatch", "medium", F.col("n_cols"), F.col("n_cells"), py_strip(F.col("line")))


def empty_row(rows: DataFrame) -> DataFrame:
    return _typed(_body(rows).where("n_cells = n_cols").where(F.forall("cells", lambda c: c == "")), "empty_row", "low", F.lit(None), F.lit(None), py_strip(F.col("line")))


def heading_jump(lines: DataFrame) -> DataFrame:
    level = F.length(F.regexp_extract("line", rf"^(#{{1,6}}){WS}", 1))
    heads = lines.where(~F.col("is_table")).withColumn("level", level).where("level > 0")
    heads = heads.withColumn("before", F.lag("level").over(W.partitionBy("sample_index").orderBy("line_no")))
    return _typed(heads.where("level > before + 1"), "heading_jump", "low", F.col("before"), F.col("level"), py_strip(F.col("line")))


def empty_image(lines: DataFrame) -> DataFrame:
    found = F.regexp_extract_all("line", F.lit(_IMAGE), F.lit(0))
    own = lines.where(~F.col("is_table") & F.contains("line", F.lit("![")))
    own = own.select("*", F.posexplode(found).alias("within", "link"))
    return _typed(own.where(py_strip(F.regexp_extract("link", _IMAGE, 1)) == ""), "empty_image", "medium", F.lit(None), F.lit(None), F.col("link"), F.col("within"))


def markdown_rows(df: DataFrame) -> DataFrame:
    """All five checks, typed; see _TYPED."""
    lines = markdown_lines(df)
    rows = table_rows(lines)
    out = missing_delimiter(rows)
    for part in (column_mismatch(rows), empty_row(rows), heading_jump(lines), empty_image(lines)):
        out = out.unionByName(part)
    return out


def _plan(df: DataFrame, fields: FieldMap) -> DataFrame:
    r = markdown_rows(df)
    no, line = F.col("line_no").cast("string"), F.col("offset") + F.col("line_no")
    why = (
        F.when(F.col("check") == "missing_delimiter", F.concat(F.lit("The table that begins in line "), no, F.lit(" lacks a delimiter row below its header, so it won't render as a table.")))
        .when(F.col("check") == "column_mismatch", F.concat(F.lit("Line "), no, F.lit(": a table row of "), F.col("actual").cast("string"), F.lit(" cells under a header of "), F.col("expected").cast("string"), F.lit(": "), F.col("__repr")))
        .when(F.col("check") == "empty_row", F.concat(F.lit("Line "), no, F.lit(": all cells of the table row are empty.")))
        .when(F.col("check") == "heading_jump", F.concat(F.lit("Line "), no, F.lit(": a heading of level "), F.col("actual").cast("string"), F.lit(" follows one of level "), F.col("expected").cast("string"), F.lit(": "), F.col("__repr")))
        .otherwise(F.concat(F.lit("Line "), no, F.lit(": an image without a target: "), F.col("__repr")))
    )
    meta = {"check": F.col("check"), "expected": F.col("expected"), "actual": F.col("actual"), "detail": F.col("detail")}
    return findings(r.withColumn("__repr", py_repr("detail")), "markdown_integrity", F.col("severity"), "format", why, meta, line=line, within=F.col("line_no") * 1000 + F.col("within"))


markdown_integrity = Scanner("markdown_integrity", _plan, "Broken tables, skipped heading levels and empty image targets in Markdown answers.")
