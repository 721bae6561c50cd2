"""Text semantics of Python's str methods as Column expressions; only nfkc and py_repr leave the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What str.isspace is true for.
WS = r"[\t-\r\x1c-\x1f \x85\xa0  -     　]"
#: The same characters, for trims: these look at a text's ends only, where a pattern is tried at each place and runs again in each long run.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_LINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def py_strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def py_rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def py_words(c: Column) -> Column:
    """str.split() without arguments."""
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(py_words(c))


def py_lines(c: Column) -> Column:
    """str.splitlines(): no empty item after a last line end, no items for an empty text."""
    parts = F.split(c, _LINE, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def truthy_str(c: Column, kind: T.DataType) -> Column:
    """str(value or ""): null, zero, false and empty values become the empty string."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, F.lit("True")).otherwise(F.lit(""))
    if isinstance(kind, T.NumericType):
        return F.when(c.isNull() | (c == 0), F.lit("")).otherwise(c.cast("string"))
    if isinstance(kind, T.ArrayType | T.MapType):
        return F.when(c.isNull() | (F.size(c) == 0), F.lit("")).otherwise(F.to_json(c))
    if isinstance(kind, T.StructType):
        return F.coalesce(F.to_json(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def plain_str(c: Column, kind: T.DataType) -> Column:
    """str(value): null is None, booleans are True and False."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False")).otherwise(F.lit("None"))
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.coalesce(F.to_json(c), F.lit("None"))
    return F.coalesce(c.cast("string"), F.lit("None"))


def upper_first(c: Column) -> Column:
    return c.rlike(r"^\p{IsUppercase}")


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, ties to even."""
    return F.concat(F.bround(part / whole * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def find_line(lines: Column, needle: Column) -> Column:
    """1-based number of the first line that holds needle in any case; null where none does."""
    low = F.lower(needle)
    at = F.array_position(F.transform(lines, lambda x: F.contains(F.lower(x), low)), True)
    return F.when(at > 0, at.cast("int"))


@F.pandas_udf(T.StringType())
def _nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """Compatibility composition; ASCII passes by the Python worker's work as a null."""
    wide = c.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_nfkc(F.when(wide, c)), c)


@F.pandas_udf(T.StringType())
def py_repr(s: pd.Series) -> pd.Series:
    """repr of strings, for explanations of rows that are already flagged."""
    return s.map(lambda x: None if x is None else repr(x))
