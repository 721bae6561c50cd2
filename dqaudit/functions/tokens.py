"""Words and numbers of gold text and tool output.

The Column expressions say what they are; with_tokens makes the same arrays in one pass over Arrow batches, for plans that use an array several
times, where the optimizer would evaluate the expressions again at each mention.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqaudit.functions.text import WS, nfkc, py_lines, py_strip

_NUMBER = r"\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?"


def strip_markdown(c: Column, strip_math: bool = True) -> Column:
    """Markdown reduced to text: without math spans (optional), table delimiter rows, image links, link targets, heading marks, pipes,
    bold and code marks."""
    if strip_math:
        c = F.regexp_replace(c, r"(?s:\$\$.*?\$\$)|\$[^$\n]*\$", " ")
    kept = F.filter(F.transform(py_lines(c), py_strip), lambda x: ~x.rlike(rf"^\|{WS[:-1]}:|-]+$"))

    def plain(x: Column) -> Column:
        x = F.regexp_replace(x, r"!\[[^\]]*\]\([^)]*\)", " ")
        x = F.regexp_replace(x, r"\[([^\]]*)\]\([^)]*\)", "$1")
        x = F.regexp_replace(x, r"^#{1,6}\s+", "")
        return F.regexp_replace(F.replace(x, F.lit("|"), F.lit(" ")), r"\*\*|`", "")

    return F.array_join(F.transform(kept, plain), "\n")


def word_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(nfkc(c)), F.lit("[a-z]{2,}"), F.lit(0)))


def number_sources(c: Column) -> Column:
    """(norm, spelling) of the numbers, each norm once with its first spelling."""
    found = F.regexp_extract_all(nfkc(c), F.lit(_NUMBER), F.lit(0))
    norm = lambda x: F.regexp_replace(F.replace(x, F.lit(","), F.lit("")), r"\.+$", "")
    pairs = F.filter(F.transform(found, lambda x: F.struct(norm(x).alias("norm"), x.alias("spelling"))), lambda p: p.norm != "")
    none = F.array().cast("array<struct<norm:string,spelling:string>>")
    # a fold, as a lambda must not look into an array that a Python function made
    return F.aggregate(pairs, none, lambda seen, p: F.when(F.exists(seen, lambda s: s.norm == p.norm), seen).otherwise(F.concat(seen, F.array(p))))


def number_tokens(c: Column) -> Column:
    return F.transform(number_sources(c), lambda s: s.norm)


_MATH = re.compile(r"(?s:\$\$.*?\$\$)|\$[^$\n]*\$")
_RULE = re.compile(r"\|[\s:|-]+")
_IMAGE, _LINK, _HEAD, _MARK = re.compile(r"!\[[^\]]*\]\([^)]*\)"), re.compile(r"\[([^\]]*)\]\([^)]*\)"), re.compile(r"^#{1,6}[ \t\n\x0b\f\r]+"), re.compile(r"\*\*|`")
_WORD, _NUM = re.compile("[a-z]{2,}"), re.compile(r"\d[\d,]*(?:\.\d+)?")


def plain_text(x: str, strip_math: bool = True) -> str:
    """strip_markdown of one text."""
    if strip_math and "$" in x:
        x = _MATH.sub(" ", x)
    lines = (line for line in map(str.strip, x.splitlines()) if not (line.startswith("|") and _RULE.fullmatch(line)))

    def plain(line: str) -> str:
        if "](" in line:
            line = _LINK.sub(r"\1", _IMAGE.sub(" ", line))
        if line.startswith("#"):
            line = _HEAD.sub("", line)
        line = line.replace("|", " ")
        return _MARK.sub("", line) if "*" in line or "`" in line else line

    return "\n".join(map(plain, lines))


def _normal(x: str) -> str:
    return x if x.isascii() else unicodedata.normalize("NFKC", x)


def words_of(x: str) -> list[str]:
    return list(dict.fromkeys(_WORD.findall(_normal(x).lower())))


def numbers_of(x: str) -> list[tuple[str, str]]:
    """(norm, spelling), each norm once with its first spelling."""
    out: dict[str, str] = {}
    for spelling in _NUM.findall(_normal(x)):
        norm = spelling.replace(",", "").rstrip(".")
        if norm:
            out.setdefault(norm, spelling)
    return list(out.items())


#: What with_tokens can add: Spark and Arrow type, and the array of a text (not null).
_WORDS = ("array<string>", pa.list_(pa.string()))
MADE: dict[str, tuple[str, pa.DataType, Callable[[str], list]]] = {
    "words": (*_WORDS, words_of),
    "gold_words": (*_WORDS, lambda x: words_of(plain_text(x))),
    "covering_words": (*_WORDS, lambda x: words_of(plain_text(x, False))),
    "numbers": (*_WORDS, lambda x: [n for n, _ in numbers_of(x)]),
    "gold_numbers": ("array<struct<norm:string,spelling:string>>", pa.list_(pa.struct([("norm", pa.string()), ("spelling", pa.string())])), lambda x: [{"norm": n, "spelling": w} for n, w in numbers_of(plain_text(x))]),
}


def with_tokens(df: DataFrame, text: str, made: dict[str, str]) -> DataFrame:
    """df with a column for each entry of made (name: one of MADE) from the text column; null for a null text."""
    at = df.columns.index(text)
    kinds = T.StructType([*df.schema.fields, *(T.StructField(n, T.StructType.fromDDL(f"x {MADE[k][0]}")["x"].dataType) for n, k in made.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [pa.array([None if x is None else MADE[k][2](x) for x in texts], MADE[k][1]) for k in made.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *made])

    return df.mapInArrow(run, kinds)
