"""Scanners that look at one record at a time: narrow plans without a shuffle, which also run on streams.

Each has a typed plan (``*_rows``), which tests and SQL compare, and a scanner that packs it into findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqaudit.functions.images import actual_mime, declared_mime, image_bytes
from dqaudit.functions.text import WS, py_lines, py_repr, py_strip
from dqaudit.model import FieldMap, Scanner, findings

# the letters come first, as a lookbehind first would be tried at each place of a text
_OR = r"(?i)or(?<![\p{L}\p{N}_]or)(?![\p{L}\p{N}_])"
# possessive, as Java walks other loops over groups by recursion, and a long run of articles ends the executor by its stack; a run is tried
# from its beginning only, and only where a text's last characters are an article
_HEAD_ARTICLES = "(?i)^(?:(?:a|an|the)(?: |$))++"
_TAIL_ARTICLES = "(?i)(?<!(?:^| )(?:a|an|the))(?:(?:^| )(?:a|an|the)(?= |$))++$"
_LAST_ARTICLE = "(?i)(?:^| )(?:a|an|the)$"
#: Runs of white space; letters are told from it by two ranges instead of all of its.
_SPACE = rf"[\x00-\x20\x7f-\uffff&&{WS}]+"
_CONTROL = r"([\x00-\x09\x0b\x0c\x0e-\x1f\x7f])"
#: Characters that text extraction leaves behind, and their names in findings.
ARTIFACTS = {
    "ﬀ": "LIGATURE FF", "ﬁ": "LIGATURE FI", "ﬂ": "LIGATURE FL", "ﬃ": "LIGATURE FFI", "ﬄ": "LIGATURE FFL", "ﬅ": "LIGATURE LONG S T", "ﬆ": "LIGATURE ST",
    "­": "SOFT HYPHEN", "​": "ZERO WIDTH SPACE", "‌": "ZERO WIDTH NON-JOINER", "‍": "ZERO WIDTH JOINER", "⁠": "WORD JOINER", "﻿": "BYTE ORDER MARK", " ": "NO-BREAK SPACE", "�": "REPLACEMENT CHARACTER",
}
_ARTIFACT = "[" + "".join(ARTIFACTS) + "]"


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def answer_length_rows(df: DataFrame, max_words: int = 4) -> DataFrame:
    """Records whose answer has more than max_words words."""
    return df.where(F.col("a_words") > max_words).withColumn("word_count", F.col("a_words"))


def answer_length(max_words: int = 4) -> Scanner:
    def plan(df: DataFrame, fields: FieldMap) -> DataFrame:
        rows = answer_length_rows(df, max_words)
        why = _say("The answer has ", F.col("word_count"), f" words where at most {max_words} are expected: ", py_repr("a"))
        return findings(rows, "answer_length", "medium", "label_quality", why, {"word_count": F.col("word_count"), "answer": F.col("a")})

    return Scanner("answer_length", plan, f"Answers of more than {max_words} words.")


def _option(part: Column) -> Column:
    """One side of an "or": stripped, without closing punctuation and outer articles, in lower case."""
    x = py_strip(F.regexp_replace(F.rtrim(py_strip(part), F.lit("?.,!")), _SPACE, " "))
    x = F.regexp_replace(x, _HEAD_ARTICLES, "")
    once = F.transform(F.array(x), lambda y: F.lower(F.when(F.substring(y, -4, 4).rlike(_LAST_ARTICLE), F.regexp_replace(y, _TAIL_ARTICLES, "")).otherwise(y)))
    return once[0]


def forced_choice_rows(df: DataFrame) -> DataFrame:
    """Records whose question offers options joined by "or" of which one matches the answer; an empty answer matches any."""
    # exploding an array of one makes the options once: nothing moves through a generator
    options = F.explode(F.array(F.filter(F.transform(F.split("q", _OR, -1), _option), lambda o: o != "")))
    rows = df.where(F.col("q").rlike(_OR)).withColumn("options", options)
    match = F.exists("options", lambda o: (o == F.col("a_norm")) | F.endswith(o, F.col("a_norm")) | F.endswith(F.col("a_norm"), o))
    return rows.where((F.size("options") >= 2) & match)


def _forced_choice(df: DataFrame, fields: FieldMap) -> DataFrame:
    why = _say("The answer ", py_repr("a"), " is one of the options that the question names: ", py_repr("q"))
    return findings(forced_choice_rows(df), "forced_choice_leakage", "medium", "leakage", why, {"question": F.col("q"), "answer": F.col("a")})


def _both(df: DataFrame) -> DataFrame:
    """One row for question and answer each."""
    part = F.array(F.struct(F.lit("question").alias("field"), F.col("q_raw").alias("value"), F.lit(0).alias("within")), F.struct(F.lit("answer").alias("field"), F.col("a_raw").alias("value"), F.lit(1).alias("within")))
    return df.withColumn("__f", F.explode(part)).select("*", "__f.field", "__f.value", "__f.within").drop("__f")


def encoding_rows(df: DataFrame) -> DataFrame:
    """Questions and answers with control characters other than line ends; bad: the different ones in order of appearance."""
    return _both(df).where(F.col("value").rlike(_CONTROL)).withColumn("bad", F.array_distinct(F.regexp_extract_all("value", F.lit(_CONTROL), F.lit(1))))


def _encoding(df: DataFrame, fields: FieldMap) -> DataFrame:
    rows = encoding_rows(df)
    shown = F.transform("bad", lambda c: F.concat(F.lit("'\\x"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0")), F.lit("'")))
    shown = F.transform(shown, lambda x: F.when(x == "'\\x09'", F.lit("'\\t'")).otherwise(x))
    why = _say("The ", F.col("field"), " holds control characters: ", F.array_join(shown, ", "))
    return findings(rows, "encoding_issues", "low", "format", why, {"field": F.col("field"), "bad_chars": shown, "value": F.col("value")}, within=F.col("within"))


def _offset(df: DataFrame) -> Column:
    return F.coalesce(F.expr("try_cast(`__md_body_offset__` AS int)"), F.lit(0)) if "__md_body_offset__" in df.columns else F.lit(0)


def artifact_rows(df: DataFrame) -> DataFrame:
    """Questions and answers with characters that extraction leaves behind: artifacts (name to count), severity and line."""
    offset = _offset(df)
    rows = _both(df).where(F.col("value").rlike(_ARTIFACT))
    # what is counted is what is left of the text, made once (nothing moves through a generator)
    rows = rows.withColumn("__left", F.explode(F.array(F.regexp_replace("value", "[^" + "".join(ARTIFACTS) + "]+", ""))))
    counts = F.map_from_arrays(F.array(*[F.lit(n) for n in ARTIFACTS.values()]), F.array(*[F.length("__left") - F.length(F.replace(F.col("__left"), F.lit(c), F.lit(""))) for c in ARTIFACTS]))
    rows = rows.withColumn("artifacts", F.map_filter(counts, lambda k, v: v > 0)).drop("__left")
    before = F.substring_index(F.translate("value", "".join(ARTIFACTS), next(iter(ARTIFACTS)) * len(ARTIFACTS)), next(iter(ARTIFACTS)), 1)
    at = F.size(py_lines(F.concat(before, F.lit("x")))).cast("int")
    return rows.withColumn("severity", F.when(F.contains("value", F.lit("�")), "medium").otherwise("low")).withColumn("line", at + offset)


def _artifact(df: DataFrame, fields: FieldMap) -> DataFrame:
    rows = artifact_rows(df)
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("artifacts")), lambda e: F.concat(e.key, F.lit(" x "), e.value.cast("string"))), ", ")
    why = _say("The ", F.col("field"), " holds characters that text extraction leaves behind: ", listed)
    return findings(rows, "extraction_artifacts", F.col("severity"), "format", why, {"field": F.col("field"), "artifacts": F.col("artifacts")}, line=F.col("line"), within=F.col("within"))


def image_mime_rows(df: DataFrame, image: str) -> DataFrame:
    """Records whose image declares another type than its first bytes show, where both are known."""
    kind = df.schema[image].dataType
    rows = df.where(F.col(image).isNotNull()).withColumn("__bytes", image_bytes(F.col(image), kind)).where(F.length("__bytes") >= 12)
    rows = rows.withColumn("declared_mime", declared_mime(F.col(image), kind)).withColumn("actual_mime", actual_mime(F.col("__bytes")))
    return rows.where(F.col("declared_mime") != F.col("actual_mime")).drop("__bytes")


def _image_mime(df: DataFrame, fields: FieldMap) -> DataFrame:
    if fields.image is None:
        rows = df.where(F.lit(False)).withColumns({"declared_mime": F.lit(""), "actual_mime": F.lit("")})
    else:
        rows = image_mime_rows(df, fields.image)
    why = _say("The image is declared as ", F.col("declared_mime"), " but its bytes are ", F.col("actual_mime"))
    return findings(rows, "image_mime_type", "high", "format", why, {"declared_mime": F.col("declared_mime"), "actual_mime": F.col("actual_mime")})


forced_choice_leakage = Scanner("forced_choice_leakage", _forced_choice, "Questions that offer their own answer among options joined by 'or'.")
encoding_issues = Scanner("encoding_issues", _encoding, "Control characters in questions or answers.")
extraction_artifacts = Scanner("extraction_artifacts", _artifact, "Ligatures, invisible and replacement characters left by text extraction.")
image_mime_type = Scanner("image_mime_type", _image_mime, "Images whose declared type differs from their bytes.")
