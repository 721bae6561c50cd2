"""Built-in scanners, and plugins."""

from __future__ import annotations

import importlib
import importlib.util
import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dqaudit.model import FINDING, FieldMap, Scanner
from dqaudit.operators import artifact_scanners, dataset_scanners, judge, markdown, row_scanners

#: Scanners without parameters, in the order of their findings; the two that need tool outputs are made by builtin().
ORDER = ("answer_length", "duplicate_questions", "inconsistent_format", "answer_distribution", "binary_question_ratio", "forced_choice_leakage", "encoding_issues", "extraction_artifacts", "image_mime_type", "markdown_integrity", "text_layer_recall", "numeric_provenance")
ROW_LOCAL = ("answer_length", "forced_choice_leakage", "encoding_issues", "extraction_artifacts", "image_mime_type")

#: Bytes of records that a Python scanner gets at once: as Python's objects they take several times that, in each of an executor's workers.
SLICE = 4 << 20
_PLAIN = (T.StringType, T.IntegralType, T.FloatType, T.DoubleType, T.BooleanType)


def builtin(tools: DataFrame | None = None, max_answer_words: int = 4) -> dict[str, Scanner]:
    """Without a tool table the scanners of tool outputs find nothing, and are left out."""
    out = {s.name: s for s in (
        row_scanners.answer_length(max_answer_words), dataset_scanners.duplicate_questions, dataset_scanners.inconsistent_format, dataset_scanners.answer_distribution, dataset_scanners.binary_question_ratio,
        row_scanners.forced_choice_leakage, row_scanners.encoding_issues, row_scanners.extraction_artifacts, row_scanners.image_mime_type, markdown.markdown_integrity,
    )}
    if tools is not None:
        out |= {s.name: s for s in (artifact_scanners.text_layer_recall(tools), artifact_scanners.numeric_provenance(tools))}
    return out


def scanner(description: str = "", name: str | None = None) -> Callable[[Callable[[DataFrame, FieldMap], DataFrame]], Scanner]:
    """Decorator: a plan function becomes a scanner of its name."""

    def wrap(fn: Callable[[DataFrame, FieldMap], DataFrame]) -> Scanner:
        return Scanner(name or fn.__name__, fn, description or (fn.__doc__ or "").strip())

    return wrap


def python_scanner(name: str, fn: Callable[[list[dict], FieldMap], Iterable[dict]], description: str = "", whole: bool = False) -> Scanner:
    """A scanner written for lists of records.  fn gets records (dicts with sample_index and sample_id) and returns findings as dicts of the
    envelope's columns.  By default it sees a batch at a time, of about SLICE bytes where the columns are of plain types; with whole=True all records in one task, which only small datasets fit."""
    kind = T.StructType([*T.StructType.fromDDL(FINDING).fields, T.StructField("__phase", T.IntegerType()), T.StructField("__first", T.LongType()), T.StructField("__within", T.IntegerType())])
    names = kind.fieldNames()

    def rows(pdf: pd.DataFrame, fields: FieldMap) -> pd.DataFrame:
        got = list(fn(pdf.to_dict("records"), fields))
        base = {"scanner": name, "severity": "low", "category": "format", "explanation": "", "sample_index": -1, "sample_id": None, "line": None, "metadata": "{}", "__phase": 0, "__within": 0}
        return pd.DataFrame([{**base, "__first": g.get("sample_index", -1), **g} for g in got], columns=names)

    def plan(df: DataFrame, fields: FieldMap) -> DataFrame:
        if whole:
            return df.groupBy().applyInPandas(lambda pdf: rows(pdf, fields), kind)

        if not all(isinstance(f.dataType, _PLAIN) for f in df.schema.fields):  # Spark's own conversion knows the other types

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    yield rows(b, fields)

            return df.mapInPandas(run, kind)
        types = [f.type for f in to_arrow_schema(kind)]

        def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                each = max(1, b.num_rows * SLICE // max(1, b.nbytes))
                for at in range(0, b.num_rows, each):
                    got = rows(b.slice(at, each).to_pandas(), fields)
                    if len(got):
                        yield pa.RecordBatch.from_arrays([pa.Array.from_pandas(got[c], mask=got[c].isnull(), type=k) for c, k in zip(names, types, strict=True)], names=names)

        return df.mapInArrow(sliced, kind)

    return Scanner(name, plan, description)


def load_plugins(module: str) -> dict[str, Scanner]:
    """Scanners of a module (dotted name or file): its SCANNERS list, else its public attributes that are scanners."""
    if os.path.exists(module):
        spec = importlib.util.spec_from_file_location(Path(module).stem, module)
        loaded = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(loaded)
    else:
        loaded = importlib.import_module(module)
    listed = getattr(loaded, "SCANNERS", None)
    found = list(listed) if listed is not None else [v for k, v in vars(loaded).items() if not k.startswith("_") and isinstance(v, Scanner)]
    if not found:
        raise ValueError(f"{module} has no scanners: give it a SCANNERS list, or public scanners")
    return {s.name: s for s in found}


def select(names: list[str] | None, available: dict[str, Scanner], plugins: dict[str, Scanner] | None = None, models: Iterable[str] = ()) -> list[Scanner]:
    """The named scanners, all by default; a built-in one wins over a plugin of its name.  Unknown names and, without a model, model-judged
    ones are errors."""
    every = {**(plugins or {}), **available}
    if names is None:
        return list(every.values())
    for n in names:
        if n not in every:
            if n in judge.MODEL_SCANNERS and n not in models:
                raise ValueError(f"scanner {n!r} needs a model")
            raise ValueError(f"unknown scanner {n!r}; known: {sorted({*every, *judge.MODEL_SCANNERS})}")
    return [every[n] for n in dict.fromkeys(names)]


def catalog(spark: SparkSession) -> DataFrame:
    """name, description, needs_model of the built-in scanners."""
    about = {"text_layer_recall": "Gold words that no extraction tool saw, and words of all tools that the gold lacks.", "numeric_provenance": "Gold numbers that no extraction tool saw."}
    own = builtin()
    rows = [(n, own[n].description if n in own else about[n], False) for n in ORDER] + [(n, make(lambda s, p: "").description, True) for n, make in judge.MODEL_SCANNERS.items()]
    return spark.createDataFrame(rows, "name string, description string, needs_model boolean")
