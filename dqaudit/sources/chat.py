"""Samples with chat messages or plain text as input, and several targets."""

from __future__ import annotations

import importlib
import importlib.util
import json
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqaudit.model import FieldMap

SAMPLE = "sample_index bigint, input string, target string, id string, choices array<string>, metadata map<string,string>, __files__ map<string,binary>"


def message_text(messages: Column, kind: T.ArrayType) -> Column:
    """The last user message's content, text blocks joined by blanks; the first message's content where no user speaks."""
    content = kind.elementType["content"].dataType

    def text(m: Column) -> Column:
        if isinstance(content, T.ArrayType):
            return F.array_join(F.transform(F.filter(m["content"], lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), " ")
        return F.coalesce(m["content"], F.lit(""))

    user = F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1))
    first = F.get(messages, F.lit(0))
    return F.when(user.isNotNull(), text(user)).when(first.isNotNull(), text(first)).otherwise(F.lit(""))


def last_user_message(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The same on rows of turns: the text of the last user turn of each conversation, of its first turn where no user speaks; empty for a null
    text."""
    user = F.max(F.when(F.col(role) == "user", F.struct(F.col(turn).alias("at"), F.coalesce(text, F.lit("")).alias("text"))))
    first = F.min(F.struct(F.col(turn).alias("at"), F.coalesce(text, F.lit("")).alias("text")))
    return turns.groupBy(conversation).agg(F.coalesce(user, first)["text"].alias("question"))


def first_target(target: Column, kind: T.DataType) -> Column:
    return F.coalesce(F.get(target, F.lit(0)) if isinstance(kind, T.ArrayType) else target.cast("string"), F.lit(""))


def flatten(df: DataFrame, input_col: str = "input", target_col: str = "target", metadata_col: str | None = "metadata") -> tuple[DataFrame, FieldMap]:
    """Samples as records: input and target as text; keys of a metadata struct become columns where there are none of the name."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    text = message_text(F.col(input_col), kinds[input_col]) if isinstance(kinds[input_col], T.ArrayType) else F.coalesce(F.col(input_col).cast("string"), F.lit(""))
    out = df.withColumns({"input": text, "target": first_target(F.col(target_col), kinds[target_col])})
    if metadata_col in kinds and isinstance(kinds[metadata_col], T.StructType):
        out = out.withColumns({n: F.col(metadata_col)[n] for n in kinds[metadata_col].fieldNames() if n not in kinds}).drop(metadata_col)
    return out, FieldMap("input", "target", "id" if "id" in kinds else None)


def _get(x: Any, name: str, default: Any = None) -> Any:
    return x.get(name, default) if isinstance(x, dict) else getattr(x, name, default)


def input_to_str(value: Any) -> str:
    """message_text for Python objects."""
    if isinstance(value, str):
        return value
    if not isinstance(value, list) or not value:
        return str(value)
    spoken = [m for m in value if _get(m, "role") == "user"]
    content = _get((spoken or value)[-1 if spoken else 0], "content")
    if isinstance(content, list):
        return " ".join(str(_get(b, "text", "") or "") for b in content if _get(b, "type") == "text")
    return "" if content is None else str(content)


def target_to_str(value: Any) -> str:
    if isinstance(value, list):
        return str(value[0]) if value else ""
    return "" if value is None else str(value)


def _column(values: list[Any]) -> tuple[T.DataType, list[Any]]:
    """Spark type and values of a metadata key."""
    seen = {type(v) for v in values if v is not None}
    for kinds, kind in (({bool}, T.BooleanType()), ({int}, T.LongType()), ({int, float}, T.DoubleType()), ({str}, T.StringType())):
        if seen and seen <= kinds:
            return kind, [None if v is None else float(v) if isinstance(kind, T.DoubleType) else v for v in values]
    return T.StringType(), [v if v is None or isinstance(v, str) else json.dumps(v, default=str) for v in values]


def load_samples(spark: SparkSession, samples: Iterable[Any] | Any, limit: int | None = None) -> tuple[DataFrame, FieldMap]:
    """Sample objects (or a task with ``dataset``, or a function that makes either) as records.

    Metadata values become columns where there is none of the name: with the type that all of a key's values share (booleans, integers, floats,
    text), as JSON where they are lists or dicts or differ.
    """
    if callable(samples):
        samples = samples()
    samples = _get(samples, "dataset", samples)
    if samples is None:
        raise ValueError("the task has no dataset")
    rows, metas = [], []
    for k, s in enumerate(samples):
        if limit is not None and k >= limit:
            break
        sid, choices, meta, files = _get(s, "id"), _get(s, "choices"), _get(s, "metadata"), _get(s, "files")
        rows.append((k, input_to_str(_get(s, "input")), target_to_str(_get(s, "target")), None if sid is None else str(sid), list(choices) if choices else None, None, {a: b if isinstance(b, bytes) else str(b).encode() for a, b in files.items()} if files else None))
        metas.append(dict(meta or {}))
    kinds = T.StructType([f for f in T.StructType.fromDDL(SAMPLE).fields if f.name != "metadata"])
    names = sorted({n for m in metas for n in m} - set(kinds.fieldNames()))
    columns = [_column([m.get(n) for m in metas]) for n in names]
    for n, (kind, _) in zip(names, columns, strict=True):
        kinds.add(n, kind)
    rows = [(*r[:5], r[6], *(values[k] for _, values in columns)) for k, r in enumerate(rows)]
    return spark.createDataFrame(rows, kinds), FieldMap("input", "target", "id")


def load_task(spark: SparkSession, spec: str, limit: int | None = None) -> tuple[DataFrame, FieldMap]:
    """module@function, file.py@function or package/task."""
    if "@" in spec:
        left, name = spec.rsplit("@", 1)
        if Path(left).exists():
            found = importlib.util.spec_from_file_location(Path(left).stem, left)
            module = importlib.util.module_from_spec(found)
            found.loader.exec_module(module)
        else:
            module = importlib.import_module(left)
    elif "/" in spec:
        pkg, name = spec.split("/", 1)
        module = importlib.import_module(f"{pkg}.{name}")
    else:
        raise ValueError(f"{spec!r} is no task: write module@function, file.py@function or package/task")
    task = getattr(module, name, None)
    if task is None or not (callable(task) or hasattr(task, "dataset")):
        tasks = [k for k, v in vars(module).items() if not k.startswith("_") and getattr(v, "is_task", False)]
        if len(tasks) != 1:
            raise ValueError(f"{module.__name__} has several tasks ({', '.join(tasks)}); name one" if tasks else f"{module.__name__} has no task {name!r}")
        task = getattr(module, tasks[0])
    return load_samples(spark, task, limit)
