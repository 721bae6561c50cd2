"""Audits of question/answer datasets on Spark."""

from __future__ import annotations

import os
import tempfile
import zipfile
from typing import TYPE_CHECKING, Any

if TYPE_CHECKING:
    from pyspark.sql import SparkSession

#: Public names and where they are; they are imported when they are first used.
_EXPORTS = {
    "FieldMap": "dqaudit.model", "Scanner": "dqaudit.model", "ScanRun": "dqaudit.model", "FINDING": "dqaudit.model", "SEVERITIES": "dqaudit.model", "CATEGORIES": "dqaudit.model",
    "run": "dqaudit.plans.run:run", "scan": "dqaudit.plans.run:scan", "resolve_fields": "dqaudit.plans.fields", "builtin": "dqaudit.plans.registry", "scanner": "dqaudit.plans.registry", "python_scanner": "dqaudit.plans.registry",
}
__all__ = [*_EXPORTS, "ship"]


def __getattr__(name: str) -> Any:
    import importlib

    # a submodule imported before wins over an export of its name only where it is asked for by its full path
    if name not in _EXPORTS:
        raise AttributeError(f"module 'dqaudit' has no attribute {name!r}")
    module, _, attribute = _EXPORTS[name].partition(":")
    return getattr(importlib.import_module(module), attribute or name)


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, which may run in another folder or on other machines; once for each session."""
    sc = spark.sparkContext
    if getattr(sc, "_dqaudit_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(), "dqaudit.zip")  # on the driver: Spark's file server hands it out
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(at)
    sc._dqaudit_shipped = True
