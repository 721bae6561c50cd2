"""All queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("toxicity", "secrets", "ngram_join", "mixing", "tokens", "lm", "sharding", "decontaminate", "suffixes", "hnsw")

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES.update(_module.QUERIES)
    SQL.update(getattr(_module, "SQL", {}))
