"""Operators that a training-data pipeline needs, one module each; nothing else in the library imports them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("secrets", "quality", "warc", "rules", "urlfilter", "neardup", "bpe", "pii", "langid", "decontam", "shards", "infill", "periodic")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"{__name__}.{m}").ORACLE_SQL.items()}
