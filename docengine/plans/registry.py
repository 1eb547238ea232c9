"""All queries of the core library with their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("integrity", "retrieval", "chunking", "layout", "quality", "markdown", "repair", "documents")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"docengine.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"docengine.plans.{m}").ORACLE.items()}
