"""All queries on the document engine's operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parchmint.plans import figures, layout, library, links, printed, proofs, reading, sources, statements, structure, tables, values

FLAGSHIP = "statement_footing"
_ALL = figures.QUERIES | layout.QUERIES | library.QUERIES | reading.QUERIES | statements.QUERIES | printed.QUERIES | structure.QUERIES | proofs.QUERIES | links.QUERIES | tables.QUERIES | sources.QUERIES | values.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
