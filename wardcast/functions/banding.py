"""Threshold banding: an ordered first-match cascade of (condition, score).

Conditions are ordinary Column predicates, so NULL comparisons fall through
exactly as in SQL CASE; the whole cascade compiles to one CASE WHEN inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def band(cases: list[tuple[Column, int]], null_when: Column | None = None,
         default: int = 0) -> Column:
    """CASE WHEN c1 THEN s1 ... [WHEN null_when THEN NULL] ELSE default END."""
    expr = None
    for cond, score in cases:
        expr = F.when(cond, F.lit(score)) if expr is None else expr.when(cond, F.lit(score))
    if null_when is not None:
        expr = expr.when(null_when, F.lit(None).cast("int"))
    return expr.otherwise(F.lit(default)).cast("int")


def total_with_missing_as_zero(cols: list[str]) -> Column:
    """Sum of components where an unmeasured (NULL) component counts as 0."""
    out = F.lit(0)
    for c in cols:
        out = out + F.coalesce(F.col(c), F.lit(0))
    return out.cast("int")


def band_sql(cases: list[tuple[str, int]], null_when: str | None = None,
             default: int = 0) -> str:
    """SQL-text form of ``band`` (one expression, parsed once by Spark)."""
    parts = [f"WHEN {cond} THEN {score}" for cond, score in cases]
    if null_when is not None:
        parts.append(f"WHEN {null_when} THEN NULL")
    return f"CAST(CASE {' '.join(parts)} ELSE {default} END AS INT)"
