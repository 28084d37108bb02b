"""Helpers shared by the named plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, cols, digits: int = 6) -> DataFrame:
    """Round double columns for a stable comparison (float sums differ in the
    last bits between engines)."""
    cols = set(cols)
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def round_sig(c, digits: int = 8):
    """Round to ``digits`` significant digits (estimates, standard errors,
    criteria whose scale varies).

    Two stages keep engines in agreement on exact decimal ties: the value is
    scaled by exact powers of ten (split in two factors of at most 10^22, the
    largest exactly representable), quantized through DECIMAL(38,2) (this
    absorbs float noise up to 5e-3 of the last kept digit), rounded half-up
    in decimal arithmetic and scaled back by the same factors.
    """
    k = F.lit(digits - 1) - F.floor(F.log10(F.abs(c)))
    m = F.abs(k)
    m1 = F.least(m, F.lit(22))
    p1, p2 = F.pow(F.lit(10.0), m1), F.pow(F.lit(10.0), m - m1)
    scaled = F.when(k >= 0, c * p1 * p2).otherwise(c / p1 / p2)
    q = F.round(scaled.cast("decimal(38,2)"), 0).cast("double")
    return (F.when(c == 0, F.lit(0.0))
             .when(k >= 0, q / p1 / p2)
             .otherwise(q * p1 * p2))


def sig_rounded(df: DataFrame, cols, digits: int = 8) -> DataFrame:
    cols = set(cols)
    return df.select(*[round_sig(F.col(c), digits).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def sql_sig(expr: str, digits: int = 8) -> str:
    """DuckDB form of ``round_sig``."""
    k = f"({digits - 1} - floor(log10(abs({expr}))))"
    m = f"abs({k})"
    m1 = f"least({m}, 22)"
    p1, p2 = f"pow(10.0, {m1})", f"pow(10.0, {m} - {m1})"
    q_up = f"CAST(round(CAST(({expr}) * {p1} * {p2} AS DECIMAL(38,2)), 0) AS DOUBLE)"
    q_dn = f"CAST(round(CAST(({expr}) / {p1} / {p2} AS DECIMAL(38,2)), 0) AS DOUBLE)"
    return (f"(CASE WHEN ({expr}) = 0 THEN 0.0 WHEN {k} >= 0 THEN {q_up} / {p1} / {p2} "
            f"ELSE {q_dn} * {p1} * {p2} END)")


def dec_rounded(df: DataFrame, cols, digits: int = 2) -> DataFrame:
    """Round to fixed decimals through DECIMAL(38, digits+2) (money-scale
    outputs whose exact values often sit on decimal ties)."""
    cols = set(cols)
    t = f"decimal(38,{digits + 2})"
    return df.select(*[F.round(F.col(c).cast(t), digits).cast("double").alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def sql_dec(expr: str, digits: int = 2) -> str:
    return f"CAST(round(CAST(({expr}) AS DECIMAL(38,{digits + 2})), {digits}) AS DOUBLE)"
