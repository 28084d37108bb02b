"""Quantiles from mergeable sketches (A10, T10): bounded memory per key.

Spark's KLL sketches keep about 3 * k values however many rows or distinct
values there are, merge in any order (partial aggregates, rollups of stored
sketches) and answer a quantile whose rank is off by at most ``rank_error(k)``
of the rows with probability 0.99.  Up to k rows nothing is left out and the
answers are exact; minimum and maximum are exact always.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 1024


def rank_error(k: int = K) -> float:
    """Published bound of the normalised rank error of one quantile (99 %)."""
    return 2.296 / k ** 0.9723


def sketch_agg(value: Column, k: int = K) -> Column:
    """Aggregate: the sketch of all values but NULL and NaN."""
    v = value.cast("double")
    return F.kll_sketch_agg_double(F.when(~F.isnan(v), v), F.lit(k))


def _grid(sketch: Column, k: int) -> Column:
    """The values at ranks (j - 0.5) / k, j = 1..k (Spark takes constant ranks only)."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit((np.arange(k) + 0.5) / k))


def _ordered(grid: Column, n: Column, i: Column, k: int) -> Column:
    """The i-th smallest of n values: for n <= k the nearest rank of the grid
    lies inside the i-th value's share of the ranks, so it is that value."""
    return F.element_at(grid, F.least(F.floor(F.lit(k) * (i - 0.5) / F.greatest(n, F.lit(1))) + 1, F.lit(k)).cast("int"))


def quantiles(df: DataFrame, sketch: str, probs: dict[str, float], k: int = K) -> DataFrame:
    """``df`` with a column per name of ``probs``: the sample quantile between
    the two values around position (n - 1) p of the sketch's values (exact for
    up to k of them), NULL for a sketch without values."""
    n = F.col("_n")
    some = F.when(n > 0, _grid(F.col(sketch), k))
    d = df.withColumn("_n", F.kll_sketch_get_n_double(sketch)).withColumn("_grid", some)
    out = []
    for name, p in probs.items():
        at = (n - 1) * F.lit(float(p))
        lo = _ordered(F.col("_grid"), n, F.floor(at) + 1, k)
        hi = _ordered(F.col("_grid"), n, F.least(F.floor(at) + 2, n), k)
        out.append((lo + (at - F.floor(at)) * (hi - lo)).alias(name))
    return d.select(*df.columns, *out)


def sketches(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """One row per key: ``sketch`` (storable, mergeable)."""
    return df.groupBy(*keys).agg(sketch_agg(F.col(value), k).alias("sketch"))


def merge(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser keys from stored sketches of finer ones, without the rows."""
    return stored.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def five_numbers(stored: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Box-plot data per key: n, lowest, q1, median, q3, highest."""
    ends = {c: F.kll_sketch_get_quantile_double("sketch", F.lit(p)) for c, p in (("lowest", 0.0), ("highest", 1.0))}
    some = F.kll_sketch_get_n_double("sketch")
    mid = quantiles(stored, "sketch", {"q1": 0.25, "median": 0.5, "q3": 0.75}, k)
    return mid.select(*keys, some.alias("n"), F.when(some > 0, ends["lowest"]).alias("lowest"), "q1", "median", "q3",
                      F.when(some > 0, ends["highest"]).alias("highest"))


def true_ranks(df: DataFrame, keys: list[str], value: str, estimates: DataFrame, names: list[str]) -> DataFrame:
    """Per key the exact share of rows below and up to each estimate
    (``{name}_below``, ``{name}_upto``): one pass that checks a sketch."""
    from wardcast.operators.regress import attach
    j = attach(df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)"),
               estimates.select(*keys, *names), keys)
    return j.groupBy(*keys).agg(*[e for c in names for e in (
        F.avg((F.col("_v") < F.col(c)).cast("int")).alias(f"{c}_below"),
        F.avg((F.col("_v") <= F.col(c)).cast("int")).alias(f"{c}_upto"))])
