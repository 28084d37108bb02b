"""Least squares of ill-conditioned designs by a tall-skinny QR (R2).

A Gram matrix squares the condition number of a design: raw powers of a year,
or aggregates that grow together, then lose every digit.  Here each task
reduces its rows of a key to a triangular factor of [1 X y] (QR of the factor
so far and the next rows, so it never holds more than a batch), and the
factors of a key are merged the same way: first in ``FAN`` groups by the task
they come from, then to one.  Only (p + 2)^2 numbers a key and task are
shuffled.

The first row of the last factor holds the means (times sqrt n), the rows
below it are the factor of the centred design: what the normal equations give
as coefficient rows comes out of it by a triangular solve, so ``OLSFit`` works
on either.  A column that the ones before it explain (its diagonal element is
below ``RANK_TOL`` of its length) is aliased and NULL.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardcast.operators.regress import _COEF_FIELDS, OLSFit, check_keys, complete_cases, coefficient_frame
from wardcast.session import ship_package, stage_table

FAN = 64            # groups of task factors that are merged first
HELD_KEYS = 5_000   # factors a task holds before it sends them on
RANK_TOL = 1e-11    # of a column's length: what is left of it after the columns before


def triangle(rows: np.ndarray) -> np.ndarray:
    """Upper triangular factor of a stack of rows, with all its rows."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))]) if len(r) < rows.shape[1] else r


def _merge(held: dict, key, rows: np.ndarray, n: int) -> None:
    old = held.get(key)
    held[key] = (triangle(rows if old is None else np.vstack([old[0], rows])), n + (0 if old is None else old[1]))


def _sent(held: dict, columns) -> pd.DataFrame:
    """Rows (keys, n, r) of the factors held."""
    out = pd.DataFrame([(*key, n, r.ravel().tolist()) for key, (r, n) in held.items()], columns=columns)
    held.clear()
    return out


def _keys_of(pdf: pd.DataFrame, keys: list[str]):
    """(key tuple, row numbers) of a batch; missing key values stay together."""
    if not keys:
        yield (), np.arange(len(pdf))
        return
    for key, at in pdf.groupby(keys, sort=False, dropna=False).indices.items():
        key = key if isinstance(key, tuple) else (key,)
        yield tuple(None if pd.isna(k) else k for k in key), at


def factors(df: DataFrame, keys: list[str], y: str, xcols: list[str]) -> DataFrame:
    """Per key: n and r, the row-major factor of [1 X y]."""
    ship_package(df.sparkSession)
    width = len(xcols) + 2
    d = complete_cases(df, y, xcols).select(
        *keys, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate([*xcols, y])])
    fields = [d.schema[k] for k in keys] + [T.StructField("n", T.LongType()), T.StructField("r", T.ArrayType(T.DoubleType()))]
    schema = T.StructType(fields)

    def rows(batches):
        held: dict = {}
        for pdf in batches:
            m = pdf[[f"_x{i}" for i in range(width - 1)]].to_numpy(float)
            m = np.hstack([np.ones((len(m), 1)), m])
            for key, at in _keys_of(pdf, keys):
                _merge(held, key, m[at], len(at))
            if len(held) > HELD_KEYS:
                yield _sent(held, schema.fieldNames())
        yield _sent(held, schema.fieldNames())

    def merged(key, pdf):
        """All factors of a group, a bounded number at a time."""
        held: dict = {}
        for at in range(0, len(pdf), 256):
            part = pdf.iloc[at:at + 256]
            _merge(held, (), np.vstack([np.asarray(r, float).reshape(width, width) for r in part["r"]]), int(part["n"].sum()))
        r, n = held[()]
        return pd.DataFrame([(*(None if pd.isna(k) else k for k in key[:len(keys)]), n, r.ravel().tolist())], columns=schema.fieldNames())

    part = d.mapInPandas(rows, schema).withColumn("_fan", F.spark_partition_id() % FAN)
    first = part.groupBy(*keys, "_fan").applyInPandas(merged, schema)
    return first.groupBy(*keys).applyInPandas(merged, schema)


def coefficients_of(r: np.ndarray, n: int):
    """Means, slopes (NaN where aliased), inverse of X'X centred, rank, mean
    and sums of squares of y, from one factor."""
    p = len(r) - 2
    means = r[0, 1:] / r[0, 0]
    c = r[1:, 1:]                       # factor of the centred [X y]
    length = np.sqrt((c[:, :p] ** 2).sum(axis=0) + n * means[:p] ** 2)
    kept: list[int] = []
    # a column in the span of those kept before adds no direction of its own
    q = np.zeros((p + 1, 0))
    for j in range(p):
        v = c[:, j] - q @ (q.T @ c[:, j])
        v -= q @ (q.T @ v)
        size = np.linalg.norm(v)
        if length[j] > 0 and size > RANK_TOL * length[j]:
            kept.append(j)
            q = np.hstack([q, (v / size)[:, None]])
    beta, inv = np.full(p, np.nan), np.zeros((p, p))
    t = triangle(c[:, [*kept, p]])
    k = len(kept)
    if k:
        scale = np.abs(np.diag(t[:k, :k]))
        upper = t[:k, :k] / scale       # columns of like size before the solve
        beta[kept] = np.linalg.solve(upper, t[:k, k]) / scale
        back = np.linalg.solve(upper, np.eye(k)) / scale[:, None]
        inv[np.ix_(kept, kept)] = back @ back.T
    return means[:p], beta, inv, k, means[p], float((c[:, p] ** 2).sum()), float((t[k:, k] ** 2).sum())


def solve(found: DataFrame, keys: list[str], p: int) -> DataFrame:
    """Coefficient rows as ``regress.solve`` gives them."""
    schema = T.StructType([found.schema[k] for k in keys] + [T.StructField(c, t) for c, t in _COEF_FIELDS])

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            rows = [coefficients_of(np.asarray(r, float).reshape(p + 2, p + 2), n) for r, n in zip(pdf["r"], pdf["n"])]
            mid, beta, inv, rank, ymean, syy, sse = (np.array(x) for x in zip(*rows))
            yield coefficient_frame(pdf, keys, pdf["n"].to_numpy(float), mid.reshape(-1, p), beta.reshape(-1, p),
                                    inv.reshape(-1, p, p), rank, ymean, syy, sse, True)[schema.fieldNames()]

    return found.mapInPandas(run, schema)


def fit(df: DataFrame, keys: list[str], y: str, xcols: list[str]) -> OLSFit:
    """y ~ xcols + intercept for every key, as ``regress.fit``, without
    forming X'X.  A key of one task's size costs one more shuffle than there."""
    check_keys(keys)
    rows = solve(factors(df, keys, y, xcols), keys, len(xcols))
    return OLSFit(df, keys, y, list(xcols), True, stage_table(rows, "qr-coef"))
