"""Scan the driver's parquet tables.

Reads are lazy; Catalyst prunes columns and pushes filters into the parquet
scan, so callers select only what they use.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


_SCANS: dict = {}


def _listing(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of the table's files (one listing on the driver)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of a driver table.  The relation is shared between calls
    of one application as long as the table's files are the same; a table
    that was rewritten is scanned anew."""
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    path = table_path(sf_dir, name)
    key, files = (spark.sparkContext.applicationId, path), _listing(spark, path)
    if key not in _SCANS or _SCANS[key][0] != files:
        _SCANS[key] = (files, spark.read.parquet(path))
    return _SCANS[key][1]


def require_columns(df: DataFrame, cols, where: str = "input") -> DataFrame:
    """Fail fast when an input contract is not met (schema checked at entry)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{where}: missing columns {missing}; have {df.columns}")
    return df


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Expose driver tables by name (``spark.table(name)``), like a catalog."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)
