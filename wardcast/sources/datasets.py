"""Named datasets in the session catalog.

A dataset is defined once - name, version, where its files are, which columns
it promises - and used by name alone.  Definitions are external tables of the
session catalog, so Spark's own catalog holds them (a shared metastore makes
them shared), SQL can use the names as they are, and nothing is copied.

``<database>.<name>`` is a view of the newest version, ``<database>.<name>_v<n>``
each version's table.  The contract and the version are table properties; the
files are checked against the contract when the dataset is defined and when it
is resolved, so files that were replaced by others of another shape are an
error that names the columns, not a wrong result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from wardcast.session import ensure_checkpoint_dir

PREFIX = "wardcast."


def _name(*names: str) -> None:
    for n in names:
        if not re.fullmatch(r"[a-z][a-z0-9_]*", n):
            raise ValueError(f"{n!r} is no dataset name (lower-case letters, digits, _)")


def database(spark: SparkSession, name: str) -> str:
    """Create the database if need be, in the shared folder."""
    _name(name)
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/wardcast-datasets/{name}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{at}'")
    return name


def check_contract(found: T.StructType, contract: T.StructType, where: str) -> None:
    """Every promised column is there with its type (more may be)."""
    have = {f.name: f.dataType.simpleString() for f in found}
    bad = [f"{f.name} {f.dataType.simpleString()} (found {have.get(f.name, 'nothing')})"
           for f in contract if have.get(f.name) != f.dataType.simpleString()]
    if bad:
        raise ValueError(f"{where} breaks its contract: {', '.join(bad)}")


def versions(spark: SparkSession, db: str, name: str) -> list[int]:
    """Defined versions, ascending."""
    names = (t.name for t in spark.catalog.listTables(db))
    return sorted(int(m[1]) for m in (re.fullmatch(rf"{name}_v(\d+)", t) for t in names) if m)


def define(spark: SparkSession, db: str, name: str, path: str, contract: str, version: int = 1) -> DataFrame:
    """Define a version of a dataset over the Parquet files at ``path`` and
    return it.  Defining a version again must repeat its path and contract."""
    _name(db, name)
    columns = T.StructType.fromDDL(contract)
    check_contract(spark.read.parquet(path).schema, columns, path)
    table = f"{db}.{name}_v{version}"
    if spark.catalog.tableExists(table):
        old = properties(spark, table)
        if (old["path"], old["contract"]) != (path, contract):
            raise ValueError(f"{table} is defined over {old['path']} as {old['contract']}; take a new version")
    else:
        quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
        spark.sql(f"CREATE TABLE {table} USING parquet LOCATION {quote(path)} TBLPROPERTIES ("
                  f"'{PREFIX}version' = '{version}', '{PREFIX}path' = {quote(path)}, '{PREFIX}contract' = {quote(contract)})")
    newest = versions(spark, db, name)[-1]
    shown = T.StructType.fromDDL(properties(spark, f"{db}.{name}_v{newest}")["contract"]).fieldNames()
    spark.sql(f"CREATE OR REPLACE VIEW {db}.{name} AS SELECT {', '.join(f'`{c}`' for c in shown)} FROM {db}.{name}_v{newest}")
    return dataset(spark, db, name, version)


def properties(spark: SparkSession, table: str) -> dict[str, str]:
    return {r.key[len(PREFIX):]: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect() if r.key.startswith(PREFIX)}


def dataset(spark: SparkSession, db: str, name: str, version: int | None = None) -> DataFrame:
    """The dataset by name (its newest version, or the one asked for), with
    the columns of its contract in their order."""
    _name(db, name)
    known = versions(spark, db, name)
    if not known or version not in (None, *known):
        raise KeyError(f"no dataset {db}.{name}" + (f" version {version}" if known else ""))
    table = f"{db}.{name}_v{version or known[-1]}"
    p = properties(spark, table)
    columns = T.StructType.fromDDL(p["contract"])
    check_contract(spark.read.parquet(p["path"]).schema, columns, table)
    return spark.table(table).select(*columns.fieldNames())
