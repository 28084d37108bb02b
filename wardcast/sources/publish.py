"""Publish a mart (S4): the Spark counterpart of replacing a materialized view.

A result is written to a new version folder under the mart's path, and only
when that job has succeeded does the pointer file ``CURRENT`` name it: the
pointer is renamed into place, which the file system does as one step.  A
failed job leaves the published version as it was, and readers that hold the
earlier version keep its files until it is removed as an old one.  Marts note
what they were made from, so that dropping one can refuse or cascade.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"
DEPENDS = "DEPENDS"     # names of the marts a mart was made from, one a line


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def _switch(spark: SparkSession, path: str, version: str) -> None:
    jvm, root, fs = _files(spark, path)
    new = jvm.org.apache.hadoop.fs.Path(root, f"_next-{version}")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), spark._jsc.hadoopConfiguration())
    files.rename(new, jvm.org.apache.hadoop.fs.Path(root, POINTER), overwrite)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The version that ``path`` publishes now."""
    version = spark.read.text(f"{path.rstrip('/')}/{POINTER}").first()[0]
    return spark.read.parquet(f"{path.rstrip('/')}/{version}")


def _names(fs, root, kind: str) -> list[str]:
    return sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith(kind))


def _write(spark: SparkSession, path: str, name: str, text: str) -> None:
    jvm, root, fs = _files(spark, path)
    out = fs.create(jvm.org.apache.hadoop.fs.Path(root, name), True)
    out.write(bytearray(text.encode()))
    out.close()


def publish(df: DataFrame, path: str, sort_within: list[str] | None = None,
            partitions: int | None = None, keep: int = 2, grace: float = 6 * 3600,
            depends_on: list[str] | None = None) -> DataFrame:
    """Write ``df`` as the new version of ``path`` and return it as published.

    ``sort_within`` lays rows out by ranges of those columns, so min/max
    statistics skip files and row groups for point lookups by stay or series;
    ``partitions`` sets the number of ranges.  Beside the published version
    ``keep - 1`` earlier ones stay; older ones go once they are ``grace`` seconds
    old.  A version that is newer than the published one may be another
    writer's unfinished work and is never touched.

    ``depends_on`` names the marts (sibling folders) that ``df`` was made from;
    ``drop_published`` goes by it.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    out = df
    if sort_within:
        out = (out.repartitionByRange(partitions, *sort_within) if partitions
               else out.repartitionByRange(*sort_within)).sortWithinPartitions(*sort_within)
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    jvm, root, fs = _files(spark, path)
    _, parent, _ = _files(spark, path.rsplit("/", 1)[0])
    for up in depends_on or []:
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(parent, f"{up}/{POINTER}")):
            raise ValueError(f"{path} depends on {up}, which is not published beside it")
    try:
        out.write.parquet(f"{path}/{version}")
    except Exception:
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, version), True)
        raise
    if depends_on is not None:
        _write(spark, path, DEPENDS, "\n".join(sorted(set(depends_on))))
    _switch(spark, path, version)
    before = [v for v in _names(fs, root, "v") if v < version]
    for old in before[:len(before) - (keep - 1)] if keep > 1 else before:
        if int(old[1:21]) < time.time_ns() - grace * 1e9:
            fs.delete(jvm.org.apache.hadoop.fs.Path(root, old), True)
    return read_published(spark, path)


def dependents(spark: SparkSession, root: str, name: str) -> list[str]:
    """Marts under ``root`` that were published as made from ``name``."""
    jvm, at, fs = _files(spark, root.rstrip("/"))
    out = []
    for mart in _names(fs, at, ""):
        note = jvm.org.apache.hadoop.fs.Path(at, f"{mart}/{DEPENDS}")
        if fs.exists(note) and name in [r.value for r in spark.read.text(note.toString()).collect()]:
            out.append(mart)
    return out


def drop_order(spark: SparkSession, root: str, name: str) -> list[str]:
    """``name`` and all marts that rest on it, directly or not, each after
    those that rest on it."""
    order: list[str] = []

    def visit(mart: str, above: tuple[str, ...]) -> None:
        if mart in above:
            raise ValueError(f"marts depend on each other: {' -> '.join((*above, mart))}")
        if mart not in order:
            for d in dependents(spark, root, mart):
                visit(d, (*above, mart))
            order.append(mart)

    visit(name, ())
    return order


def drop_published(spark: SparkSession, root: str, name: str, cascade: bool = False) -> list[str]:
    """Drop a mart under ``root``.  Others that rest on it are a refusal, or
    with ``cascade`` go first, in order; returns what was dropped.  Each mart's
    pointer goes before its files: no reader finds a mart half gone."""
    jvm, at, fs = _files(spark, root.rstrip("/"))
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(at, f"{name}/{POINTER}")):
        raise KeyError(f"no mart {name} under {root}")
    order = drop_order(spark, root, name)
    if len(order) > 1 and not cascade:
        raise ValueError(f"{', '.join(order[:-1])} depend on {name}; drop them first, or cascade")
    for mart in order:
        fs.delete(jvm.org.apache.hadoop.fs.Path(at, f"{mart}/{POINTER}"), False)
        fs.delete(jvm.org.apache.hadoop.fs.Path(at, mart), True)
    return order


def publish_table(df: DataFrame, name: str, bucket_by: str | None = None,
                  buckets: int = 64) -> DataFrame:
    """Overwrite a catalog table; with ``bucket_by`` the table is bucketed and
    sorted on that key, so joins on it need no shuffle of this side."""
    w = df.write.mode("overwrite").format("parquet")
    if bucket_by:
        w = w.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    w.saveAsTable(name)
    return df.sparkSession.table(name)
