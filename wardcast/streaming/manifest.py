"""Manifest load with quarantine (S3): many tables, each file once, no row lost.

A manifest names files and their tables (and, if known, how many rows each
holds).  A load takes the files that no earlier load has finished, parses each
table once and writes its rows to ``<dest>/<table>/load=<id>/state=good`` or
``state=bad``: a row that does not parse, or that lacks a required value, goes
to the bad side with its file, its text and the reason, and stops nothing.

The last step appends one row per file to ``<dest>/_ledger``.  That write is
the commit: readers see only loads that are in the ledger, so rows of a load
that failed half way are never seen, and its files are loaded again under a new
id.  A file counts as the same while its path, length and time are.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = ("load string, table string, file string, length bigint, modified bigint, expected bigint, "
          "good bigint, bad bigint")
RAW = "_raw"


@dataclass
class Contract:
    """What a table's rows must look like: columns as DDL, and those that must have a value."""
    columns: str
    required: list[str] = field(default_factory=list)
    timestamp_format: str | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.columns)


def _path(spark: SparkSession, name: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(name)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def ledger(spark: SparkSession, dest: str) -> DataFrame:
    """One row per loaded file of all finished loads."""
    p, fs = _path(spark, f"{dest}/_ledger")
    schema = T.StructType.fromDDL(LEDGER)
    return spark.read.schema(schema).parquet(f"{dest}/_ledger") if fs.exists(p) else spark.createDataFrame([], schema)


def _new_files(spark: SparkSession, manifest, dest: str) -> list[tuple]:
    """(table, qualified file, length, modified, expected) not loaded so far.
    The manifest and the ledger's keys are as long as the list of files."""
    done = {(r.table, r.file, r.length, r.modified) for r in ledger(spark, dest).select(
        "table", "file", "length", "modified").collect()}
    out = []
    for table, file, expected in manifest:
        p, fs = _path(spark, file)
        s = fs.getFileStatus(p)
        row = (table, s.getPath().toString(), s.getLen(), s.getModificationTime())
        if row not in done:
            done.add(row)       # a file that the manifest names twice is loaded once
            out.append((*row, expected))
    return out


def parse(spark: SparkSession, files: list[str], contract: Contract, header: bool = True) -> DataFrame:
    """Rows of CSV files with ``_file``, ``_raw`` and ``_reason`` (NULL for good rows)."""
    rd = (spark.read.schema(T.StructType([*contract.schema.fields, T.StructField(RAW, T.StringType())]))
          .option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW)
          .option("enforceSchema", True))
    if contract.timestamp_format:
        rd = rd.option("timestampNTZFormat", contract.timestamp_format)
    rows = rd.csv(files).select("*", F.col("_metadata.file_path").alias("_file"))
    missing = F.lit(None).cast("string")
    for c in reversed(contract.required):
        missing = F.when(F.col(c).isNull(), F.lit(f"missing {c}")).otherwise(missing)
    reason = F.when(F.col(RAW).isNotNull(), F.lit("does not parse")).otherwise(missing)
    return rows.withColumn("_reason", reason)


def load(spark: SparkSession, manifest, contracts: dict[str, Contract], dest: str, header: bool = True) -> DataFrame:
    """Load what is new in ``manifest`` (rows of table, file, expected rows or
    None) and return this load's ledger rows with ``reconciled``: every row of
    the file is on one side, and as many as expected."""
    dest = dest.rstrip("/")
    files = _new_files(spark, manifest, dest)
    if unknown := sorted({f[0] for f in files} - set(contracts)):
        raise ValueError(f"no contract for table(s) {unknown}")
    load_id = uuid.uuid4().hex
    for table in sorted({f[0] for f in files}):
        rows = parse(spark, [f[1] for f in files if f[0] == table], contracts[table], header)
        state = F.when(F.col("_reason").isNull(), "good").otherwise("bad").alias("state")
        # text and file of good rows are not kept; the file is still counted by
        out = rows.select(*contracts[table].schema.fieldNames(), F.when(F.col("_reason").isNotNull(), F.col(RAW)).alias(RAW),
                          "_reason", "_file", state)
        out.write.partitionBy("state").parquet(f"{dest}/{table}/load={load_id}")
    counts = None
    for table in sorted({f[0] for f in files}):
        n = spark.read.parquet(f"{dest}/{table}/load={load_id}").groupBy("_file").agg(
            F.count(F.when(F.col("state") == "good", 1)).alias("good"), F.count(F.when(F.col("state") == "bad", 1)).alias("bad"))
        n = n.select(F.lit(table).alias("table"), "_file", "good", "bad")
        counts = n if counts is None else counts.unionByName(n)
    listed = spark.createDataFrame([(load_id, *f) for f in files], "load string, table string, file string, length bigint, "
                                   "modified bigint, expected bigint")
    if counts is None:
        done = listed.select("*", F.lit(0).cast("bigint").alias("good"), F.lit(0).cast("bigint").alias("bad"))
    else:
        # both are as long as the list of files; the scan names files by URI
        bare = lambda c: F.url_decode(F.regexp_replace(c, "^[a-z]+:/+", "/"))
        c = counts.select(F.col("table").alias("_t"), bare("_file").alias("_f"), "good", "bad")
        done = listed.join(c, (F.col("table") == F.col("_t")) & (F.regexp_replace("file", "^[a-z]+:/+", "/") == F.col("_f")), "left")
        done = done.select(*listed.columns, *[F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in ("good", "bad")])
    if files:
        done.coalesce(1).write.mode("append").parquet(f"{dest}/_ledger")
    mine = ledger(spark, dest).filter(F.col("load") == load_id)
    return mine.withColumn("reconciled", F.col("expected").isNull() | (F.col("expected") == F.col("good") + F.col("bad")))


def _finished(spark: SparkSession, dest: str, table: str, state: str) -> DataFrame | None:
    """Rows of finished loads: the ledger picks the folders, nothing else is listed."""
    loads = [r.load for r in ledger(spark, dest).filter(F.col("table") == table).select("load").distinct().collect()]
    paths = [p for p in (f"{dest}/{table}/load={x}/state={state}" for x in sorted(loads)) if _path(spark, p)[1].exists(_path(spark, p)[0])]
    return spark.read.parquet(*paths) if paths else None


def loaded(spark: SparkSession, dest: str, table: str, contract: Contract) -> DataFrame:
    """The good rows of a table."""
    rows = _finished(spark, dest.rstrip("/"), table, "good")
    return spark.createDataFrame([], contract.schema) if rows is None else rows.select(*contract.schema.fieldNames())


def quarantined(spark: SparkSession, dest: str, table: str) -> DataFrame:
    """(file, reason, raw): rows that were held back; ``raw`` is their text if they did not parse."""
    rows = _finished(spark, dest.rstrip("/"), table, "bad")
    if rows is None:
        return spark.createDataFrame([], "file string, reason string, raw string")
    return rows.select(F.col("_file").alias("file"), F.col("_reason").alias("reason"), F.col(RAW).alias("raw"))
