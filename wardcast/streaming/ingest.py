"""Bulk load of compressed CSV exports into parquet tables (S3).

Runs as a Structured Streaming file source with ``trigger(availableNow=True)``:
every file present is processed once, progress is recorded in the checkpoint
folder, a lost executor or a restarted job resumes without loading a file
twice, and new files dropped later are picked up by the next run.  Gzip
files are not splittable (one task per file), so rows are spread over
``partitions`` tasks by a hash of the layout key before writing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_export(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
                streaming: bool = False, timestamp_format: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """CSV(.gz) export with an explicit schema (no inference); malformed rows
    fail the load instead of silently becoming NULL."""
    rd = (spark.readStream if streaming else spark.read).schema(schema) \
        .option("header", header).option("mode", "FAILFAST")
    if timestamp_format:
        rd = rd.option("timestampNTZFormat", timestamp_format)
    if streaming and max_files_per_trigger:
        rd = rd.option("maxFilesPerTrigger", max_files_per_trigger)
    return rd.csv(path)


def ingest(spark: SparkSession, src: str, schema: T.StructType, dest: str,
           key: str | None = None, partitions: int | None = None,
           checkpoint: str | None = None, max_files_per_trigger: int | None = None,
           timestamp_format: str | None = None):
    """Load every file under ``src`` into the parquet table at ``dest``.

    Returns the finished StreamingQuery (blocks until all available files are
    loaded).  The checkpoint lies beside the data, in ``_ingest_checkpoint``
    under ``dest``, unless a durable folder is named: progress must outlive
    the process, and belongs to one destination.  A destination whose sink
    log was written with another checkpoint is refused: the sink would take
    new batches for old ones and skip them.
    """
    stream = read_export(spark, src, schema, streaming=True, timestamp_format=timestamp_format,
                         max_files_per_trigger=max_files_per_trigger)
    if key and partitions:
        stream = stream.repartition(partitions, key)
    ck = (checkpoint or f"{dest.rstrip('/')}/_ingest_checkpoint").rstrip("/")
    written, known = _exists(spark, f"{dest.rstrip('/')}/_spark_metadata/0"), _exists(spark, f"{ck}/offsets/0")
    if written != known:
        raise ValueError(f"{dest} {'was loaded' if written else 'was not loaded'} with the checkpoint {ck}; "
                         "use the one it was loaded with, or an empty destination")
    q = (stream.writeStream.format("parquet").option("path", dest)
               .option("checkpointLocation", ck).outputMode("append")
               .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
