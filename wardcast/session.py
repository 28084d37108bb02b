"""SparkSession construction with settings that matter at scale.

On a cluster the session is handed in already configured; these helpers only
fill in what is unset (tests, bench, local runs).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Defaults applied only when the key is not already set on the session.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # hot keys: AQE splits skewed shuffle partitions of the streamed side
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "wardcast",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local/test session: UI off, UTC, AQE on, small shuffle width."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.driver.memory", os.environ.get("WARDCAST_DRIVER_MEM", "8g")))
    active = SparkSession.getActiveSession()
    for k, v in _DEFAULTS.items():
        if active is None or active.conf.get(k, None) is None:
            b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if os.environ.get("WARDCAST_TZ"):
        b = b.config("spark.sql.session.timeZone", os.environ["WARDCAST_TZ"])
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext
        pass
    ensure_checkpoint_dir(spark)
    return spark


_FALLBACK_DIR: str | None = None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster sets this (a static setting) to shared storage, and it is used
    as is.  Only in a local run where neither the setting nor the
    SparkContext names a folder is a scratch folder created, once per process;
    anywhere else that would be a folder the executors do not share, and it is
    an error.  The setting itself is never modified at runtime.
    """
    global _FALLBACK_DIR
    d = spark.conf.get("spark.checkpoint.dir", None) or ""
    sc = None
    try:
        sc = spark.sparkContext
        d = d or (sc.getCheckpointDir() or "")
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext
        pass
    if not d:
        master = sc.master if sc is not None else ""
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        if _FALLBACK_DIR is None:
            _FALLBACK_DIR = tempfile.mkdtemp(prefix="wardcast-ckpt-")
        d = _FALLBACK_DIR
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


_STAGED: list[str] = []


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared checkpoint folder, known to ``drop_staged``."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/wardcast-stage/{label}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def drop_staged(spark: SparkSession) -> int:
    """Delete the folders this process has staged so far and return their
    number.  To be called when no result that reads them is needed any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = 0
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write a small derived table (one row per series: coefficients, fit
    statistics) to the shared checkpoint folder and read it back.

    Computes it exactly once, cuts the lineage so later uses never rescan the
    source data, and survives executor loss (the files live on shared
    storage, not in executor memory).
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.mode("overwrite").parquet(path)
    # the schema is known: skip footer inference on the read-back
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers.

    Functions that run on executors are pickled by reference, so the workers
    need the modules.  The package's sources go out once per application as a
    zip, through Spark's own file distribution.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    target = os.path.join(tempfile.mkdtemp(prefix=f"{name}-ship-"), f"{name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
