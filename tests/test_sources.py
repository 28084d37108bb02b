"""Sources and sinks: driver scans, CSV.gz ingest (restartable), publish."""

import tempfile

import pytest

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from wardcast.sources.publish import publish
from wardcast.sources.tables import read_table, require_columns
from wardcast.streaming.ingest import ingest


def test_read_table_shared_and_contract(spark):
    a = read_table(spark, SF_SMALL, "events")
    assert a is read_table(spark, SF_SMALL, "events")
    require_columns(a, ["event_id", "ts"])
    try:
        require_columns(a, ["nope"])
        raise AssertionError("expected failure")
    except ValueError:
        pass


def test_ingest_csv_gz_exactly_once(spark):
    work = tempfile.mkdtemp(prefix="wardcast-ingest-")
    ev = read_table(spark, SF_SMALL, "events").select("event_id", "ts", "user_id", "event_type", "value")
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"          # keep microseconds through CSV
    (ev.repartition(3).write.option("header", True).option("compression", "gzip")
       .option("timestampNTZFormat", fmt).csv(f"{work}/src"))
    schema = ev.schema
    dest, ck = f"{work}/dest", f"{work}/ck"
    ingest(spark, f"{work}/src", schema, dest, key="user_id", partitions=4, checkpoint=ck,
           timestamp_format=fmt)
    ingest(spark, f"{work}/src", schema, dest, key="user_id", partitions=4, checkpoint=ck,
           timestamp_format=fmt)                                  # rerun: nothing loaded twice
    got = spark.read.parquet(dest)
    assert got.count() == ev.count()
    assert got.agg(F.sum("value")).first()[0] == pytest.approx(ev.agg(F.sum("value")).first()[0])
    assert got.exceptAll(ev).count() == 0


def test_publish_overwrites(spark):
    work = tempfile.mkdtemp(prefix="wardcast-pub-")
    df = read_table(spark, SF_SMALL, "nation")
    publish(df, f"{work}/t", sort_within=["n_nationkey"], partitions=2)
    out = publish(df.limit(3), f"{work}/t")
    assert out.count() == 3


def test_input_contracts(spark):
    from wardcast.sources.fixtures import clinical_inputs
    from wardcast.sources.schemas import check, check_all
    check_all(clinical_inputs(spark, SF_SMALL))
    bad = spark.createDataFrame([(1, "x")], "icustay_id bigint, MeanBP_Min string")
    with pytest.raises(ValueError, match="MeanBP_Min"):
        check("vitalsfirstday", bad)
    with pytest.raises(ValueError, match="missing intime"):
        check("icustays", spark.createDataFrame([(1,)], "icustay_id bigint"))


def test_bucketed_tables_join_without_shuffle(spark):
    from wardcast.sources.fixtures import chartevents, icustays
    from wardcast.sources.publish import publish_table
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        st = publish_table(icustays(spark, SF_SMALL), "t_stays", bucket_by="icustay_id", buckets=8)
        ce = publish_table(chartevents(spark, SF_SMALL), "t_chart", bucket_by="icustay_id", buckets=8)
        j = ce.join(st, "icustay_id")
        p = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in p and "Exchange hashpartitioning" not in p
        assert j.count() == chartevents(spark, SF_SMALL).join(icustays(spark, SF_SMALL), "icustay_id").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_staging_uses_the_configured_checkpoint_dir(spark):
    from wardcast.session import ensure_checkpoint_dir, stage_table
    shared = ensure_checkpoint_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared == configured                  # the cluster's folder, never replaced
    st = stage_table(read_table(spark, SF_SMALL, "region"), "probe")
    assert st.count() == 5
    root = shared.replace("file:", "").rstrip("/")
    assert all(root in f for f in st.inputFiles())


def test_staged_folders_can_be_dropped(spark):
    import os

    from wardcast import session
    session.drop_staged(spark)
    st = session.stage_table(spark.range(4), "drop-me")
    extra = session.shared_folder(spark, "drop-me-too")
    spark.range(2).write.parquet(extra)
    folders = [os.path.dirname(st.inputFiles()[0]).replace("file://", ""), extra.replace("file:", "")]
    assert all(os.path.isdir(f) for f in folders)
    assert session.drop_staged(spark) == 2 and not any(os.path.exists(f) for f in folders)
    assert session.drop_staged(spark) == 0


def _csv(path, rows):
    import gzip
    with gzip.open(path, "wt") as f:
        f.write("user_id,v\n" + "".join(f"{a},{b}\n" for a, b in rows))


LOAD = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import types as T
from wardcast.session import build_session
from wardcast.streaming.ingest import ingest
s = build_session("local[2]", shuffle_partitions=2)
ingest(s, {src!r}, T.StructType.fromDDL("user_id long, v double"), {dest!r})
print("ROWS", s.read.parquet({dest!r}).count())
"""


def test_ingest_restarts_in_a_second_process():
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    work = tempfile.mkdtemp(prefix="wardcast-ingest2-")
    src, dest = f"{work}/src", f"{work}/dest"
    os.makedirs(src)
    code = LOAD.format(root=root, src=src, dest=dest)

    def load():
        out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
        return out.stdout, out.stderr[-1500:]

    _csv(f"{src}/a.csv.gz", [(1, 0.5), (2, 1.5)])
    out, err = load()
    assert "ROWS 2" in out, err
    _csv(f"{src}/b.csv.gz", [(3, 2.5), (4, 3.5), (5, 4.5)])
    out, err = load()
    assert "ROWS 5" in out, err


def test_ingest_refuses_a_foreign_checkpoint(spark):
    import os

    import pytest
    from pyspark.sql import types as T
    work = tempfile.mkdtemp(prefix="wardcast-ingest3-")
    os.makedirs(f"{work}/src")
    _csv(f"{work}/src/a.csv.gz", [(1, 0.5)])
    schema = T.StructType.fromDDL("user_id long, v double")
    ingest(spark, f"{work}/src", schema, f"{work}/dest", checkpoint=f"{work}/ck1")
    with pytest.raises(ValueError):
        ingest(spark, f"{work}/src", schema, f"{work}/dest", checkpoint=f"{work}/ck2")
    with pytest.raises(ValueError):
        ingest(spark, f"{work}/src", schema, f"{work}/other", checkpoint=f"{work}/ck1")


def test_failed_publish_leaves_the_published_version(spark):
    import pytest
    from pyspark.sql import functions as F

    from wardcast.sources.publish import read_published
    path = f"{tempfile.mkdtemp(prefix='wardcast-pub-')}/mart"
    first = publish(spark.range(10), path, sort_within=["id"])
    with pytest.raises(Exception):
        publish(spark.range(5).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert read_published(spark, path).count() == 10
    publish(spark.range(3), path)
    assert first.count() == 10 and read_published(spark, path).count() == 3


def test_rewritten_table_is_scanned_anew(spark):
    work = tempfile.mkdtemp(prefix="wardcast-scan-")
    spark.range(4).write.parquet(f"{work}/region.parquet")
    assert read_table(spark, work, "region").count() == 4
    spark.range(7).write.mode("overwrite").parquet(f"{work}/region.parquet")
    assert read_table(spark, work, "region").count() == 7
