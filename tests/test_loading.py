"""Manifest loads, named datasets and dependent marts."""

import gzip
import os
import tempfile

import pytest

from wardcast.sources import datasets as D
from wardcast.sources.publish import dependents, drop_order, drop_published, publish, read_published
from wardcast.streaming import manifest as M

A = M.Contract("id long, v double, note string", ["id"])
B = M.Contract("k string", [])


def put(path, text):
    with gzip.open(path, "wt") as f:
        f.write(text)
    return path


def counts(df):
    return {os.path.basename(r.file): (r.good, r.bad, r.reconciled) for r in df.collect()}


def test_manifest_load_keeps_bad_rows_apart(spark):
    work = tempfile.mkdtemp(prefix="wardcast-man-")
    a1 = put(f"{work}/a 1.csv.gz", "id,v,note\n1,0.5,x\n2,oops,y\n,1.5,z\n3,2.5,\"a, b\"\n4,1,2,3\n")
    a2 = put(f"{work}/a2.csv.gz", "id,v,note\n")
    b1 = put(f"{work}/b.csv.gz", "k\np\nq\n")
    files = [("a", a1, 5), ("a", a2, 0), ("b", b1, 3), ("b", b1, 3)]
    dest = f"{work}/dest"
    first = M.load(spark, files, {"a": A, "b": B}, dest)
    assert counts(first) == {"a 1.csv.gz": (2, 3, True), "a2.csv.gz": (0, 0, True), "b.csv.gz": (2, 0, False)}
    assert sorted(map(tuple, M.loaded(spark, dest, "a", A).collect())) == [(1, 0.5, "x"), (3, 2.5, "a, b")]
    bad = sorted((r.reason, r.raw) for r in M.quarantined(spark, dest, "a").collect())
    assert bad == [("does not parse", "2,oops,y"), ("does not parse", "4,1,2,3"), ("missing id", None)]
    # the same manifest again, then with a new and a changed file
    assert M.load(spark, files, {"a": A, "b": B}, dest).count() == 0
    put(f"{work}/b.csv.gz", "k\np\nq\nr\ns\n")
    b2 = put(f"{work}/b2.csv.gz", "k\nt\n")
    third = M.load(spark, [*files, ("b", b2, None)], {"a": A, "b": B}, dest)
    assert counts(third) == {"b.csv.gz": (4, 0, False), "b2.csv.gz": (1, 0, True)}
    assert M.ledger(spark, dest).count() == 5


def test_failed_manifest_load_is_not_seen(spark, monkeypatch):
    work = tempfile.mkdtemp(prefix="wardcast-man-")
    files = [("a", put(f"{work}/a.csv.gz", "id,v,note\n1,0.5,x\n"), 1), ("b", put(f"{work}/b.csv.gz", "k\np\n"), 1)]
    dest, parse = f"{work}/dest", M.parse

    def broken(spark, names, contract, header=True):
        if contract is B:
            raise RuntimeError("lost")
        return parse(spark, names, contract, header)

    monkeypatch.setattr(M, "parse", broken)
    with pytest.raises(RuntimeError):
        M.load(spark, files, {"a": A, "b": B}, dest)
    assert os.listdir(f"{dest}/a") and M.loaded(spark, dest, "a", A).count() == 0
    monkeypatch.setattr(M, "parse", parse)
    assert M.load(spark, files, {"a": A, "b": B}, dest).count() == 2
    assert M.loaded(spark, dest, "a", A).count() == 1 and M.quarantined(spark, dest, "a").count() == 0
    with pytest.raises(ValueError, match="no contract"):
        M.load(spark, [("c", put(f"{work}/c.csv.gz", "k\n"), None)], {"a": A}, dest)


def test_named_datasets(spark):
    work = tempfile.mkdtemp(prefix="wardcast-ds-")
    spark.range(5).selectExpr("id", "id * 2 AS v", "'x' AS extra").write.parquet(f"{work}/one")
    spark.range(7).selectExpr("id", "CAST(id AS STRING) AS v").write.parquet(f"{work}/two")
    db = D.database(spark, "ds_test")
    try:
        D.define(spark, db, "points", f"{work}/one", "v bigint, id bigint", 1)
        assert D.dataset(spark, db, "points").columns == ["v", "id"]
        assert spark.sql(f"SELECT sum(v) FROM {db}.points").first()[0] == 20
        D.define(spark, db, "points", f"{work}/two", "id bigint, v string", 2)
        assert D.versions(spark, db, "points") == [1, 2]
        assert spark.table(f"{db}.points").count() == 7 and D.dataset(spark, db, "points", 1).count() == 5
        D.define(spark, db, "points", f"{work}/one", "v bigint, id bigint", 1)          # again, the same
        assert spark.table(f"{db}.points").count() == 7
        with pytest.raises(ValueError, match="take a new version"):
            D.define(spark, db, "points", f"{work}/two", "id bigint", 1)
        with pytest.raises(ValueError, match="v string .found bigint., w int .found nothing."):
            D.define(spark, db, "broken", f"{work}/one", "v string, w int")
        with pytest.raises(KeyError):
            D.dataset(spark, db, "points", 9)
        with pytest.raises(KeyError):
            D.dataset(spark, db, "nothing")
        with pytest.raises(ValueError, match="no dataset name"):
            D.define(spark, db, "x; DROP", f"{work}/one", "id bigint")
        # files of another shape under a defined name are told, not read
        spark.range(3).selectExpr("id AS other").write.mode("overwrite").parquet(f"{work}/two")
        with pytest.raises(ValueError, match="breaks its contract"):
            D.dataset(spark, db, "points")
    finally:
        spark.sql(f"DROP DATABASE {db} CASCADE")


def test_dropping_a_mart_refuses_or_cascades(spark):
    root = tempfile.mkdtemp(prefix="wardcast-marts-")
    publish(spark.range(9), f"{root}/base", depends_on=[])
    publish(spark.range(5), f"{root}/mid", depends_on=["base"])
    publish(spark.range(3), f"{root}/top", depends_on=["mid", "base"])
    publish(spark.range(2), f"{root}/other")
    assert dependents(spark, root, "base") == ["mid", "top"]
    assert drop_order(spark, root, "base") == ["top", "mid", "base"]
    with pytest.raises(ValueError, match="top, mid depend on base"):
        drop_published(spark, root, "base")
    assert read_published(spark, f"{root}/base").count() == 9
    assert drop_published(spark, root, "mid", cascade=True) == ["top", "mid"]
    assert drop_published(spark, root, "base") == ["base"] and sorted(os.listdir(root)) == ["other"]
    with pytest.raises(KeyError):
        drop_published(spark, root, "base")
    with pytest.raises(ValueError, match="not published"):
        publish(spark.range(1), f"{root}/late", depends_on=["base"])


def test_old_versions_go_after_a_grace_time(spark):
    path = f"{tempfile.mkdtemp(prefix='wardcast-pub-')}/mart"

    def folders():
        return sorted(x for x in os.listdir(path) if x.startswith("v"))

    for n in range(4):
        publish(spark.range(n), path)
    assert len(folders()) == 4                                    # all younger than the grace time
    os.mkdir(f"{path}/v99999999999999999999-unfinished")          # another writer's, newer than CURRENT
    publish(spark.range(9), path, grace=0)
    assert len(folders()) == 3 and folders()[-1].endswith("unfinished") and read_published(spark, path).count() == 9
