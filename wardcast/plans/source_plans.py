"""Named queries of the sources: bulk load by manifest, named datasets."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from wardcast.plans.common import dec_rounded
from wardcast.session import shared_folder
from wardcast.sources import datasets as D
from wardcast.sources.tables import read_table, table_path
from wardcast.streaming import manifest as M

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
CONTRACTS = {
    "orders": M.Contract("o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
                         ["o_orderkey", "o_custkey"], STAMP),
    "customer": M.Contract("c_custkey bigint, c_acctbal double, c_mktsegment string", ["c_custkey"]),
}


def _exports(spark, sf, at: str) -> list[tuple]:
    """Compressed CSV exports of two tables and their manifest.  Some orders
    are broken as real exports are: a price that is no number, a customer that
    is missing."""
    o = read_table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 89 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_orderkey") % 97 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        "o_orderdate")
    c = read_table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    listed = []
    for name, df in (("orders", o), ("customer", c)):
        (df.write.option("header", True).option("compression", "gzip").option("timestampNTZFormat", STAMP)
           .csv(f"{at}/{name}"))
        jvm = spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{at}/{name}")
        files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
        listed += [(name, f.getPath().toString(), None) for f in files if f.getPath().getName().startswith("part-")]
    return listed


def manifest_load(spark, sf):
    """S3: exports of two tables loaded through a manifest; the second load of
    the same manifest finds nothing new."""
    at = shared_folder(spark, "exports")
    files, dest = _exports(spark, sf, f"{at}/src"), f"{at}/dest"
    M.load(spark, files, CONTRACTS, dest)
    again = M.load(spark, files, CONTRACTS, dest).groupBy("table").agg(F.count("*").alias("reloaded"))
    kept = {t: M.loaded(spark, dest, t, c) for t, c in CONTRACTS.items()}
    total = kept["orders"].select(F.lit("orders").alias("table"), F.col("o_totalprice").alias("v")).unionByName(
        kept["customer"].select(F.lit("customer").alias("table"), F.col("c_acctbal").alias("v"))).groupBy("table").agg(
        F.sum("v").alias("total"))
    n = M.ledger(spark, dest).groupBy("table").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    why = None
    for t in CONTRACTS:
        q = M.quarantined(spark, dest, t).select(F.lit(t).alias("table"), "reason")
        why = q if why is None else why.unionByName(q)
    why = why.groupBy("table").agg(F.count(F.when(F.col("reason") == "does not parse", 1)).alias("unparsed"),
                                   F.count(F.when(F.col("reason").startswith("missing"), 1)).alias("incomplete"))
    out = n.join(total, "table").join(why, "table", "left").join(again, "table", "left")
    return dec_rounded(out.fillna(0, ["unparsed", "incomplete", "reloaded"]), ["total"], 2)


def _database(spark, sf) -> str:
    """The data set's names: one database per scale folder."""
    db = D.database(spark, "ds_" + hashlib.sha256(sf.rstrip("/").encode()).hexdigest()[:16])
    D.define(spark, db, "orders", table_path(sf, "orders"), "o_custkey bigint, o_totalprice double")
    D.define(spark, db, "customer", table_path(sf, "customer"), "c_custkey bigint, c_mktsegment string")
    return db


def named_datasets(spark, sf):
    """Datasets defined once, then read by their names alone."""
    db = _database(spark, sf)
    out = spark.sql(f"""SELECT c_mktsegment, count(*) AS n_orders, sum(o_totalprice) AS total
                        FROM {db}.orders JOIN {db}.customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
    return dec_rounded(out, ["total"], 2)


QUERIES = {"manifest_load": manifest_load, "named_datasets": named_datasets}
