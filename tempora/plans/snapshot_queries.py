"""Orders and lines as two versions of a snapshot, whose derived table is attached anew by each load."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.plans.catalog import query
from tempora.session import shared_dir, table
from tempora.sources.snapshots import Snapshots, attached


@query("""WITH n AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus <> 'F'), e AS (SELECT l_orderkey, l_returnflag FROM lineitem)
SELECT 1 AS version, l_returnflag, count(*) AS n_edges, count(*) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey FROM n)) AS n_loose FROM e GROUP BY ALL
UNION ALL SELECT 2, l_returnflag, count(*), count(*) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) FROM e GROUP BY ALL""")
def snapshot_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hang loose when open orders are loaded, and after a second load of all orders, each read from its version."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    store = Snapshots(spark, f"{shared_dir(spark)}/orders-{uuid.uuid4().hex}")
    follows = {"overlay": lambda read: attached(read("edges"), read("nodes"))}
    nodes = orders.select(key("o_orderkey").alias("key"), "o_orderstatus")
    store.load({"nodes": nodes.where("o_orderstatus <> 'F'"), "edges": lines.select(key("l_orderkey").alias("target_key"), "l_returnflag")}, follows)
    store.load({"nodes": nodes}, follows)
    counted = lambda v: store.read("overlay", v).groupBy(F.lit(v).alias("version"), "l_returnflag").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if("loose").alias("n_loose"))
    return counted(1).unionByName(counted(2))
