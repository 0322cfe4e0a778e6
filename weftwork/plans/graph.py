"""The relational tables as a graph, so that the graph operators run on data that grows.

Regions, nations and suppliers are classes joined by is_a; customers are entities whose class is their nation and who point at
their orders by `placed`; orders are entities whose class is their status and who point at parts by `holds`, one edge a line. Parts
are not defined, so those edges dangle. Customers and suppliers share identifiers p:1, p:2, ... across kinds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _iri(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    def made(table, kind, prefix, key, name, cls, group):
        return _read(spark, sf_dir, table).select(F.lit("tables").alias("source"), F.lit(kind).alias("kind"), _iri(prefix, key).alias("iri"), name.alias("name"), cls.alias("class_iri"), group.alias("group"))

    return (
        made("region", "class", "r:", "r_regionkey", F.col("r_name"), none, F.lit("place"))
        .unionByName(made("nation", "class", "n:", "n_nationkey", F.col("n_name"), none, F.lit("place")))
        .unionByName(made("supplier", "class", "p:", "s_suppkey", F.col("s_name"), none, F.lit("party")))
        .unionByName(made("customer", "entity", "p:", "c_custkey", F.col("c_name"), _iri("n:", "c_nationkey"), F.col("c_mktsegment")))
        .unionByName(made("orders", "entity", "o:", "o_orderkey", none, F.concat(F.lit("st:"), "o_orderstatus"), F.col("o_orderpriority")))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def made(table, kind, src, src_key, label, dst, dst_key):
        return _read(spark, sf_dir, table).select(F.lit("tables").alias("source"), F.lit(kind).alias("src_kind"), _iri(src, src_key).alias("src_iri"), F.lit(label).alias("label"), _iri(dst, dst_key).alias("dst_iri"))

    return (
        made("nation", "class", "n:", "n_nationkey", "is_a", "r:", "n_regionkey")
        .unionByName(made("supplier", "class", "p:", "s_suppkey", "is_a", "n:", "s_nationkey"))
        .unionByName(made("orders", "entity", "p:", "o_custkey", "placed", "o:", "o_orderkey"))
        .unionByName(made("lineitem", "entity", "o:", "l_orderkey", "holds", "part:", "l_partkey"))
    )


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = nodes(spark, sf_dir).filter("class_iri IS NOT NULL").select(F.col("iri").alias("s"), F.lit("type").alias("p"), F.col("class_iri").alias("o"))
    return edges(spark, sf_dir).select(F.col("src_iri").alias("s"), F.col("label").alias("p"), F.col("dst_iri").alias("o")).unionByName(typed)


SQL = """
nodes AS (
  SELECT 'class' AS kind, 'r:' || r_regionkey AS iri, r_name AS name, NULL AS class_iri, 'place' AS grp FROM region
  UNION ALL SELECT 'class', 'n:' || n_nationkey, n_name, NULL, 'place' FROM nation
  UNION ALL SELECT 'class', 'p:' || s_suppkey, s_name, NULL, 'party' FROM supplier
  UNION ALL SELECT 'entity', 'p:' || c_custkey, c_name, 'n:' || c_nationkey, c_mktsegment FROM customer
  UNION ALL SELECT 'entity', 'o:' || o_orderkey, NULL, 'st:' || o_orderstatus, o_orderpriority FROM orders
), edges AS (
  SELECT 'class' AS src_kind, 'n:' || n_nationkey AS src_iri, 'is_a' AS label, 'r:' || n_regionkey AS dst_iri FROM nation
  UNION ALL SELECT 'class', 'p:' || s_suppkey, 'is_a', 'n:' || s_nationkey FROM supplier
  UNION ALL SELECT 'entity', 'p:' || o_custkey, 'placed', 'o:' || o_orderkey FROM orders
  UNION ALL SELECT 'entity', 'o:' || l_orderkey, 'holds', 'part:' || l_partkey FROM lineitem
)"""
