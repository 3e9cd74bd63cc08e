"""The property graph and other inputs that the relational tables stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.stages import table

#: Relationship weights of the scoring vocabulary (fixed values); unknown ones weigh 0.3.
REL_WEIGHTS = {
    "CALLS": 1.0, "EXECUTES": 1.0, "SOURCES": 0.95, "INVOKES": 0.9, "CALLED_BY": 0.9, "DEPENDS_ON": 0.8, "DEPENDS_ON_ENV": 0.8,
    "IMPORTS": 0.7, "USES": 0.7, "INHERITS": 0.7, "DEFINES": 0.65, "PROVIDED_BY": 0.6, "EXPORTS": 0.6, "DOC_REFERENCES": 0.6,
    "DOC_DESCRIBES": 0.55, "TRANSITIVELY_DEPENDS": 0.5, "HAS_METHOD": 0.5, "CONTAINS": 0.5, "SETS": 0.5, "DOCUMENTED_BY": 0.4,
    "SAME_DIRECTORY": 0.4, "BUILT_BY": 0.35, "BUILD_ORCHESTRATES": 0.35, "REQUIRES_VERSION": 0.3, "AUTHORED": 0.3,
    "AUTHORED_BY": 0.3, "CONTRIBUTED_TO": 0.3,
}
UNKNOWN_WEIGHT = 0.3
LABELS = {"c": "Customer", "o": "Order", "p": "Part", "s": "Supplier", "n": "Nation", "r": "Region"}


def _key(prefix: str, col: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, rel``: orders, parts, suppliers, customers, nations and regions as a graph."""
    t = lambda name: table(spark, sf_dir, name)
    li = t("lineitem")
    bought = t("orders").join(li, F.expr("o_orderkey = l_orderkey")).groupBy("o_custkey", "l_partkey").count().where("count >= 2")
    parts = [
        t("orders").select(_key("o", "o_orderkey"), _key("c", "o_custkey"), F.lit("DEPENDS_ON")),
        # made distinct as numbers, which are shorter than names
        li.select("l_orderkey", "l_partkey").distinct().select(_key("o", "l_orderkey"), _key("p", "l_partkey"), F.lit("CONTAINS")),
        li.select("l_partkey", "l_suppkey").distinct().select(_key("p", "l_partkey"), _key("s", "l_suppkey"), F.lit("PROVIDED_BY")),
        t("customer").select(_key("c", "c_custkey"), _key("n", "c_nationkey"), F.lit("USES")),
        t("supplier").select(_key("s", "s_suppkey"), _key("n", "s_nationkey"), F.lit("USES")),
        t("nation").select(_key("n", "n_nationkey"), _key("r", "n_regionkey"), F.lit("SAME_DIRECTORY")),
        bought.select(_key("c", "o_custkey"), _key("p", "l_partkey"), F.lit("CALLS")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.toDF("src", "dst", "rel")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node_id, label, name, labels, path``."""
    t = lambda name: table(spark, sf_dir, name)
    parts = [
        t("customer").select(_key("c", "c_custkey"), F.lit("Customer"), F.col("c_name")),
        t("orders").select(_key("o", "o_orderkey"), F.lit("Order"), F.col("o_orderpriority")),
        t("part").select(_key("p", "p_partkey"), F.lit("Part"), F.col("p_name")),
        t("supplier").select(_key("s", "s_suppkey"), F.lit("Supplier"), F.col("s_name")),
        t("nation").select(_key("n", "n_nationkey"), F.lit("Nation"), F.col("n_name")),
        t("region").select(_key("r", "r_regionkey"), F.lit("Region"), F.col("r_name")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.toDF("node_id", "label", "name")


EDGES_SQL = """edges AS (
    SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'DEPENDS_ON' AS rel FROM orders
    UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 'CONTAINS' FROM lineitem
    UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey, 'PROVIDED_BY' FROM lineitem
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'USES' FROM customer
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'USES' FROM supplier
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'SAME_DIRECTORY' FROM nation
    UNION ALL SELECT 'c' || o_custkey, 'p' || l_partkey, 'CALLS' FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        GROUP BY o_custkey, l_partkey HAVING count(*) >= 2)"""
NODES_SQL = """nodes AS (
    SELECT 'c' || c_custkey AS node_id, 'Customer' AS label, c_name AS name FROM customer
    UNION ALL SELECT 'o' || o_orderkey, 'Order', o_orderpriority FROM orders
    UNION ALL SELECT 'p' || p_partkey, 'Part', p_name FROM part
    UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_name FROM supplier
    UNION ALL SELECT 'n' || n_nationkey, 'Nation', n_name FROM nation
    UNION ALL SELECT 'r' || r_regionkey, 'Region', r_name FROM region)"""
WEIGHTS_SQL = "weights AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in REL_WEIGHTS.items()) + ") AS w(rel, weight))"


def rel_weights(spark: SparkSession, weights: dict[str, float] | None = None) -> DataFrame:
    """``rel, weight``: one row for each relationship of the vocabulary."""
    rows = [F.struct(F.lit(k).alias("rel"), F.lit(float(v)).alias("weight")) for k, v in (weights or REL_WEIGHTS).items()]
    return spark.range(1).select(F.inline(F.array(*rows)))
