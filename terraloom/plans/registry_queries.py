"""Queries of a registry that holds the test tables: customers, orders and parts as datasets, orders as runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.plans.registry import Registry
from terraloom.plans.session import shared_dir


def _tag(prefix: str, key: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    up = orders.select(_tag("c", "o_custkey").alias("parent"), _tag("o", "o_orderkey").alias("child"), F.lit("order").alias("operation"))
    down = lines.select(_tag("o", "l_orderkey").alias("parent"), _tag("p", "l_partkey").alias("child"), F.lit("line").alias("operation"))
    return up.unionByName(down)


def _datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders, parts = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders", "part"))
    of = lambda df, prefix, key, kind, name, at: df.select(_tag(prefix, key).alias("id"), F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), at.alias("created_at"))
    day = F.lit("2020-01-01").cast("timestamp")
    return of(customers, "c", "c_custkey", "table", "c_name", day).unionByName(of(orders, "o", "o_orderkey", "vector", "o_orderstatus", F.col("o_orderdate").cast("timestamp"))).unionByName(of(parts, "p", "p_partkey", "raster", "p_name", day))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise("pending")
    return orders.select(_tag("o", "o_orderkey").alias("id"), F.col("o_orderpriority").alias("operator"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("submitted_at"))


def _registry(spark: SparkSession) -> Registry:
    return Registry(spark, f"{shared_dir(spark)}/registry-{uuid.uuid4().hex}")


def registry_full_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _registry(spark)
    held.save_frames(lineage=_edges(spark, sf_dir))
    return held.full_lineage("p7")


def registry_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _registry(spark)
    held.save_frames(lineage=_edges(spark, sf_dir), datasets=_datasets(spark, sf_dir))
    return held.parents("p7").select("id", "kind", "name")


def registry_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _registry(spark)
    held.save_frames(lineage=_edges(spark, sf_dir), datasets=_datasets(spark, sf_dir))
    return held.children("c7").select("id", "kind", "name")


def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dataset as last saved: those of customers in debt are saved again under another name."""
    held = _registry(spark)
    held.save_frames(datasets=_datasets(spark, sf_dir))
    poor = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal < 0")
    held.save_frames(datasets=poor.select(_tag("c", "c_custkey").alias("id"), F.lit("table").alias("kind"), F.lit("in debt").alias("name")))
    return held.datasets(limit=None).select("id", "kind", "name")


def registry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _registry(spark)
    held.save_frames(datasets=_datasets(spark, sf_dir), runs=_runs(spark, sf_dir), lineage=_edges(spark, sf_dir))
    return held.counts()


def registry_list_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _registry(spark)
    held.save_frames(runs=_runs(spark, sf_dir))
    return held.runs("failed", 100).select("id", "operator", "status")


_EDGES = "e AS (SELECT DISTINCT 'c' || o_custkey AS parent, 'o' || o_orderkey AS child, 'order' AS operation FROM orders UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 'line' FROM lineitem)"
_DATASETS = "d AS (SELECT 'c' || c_custkey AS id, 'table' AS kind, c_name AS name FROM customer UNION ALL SELECT 'o' || o_orderkey, 'vector', o_orderstatus FROM orders UNION ALL SELECT 'p' || p_partkey, 'raster', p_name FROM part)"
_RUNS = "r AS (SELECT 'o' || o_orderkey AS id, o_orderpriority AS operator, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'pending' END AS status, o_orderdate FROM orders)"

QUERIES = {f.__name__: f for f in (registry_full_lineage, registry_parents, registry_children, registry_latest, registry_stats, registry_list_runs)}
ORACLES = {
    "registry_full_lineage": f"WITH RECURSIVE {_EDGES}, up(parent, child, operation, depth) AS (SELECT parent, child, operation, 1 FROM e WHERE child = 'p7' UNION SELECT e.parent, e.child, e.operation, depth + 1 FROM e JOIN up ON e.child = up.parent) SELECT parent, child, operation, CAST(min(depth) AS INT) AS depth FROM up GROUP BY ALL",
    "registry_parents": f"WITH {_EDGES}, {_DATASETS} SELECT id, kind, name FROM d JOIN e ON e.parent = d.id WHERE e.child = 'p7'",
    "registry_children": f"WITH {_EDGES}, {_DATASETS} SELECT id, kind, name FROM d JOIN e ON e.child = d.id WHERE e.parent = 'c7'",
    "registry_latest": f"WITH {_DATASETS} SELECT id, kind, CASE WHEN c_acctbal < 0 THEN 'in debt' ELSE name END AS name FROM d LEFT JOIN customer ON id = 'c' || c_custkey",
    "registry_stats": f"WITH {_EDGES}, {_DATASETS}, {_RUNS} SELECT 'datasets' AS what, kind AS of, count(*) AS n FROM d GROUP BY kind UNION ALL SELECT 'runs', status, count(*) FROM r GROUP BY status UNION ALL SELECT 'edges', operation, count(*) FROM e GROUP BY operation",
    "registry_list_runs": f"WITH {_RUNS} SELECT id, operator, status FROM r WHERE status = 'failed' ORDER BY o_orderdate DESC, id LIMIT 100",
}
