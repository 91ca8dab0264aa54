"""The star schema projected onto the graph model: nodes and edges with provenance and confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import tasks_for, work_table

#: Confidence ranks, the order of results.
CONFIDENCE = {"EXTRACTED": 0, "INFERRED": 1, "AMBIGUOUS": 2}
#: Relations with an edge for each place of use; degrees count their distinct pairs.
PER_SITE = ["calls", "uses"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def confidence_rank(c: Column) -> Column:
    out = F.lit(9)
    for name, rank in CONFIDENCE.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def _key(kind: str, column: str) -> Column:
    return F.concat(F.lit(kind + "_"), F.col(column).cast("string"))


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    both = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", "n_name", "n_regionkey", "r_name", F.concat_ws("/", "r_name", "n_name").alias("repo"))


#: The views that an application has written, by application, tables and name.
_stored: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, sf: str, name: str, made: DataFrame, by: str | None = None, largest: str = "lineitem") -> DataFrame:
    """Writes a view once for each application, in folders by ``by`` if named, so that queries read only the kinds or relations they ask for; tasks are as many as the ``largest`` table asks for."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _stored:
        _stored[key] = work_table(made, name, by, tasks_for(spark, read(spark, sf, largest).count()))
    return _stored[key]


def dealt(spark: SparkSession, sf: str, made: DataFrame, name: str) -> DataFrame:
    """Writes what is made of whole views, by as many tasks as the edges ask for."""
    return work_table(made, name, tasks=tasks_for(spark, read(spark, sf, "lineitem").count()))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """node_id, repo_id, kind, name, file, line_start, lang.  Customers in debt have no node, so edges dangle."""
    return once(spark, sf, "nodes", make_nodes(spark, sf), "kind", "orders")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """src, dst, relation, confidence, source_line, repo_id (of the source)."""
    return once(spark, sf, "edges", make_edges(spark, sf), "relation")


def make_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes as a plan over the tables."""
    nation = _nations(spark, sf)
    customer = read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = read(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    orders = read(spark, sf, "orders").join(customer.select("c_custkey", "repo"), F.col("o_custkey") == F.col("c_custkey"))
    row = lambda df, key, repo, kind, name, file, line: df.select(key.alias("node_id"), repo.alias("repo_id"), F.lit(kind).alias("kind"), name.alias("name"), file.alias("file"), line.cast("int").alias("line_start"), F.lit("py").alias("lang"))
    c = F.col
    parts = [
        row(read(spark, sf, "region"), _key("region", "r_regionkey"), c("r_name"), "region", c("r_name"), F.lit("src/region.py"), c("r_regionkey") + 1),
        row(nation, _key("nation", "n_nationkey"), c("repo"), "namespace", c("n_name"), F.lit("src/nation.py"), c("n_nationkey") + 1),
        row(customer.where("c_acctbal >= 0"), _key("customer", "c_custkey"), c("repo"), "class", c("c_name"), F.concat(F.lit("src/customer/"), F.lower("c_mktsegment"), F.lit(".py")), c("c_custkey")),
        row(supplier, _key("supplier", "s_suppkey"), c("repo"), "interface", c("s_name"), F.concat(F.lit("src/supplier/"), (c("s_suppkey") % 7).cast("string"), F.lit(".py")), c("s_suppkey")),
        row(orders, _key("order", "o_orderkey"), c("repo"), "function", _key("order", "o_orderkey"), F.concat(F.lit("app/orders/"), F.substring("o_orderpriority", 1, 1), F.lit(".py")), c("o_orderkey")),
        row(read(spark, sf, "part"), _key("part", "p_partkey"), F.lit("(packages)"), "package", F.concat_ws(" ", "p_name", "p_brand"), F.lit(None).cast("string"), F.lit(None)),
    ]
    return reduce(DataFrame.unionByName, parts)


def make_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edges as a plan over the tables."""
    nation = _nations(spark, sf)
    customer = read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = read(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    # Keys meet first and repositories are joined to the result by nation, so that names do not move with every line of an order.
    placed = read(spark, sf, "orders").select("o_orderkey", "o_custkey").join(read(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    repo = nation.select("n_nationkey", "repo")
    of_nation = lambda df: df.join(repo, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = of_nation(placed)
    line = read(spark, sf, "lineitem")
    # Pairs are made distinct by their integer keys.
    sold = line.select("l_suppkey", "l_partkey").distinct().join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    needed = of_nation(line.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey", "c_nationkey").distinct())
    bought = of_nation(line.join(placed, F.col("l_orderkey") == F.col("o_orderkey")))
    flag = F.when(F.col("l_returnflag") == "N", "EXTRACTED").when(F.col("l_returnflag") == "R", "INFERRED").otherwise("AMBIGUOUS")
    no_line, sure = F.lit(None), F.lit("EXTRACTED")
    row = lambda df, src, dst, relation, conf, at, repo: df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), conf.alias("confidence"), at.cast("int").alias("source_line"), repo.alias("repo_id"))
    c = F.col
    parts = [
        row(nation, _key("region", "n_regionkey"), _key("nation", "n_nationkey"), "contains", sure, no_line, c("r_name")),
        row(customer, _key("nation", "c_nationkey"), _key("customer", "c_custkey"), "contains", sure, no_line, c("repo")),
        row(supplier, _key("nation", "s_nationkey"), _key("supplier", "s_suppkey"), "contains", sure, no_line, c("repo")),
        row(orders, _key("customer", "o_custkey"), _key("order", "o_orderkey"), "contains", sure, no_line, c("repo")),
        row(sold, _key("supplier", "l_suppkey"), _key("part", "l_partkey"), "publishes", sure, no_line, c("repo")),
        row(needed, _key("customer", "o_custkey"), _key("part", "l_partkey"), "depends_on", sure, no_line, c("repo")),
        row(bought, _key("order", "l_orderkey"), _key("part", "l_partkey"), "calls", flag, c("l_linenumber"), c("repo")),
    ]
    return reduce(DataFrame.unionByName, parts)


#: The same projection for DuckDB, as common table expressions.
VIEW_SQL = """WITH nat AS (SELECT n_nationkey, n_name, n_regionkey, r_name, r_name || '/' || n_name AS repo FROM nation JOIN region ON n_regionkey = r_regionkey),
cust AS (SELECT * FROM customer JOIN nat ON c_nationkey = n_nationkey), supp AS (SELECT * FROM supplier JOIN nat ON s_nationkey = n_nationkey),
ord AS (SELECT * FROM orders JOIN cust ON o_custkey = c_custkey),
nodes AS (
 SELECT 'region_' || r_regionkey AS node_id, r_name AS repo_id, 'region' AS kind, r_name AS name, 'src/region.py' AS file, (r_regionkey + 1)::INT AS line_start, 'py' AS lang FROM region
 UNION ALL SELECT 'nation_' || n_nationkey, repo, 'namespace', n_name, 'src/nation.py', (n_nationkey + 1)::INT, 'py' FROM nat
 UNION ALL SELECT 'customer_' || c_custkey, repo, 'class', c_name, 'src/customer/' || lower(c_mktsegment) || '.py', c_custkey::INT, 'py' FROM cust WHERE c_acctbal >= 0
 UNION ALL SELECT 'supplier_' || s_suppkey, repo, 'interface', s_name, 'src/supplier/' || (s_suppkey % 7) || '.py', s_suppkey::INT, 'py' FROM supp
 UNION ALL SELECT 'order_' || o_orderkey, repo, 'function', 'order_' || o_orderkey, 'app/orders/' || substr(o_orderpriority, 1, 1) || '.py', o_orderkey::INT, 'py' FROM ord
 UNION ALL SELECT 'part_' || p_partkey, '(packages)', 'package', p_name || ' ' || p_brand, NULL, NULL, 'py' FROM part),
edges AS (
 SELECT 'region_' || n_regionkey AS src, 'nation_' || n_nationkey AS dst, 'contains' AS relation, 'EXTRACTED' AS confidence, NULL::INT AS source_line, r_name AS repo_id FROM nat
 UNION ALL SELECT 'nation_' || c_nationkey, 'customer_' || c_custkey, 'contains', 'EXTRACTED', NULL, repo FROM cust
 UNION ALL SELECT 'nation_' || s_nationkey, 'supplier_' || s_suppkey, 'contains', 'EXTRACTED', NULL, repo FROM supp
 UNION ALL SELECT 'customer_' || o_custkey, 'order_' || o_orderkey, 'contains', 'EXTRACTED', NULL, repo FROM ord
 UNION ALL SELECT DISTINCT 'supplier_' || l_suppkey, 'part_' || l_partkey, 'publishes', 'EXTRACTED', NULL::INT, repo FROM lineitem JOIN supp ON l_suppkey = s_suppkey
 UNION ALL SELECT DISTINCT 'customer_' || o_custkey, 'part_' || l_partkey, 'depends_on', 'EXTRACTED', NULL::INT, repo FROM lineitem JOIN ord ON l_orderkey = o_orderkey
 UNION ALL SELECT 'order_' || l_orderkey, 'part_' || l_partkey, 'calls', CASE l_returnflag WHEN 'N' THEN 'EXTRACTED' WHEN 'R' THEN 'INFERRED' ELSE 'AMBIGUOUS' END, l_linenumber, repo FROM lineitem JOIN ord ON l_orderkey = o_orderkey)
"""
