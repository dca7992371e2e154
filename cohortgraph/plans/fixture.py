"""The cohort of graphs that the registered queries work on, derived from the order tables.

Subjects are groups of four customers, nodes are the 25 brands, and the weight of an edge is the number of times that two
brands meet in an order. FX gives the same tables as SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = 25


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, o, b, q): one row for each order line."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    order = read(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_custkey div 4").alias("subject"))
    part = read(spark, sf_dir, "part").select("p_partkey", F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("b"))
    return line.join(order, line.l_orderkey == order.o_orderkey).join(part, line.l_partkey == part.p_partkey).select("subject", F.col("l_orderkey").alias("o"), "b", F.col("l_quantity").alias("q"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, i, j, w) with i < j. Lines of an order are counted by brand first, so the join meets each brand once."""
    per = items(spark, sf_dir).groupBy("subject", "o", "b").agg(F.count("*").alias("n"))
    a, z = per.select("subject", "o", F.col("b").alias("i"), F.col("n").alias("ni")), per.select("subject", "o", F.col("b").alias("j"), F.col("n").alias("nj"))
    return a.join(z, ["subject", "o"]).where("i < j").groupBy("subject", "i", "j").agg(F.sum(F.col("ni") * F.col("nj")).alias("w"))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy("subject", F.col("b").alias("node")).agg(F.sum("q").alias("v0"), F.count("*").alias("v1"))


def nodes(spark: SparkSession) -> DataFrame:
    return spark.range(1, NODES + 1).select(F.col("id").cast("int").alias("node"))


def communities(spark: SparkSession) -> DataFrame:
    return nodes(spark).select("node", (F.col("node") % 5).alias("ci"))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "customer").select(F.expr("c_custkey div 4").alias("subject")).distinct()
    k = F.col("subject")
    return s.select(
        "subject", F.concat(F.when(k % 3 == 0, "lgp_").otherwise("dep_"), F.lpad(k.cast("string"), 5, "0")).alias("name"), F.when(k % 3 == 0, "patient").otherwise("control").alias("cohort"),
        (18 + (k * 7) % 60).cast("int").alias("age"), (1 + k % 2).cast("int").alias("gender"), (1 + (k * 11) % 30).cast("int").alias("duration"),
    )


FX = """items AS (SELECT o_custkey // 4 AS subject, l_orderkey AS o, CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS b, l_quantity AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
edges AS MATERIALIZED (SELECT a.subject, a.b AS i, z.b AS j, count(*) AS w FROM items a JOIN items z ON a.subject = z.subject AND a.o = z.o AND a.b < z.b GROUP BY ALL),
volumes AS (SELECT subject, b AS node, sum(q) AS v0, count(*) AS v1 FROM items GROUP BY ALL),
nodes AS (SELECT CAST(unnest(range(1, 26)) AS INT) AS node),
subjects AS (SELECT DISTINCT c_custkey // 4 AS subject, CASE WHEN (c_custkey // 4) % 3 = 0 THEN 'lgp_' ELSE 'dep_' END || lpad(CAST(c_custkey // 4 AS VARCHAR), 5, '0') AS name,
  CASE WHEN (c_custkey // 4) % 3 = 0 THEN 'patient' ELSE 'control' END AS cohort, CAST(18 + (c_custkey // 4 * 7) % 60 AS INT) AS age,
  CAST(1 + (c_custkey // 4) % 2 AS INT) AS gender, CAST(1 + (c_custkey // 4 * 11) % 30 AS INT) AS duration FROM customer),
sym AS (SELECT subject, i, j, w FROM edges UNION ALL SELECT subject, j, i, w FROM edges)"""
