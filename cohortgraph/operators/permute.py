"""Permutation inference as relational plans, for small numbers of permutations; resample has the large ones.

Labels are permuted by hashes, so a permutation is the same whatever the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortgraph.operators import stats

def labels(spark: SparkSession, subjects: DataFrame, n: int, size_a: int) -> DataFrame:
    """(perm, subject, cohort): n random splits with size_a subjects in group a, by the order of an MD5 of both."""
    order = Window.partitionBy("perm").orderBy(F.md5(F.concat_ws("|", "perm", "subject")), "subject")
    perms = spark.range(1, n + 1).select(F.col("id").cast("int").alias("perm"))
    drawn = subjects.select("subject").crossJoin(F.broadcast(perms)).withColumn("k", F.row_number().over(order))
    return drawn.select("perm", "subject", F.when(F.col("k") <= size_a, stats.A).otherwise(stats.B).alias("cohort"))


def max_welch(rows: DataFrame, perms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(perm, stat): largest Welch statistic over the variables, for each permutation."""
    relabelled = rows.drop("cohort").join(perms, "subject")
    return stats.welch(relabelled, ["perm", *keys]).groupBy("perm").agg(F.max("t").alias("stat"))


def critical(null: DataFrame, alpha: float, n: int) -> DataFrame:
    """(t_max): the value at place floor(alpha * n), from 0, of the largest statistics in descending order."""
    return null.orderBy(F.desc("stat")).limit(int(alpha * n) + 1).agg(F.min("stat").alias("t_max"))


def p_of_min_u(rows: DataFrame, perms: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """(keys, obs, p): the smaller U of each variable and the share of permutations whose smaller U is at least that.

    Ranks do not change with labels, so they are taken once."""
    ranked = stats.mid_ranks(rows, keys).select("subject", *keys, "rank", "cohort")

    def least(r: DataFrame, by: Sequence[str]) -> DataFrame:
        in_a = F.col("cohort") == stats.A
        m = r.groupBy(*by).agg(F.sum(F.when(in_a, F.col("rank")).otherwise(0.0)).alias("ra"), F.count_if(in_a).alias("na"), F.count_if(~in_a).alias("nb"))
        u = F.col("ra") - F.col("na") * (F.col("na") + 1) / 2
        return m.select(*by, F.least(u, F.col("na") * F.col("nb") - u).alias("u"))

    obs = least(ranked, keys).withColumnRenamed("u", "obs")
    null = least(ranked.drop("cohort").join(perms, "subject"), ["perm", *keys])
    return null.join(obs, list(keys)).groupBy(*keys, "obs").agg((F.count_if(F.col("u") >= F.col("obs")) / n).alias("p"))


def p_two_sided(null: DataFrame, obs: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """(keys, obs, p): share of permuted statistics beyond the observed one on either side."""
    beyond = (F.col("stat") <= -F.abs("obs")) | (F.col("stat") >= F.abs("obs"))
    return null.join(obs, list(keys)).groupBy(*keys, "obs").agg((F.count_if(beyond) / n).alias("p"))


def first_significant(hits: DataFrame, nodes: DataFrame, order: Sequence[str], default: str = "nan") -> DataFrame:
    """(node, measure): of the measures in which a node is significant the first in order, default where there is none."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("measure"))
    first = hits.groupBy("node").agg(F.min_by("measure", place).alias("measure"))
    return nodes.join(first, "node", "left").select("node", F.coalesce("measure", F.lit(default)).alias("measure"))
