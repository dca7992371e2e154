"""Edge-level filters and projections over edges(subject, i, j, w), i < j. An absent row is a weight of zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, without a shuffle."""
    pair = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    other = [c for c in edges.columns if c not in ("i", "j")]
    return edges.select(*other, F.explode(pair).alias("p")).select(*other, "p.i", "p.j").select(*edges.columns)


def upper(edges: DataFrame) -> DataFrame:
    return edges.where("i < j")


def density(edges: DataFrame, volumes: DataFrame, variant: str = "sum") -> DataFrame:
    """Weights over the volumes of both ends: w / (v_i + v_j) on v0, or with variant 'mean' 2 w / (v_i + v_j) on v1.

    Edges whose ends have no volume, or volumes that sum to 0, have no density and go."""
    if variant not in ("sum", "mean"):
        raise ValueError(f"variant must be sum or mean, not {variant}")
    v, factor = ("v0", 1.0) if variant == "sum" else ("v1", 2.0)
    a = volumes.select("subject", F.col("node").alias("i"), F.col(v).alias("vi"))
    b = volumes.select("subject", F.col("node").alias("j"), F.col(v).alias("vj"))
    d = F.try_divide(F.lit(factor) * F.col("w"), (F.col("vi") + F.col("vj")).cast("double"))
    return edges.join(a, ["subject", "i"]).join(b, ["subject", "j"]).select("subject", "i", "j", d.alias("w")).where("w is not null")


def presence(edges: DataFrame, n_subjects: int) -> DataFrame:
    """(i, j, present, zero): subjects that have each edge, and that lack it."""
    return edges.groupBy("i", "j").agg(F.count("*").alias("present")).withColumn("zero", F.lit(n_subjects) - F.col("present"))


def consensus(edges: DataFrame, n_subjects: int, ratio: float = 0.7) -> DataFrame:
    """Edges that fewer than ratio of the subjects lack."""
    kept = presence(edges, n_subjects).where(F.col("zero") < ratio * n_subjects).select("i", "j")
    return edges.join(kept, ["i", "j"], "left_semi").select(*edges.columns)


def consensus_removed(edges: DataFrame, n_subjects: int, ratio: float = 0.7) -> DataFrame:
    """The edges of each subject that consensus() removes."""
    gone = presence(edges, n_subjects).where(F.col("zero") >= ratio * n_subjects).select("i", "j")
    return edges.join(gone, ["i", "j"], "left_semi").select(*edges.columns)


def dropped_edges(edges: DataFrame, n_subjects: int, ratio: float = 0.75) -> DataFrame:
    """(i, j): the edges that present_in() leaves out."""
    return presence(edges, n_subjects).where(F.col("zero") / n_subjects > 1 - ratio).select("i", "j")


def present_in(edges: DataFrame, n_subjects: int, ratio: float = 0.75) -> DataFrame:
    """Edges whose share of lacking subjects is at most 1 - ratio."""
    kept = presence(edges, n_subjects).where(F.col("zero") / n_subjects <= 1 - ratio).select("i", "j")
    return edges.join(kept, ["i", "j"], "left_semi").select(*edges.columns)


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct edges of the cohort with weight 1."""
    return edges.select("i", "j").distinct().withColumn("w", F.lit(1))


def heaviest(edges: DataFrame, ratio: float) -> DataFrame:
    """The heaviest edges of each subject until twice their sum passes ratio of the whole matrix; ties by larger (i, j)."""
    order = Window.partitionBy("subject").orderBy(F.desc("w"), F.desc("i"), F.desc("j")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("subject")
    return edges.withColumn("run", F.sum(2 * F.col("w")).over(order)).withColumn("all_w", F.sum(2 * F.col("w")).over(whole)).where(F.col("run") <= ratio * F.col("all_w")).select(*edges.columns)


def above(edges: DataFrame, limit: float) -> DataFrame:
    return edges.where(F.col("w") > limit)


def at_least(edges: DataFrame, limit: float) -> DataFrame:
    """Graph of the edges of weight limit or more; absent edges stay absent at 0."""
    return edges.where(F.col("w") >= limit)


def isolated_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(subject, node) without an edge."""
    used = symmetric(edges).select("subject", F.col("i").alias("node")).distinct()
    return edges.select("subject").distinct().crossJoin(F.broadcast(nodes)).join(used, ["subject", "node"], "left_anti")


def binary(edges: DataFrame) -> DataFrame:
    return edges.withColumn("w", F.lit(1.0))


def inverse(edges: DataFrame) -> DataFrame:
    """Strengths as lengths, and back."""
    return edges.withColumn("w", F.try_divide(F.lit(1.0), "w"))


def cube_root(edges: DataFrame) -> DataFrame:
    return edges.withColumn("w", F.cbrt("w"))


def log_weights(edges: DataFrame) -> DataFrame:
    return edges.withColumn("w", F.log1p("w"))


def densify(edges: DataFrame, subjects: DataFrame) -> DataFrame:
    """All edges of the cohort for all subjects, 0 where absent: what regressions and tests see."""
    grid = edges.select("i", "j").distinct().crossJoin(subjects.select("subject"))
    return grid.join(edges, ["subject", "i", "j"], "left").select("subject", "i", "j", F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"))


def unordered_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct unordered pairs of (i, j) rows in any order."""
    return pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).where("i <> j").distinct()


def gather(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The edges named by pairs, in any order and however often."""
    return edges.join(unordered_pairs(pairs), ["i", "j"], "left_semi").select(*edges.columns)


def masked(values: DataFrame, mask: DataFrame) -> DataFrame:
    """Rows of values whose (i, j) is in mask."""
    return values.join(mask, ["i", "j"], "left_semi").select(*values.columns)


def bounded_p(p: Column, alpha: float) -> Column:
    """1 - p where p is at most alpha, else 0; NaN and null give 0."""
    return F.coalesce(F.when(F.isnan(p), 0.0).when(p <= alpha, 1 - p), F.lit(0.0))


def marked_nodes(tests: DataFrame, alpha: float) -> DataFrame:
    """(node, marked): whether each node of tests(node, p) has p under alpha; null and NaN do not."""
    return tests.select("node", F.coalesce((F.col("p") < alpha) & ~F.isnan("p"), F.lit(False)).alias("marked"))


def marked_atlas(atlas: DataFrame, marked: DataFrame) -> DataFrame:
    """atlas(node, x, y, z) with the coordinates of nodes that are not marked set to 0."""
    on = F.coalesce("marked", F.lit(False))
    return atlas.join(marked, "node", "left").select("node", *(F.when(on, F.col(c)).otherwise(0.0).alias(c) for c in ("x", "y", "z")))
