"""Node and graph measures as relational plans over edges(subject, i, j, w), i < j; n is the number of nodes of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgraph.operators.edges import symmetric


def every_node(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.select("subject").distinct().crossJoin(F.broadcast(nodes))


def _on_all(values: DataFrame, edges: DataFrame, nodes: DataFrame, name: str, zero) -> DataFrame:
    return every_node(edges, nodes).join(values, ["subject", "node"], "left").select("subject", "node", F.coalesce(name, F.lit(zero)).alias(name))


def degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    d = symmetric(edges).groupBy("subject", F.col("i").alias("node")).agg(F.count("*").alias("degree"))
    return _on_all(d, edges, nodes, "degree", 0)


def strength(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    s = symmetric(edges).groupBy("subject", F.col("i").alias("node")).agg(F.sum(F.col("w").cast("double")).alias("strength"))
    return _on_all(s, edges, nodes, "strength", 0.0)


def triangles(edges: DataFrame) -> DataFrame:
    """(subject, a, b, c, t): each triangle once, a < b < c, with the product of its weights' cube roots."""
    e = edges.select("subject", "i", "j", F.cbrt(F.col("w").cast("double")).alias("r"))
    x = e.select("subject", F.col("i").alias("a"), F.col("j").alias("b"), F.col("r").alias("r1"))
    y = e.select("subject", F.col("i").alias("b"), F.col("j").alias("c"), F.col("r").alias("r2"))
    z = e.select("subject", F.col("i").alias("a"), F.col("j").alias("c"), F.col("r").alias("r3"))
    return x.join(y, ["subject", "b"]).join(z, ["subject", "a", "c"]).select("subject", "a", "b", "c", (F.col("r1") * F.col("r2") * F.col("r3")).alias("t"))


def clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Weighted clustering coefficient: twice the triangles' sum over k (k - 1), 0 without triangles; weights are not rescaled."""
    t = triangles(edges).select("subject", F.explode(F.array("a", "b", "c")).alias("node"), "t").groupBy("subject", "node").agg(F.sum("t").alias("t"))
    c = degree(edges, nodes).join(t, ["subject", "node"], "left")
    value = F.try_divide(2 * F.col("t"), (F.col("degree") * (F.col("degree") - 1)).cast("double"))
    return c.select("subject", "node", F.coalesce(value, F.lit(0.0)).alias("clustering"))


def distance_round(d: DataFrame) -> DataFrame:
    """One min-plus squaring of distances (subject, i, j, d): paths of up to twice as many edges."""
    a, b = d.select("subject", "i", F.col("j").alias("k"), F.col("d").alias("d1")), d.select("subject", F.col("i").alias("k"), "j", F.col("d").alias("d2"))
    through = a.join(b, ["subject", "k"]).where("i <> j").groupBy("subject", "i", "j").agg(F.min(F.col("d1") + F.col("d2")).alias("d"))
    return d.union(through).groupBy("subject", "i", "j").agg(F.min("d").alias("d"))


def efficiency(distances: DataFrame, n: int) -> DataFrame:
    """Global efficiency: mean of 1 / d over ordered pairs; unreachable pairs, which have no row, count 0."""
    return distances.where("i <> j").groupBy("subject").agg((F.sum(1 / F.col("d")) / (n * (n - 1))).alias("efficiency"))


def path_summary(distances: DataFrame) -> DataFrame:
    """Characteristic path length and diameter over reachable pairs."""
    return distances.where("i <> j").groupBy("subject").agg(F.avg("d").alias("path_length"), F.max("d").alias("diameter"))


def path_length(distances: DataFrame, n: int, include_diagonal: bool = False, include_infinite: bool = True) -> DataFrame:
    """(subject, path_length): mean distance over ordered pairs of n nodes, with the zeros of the diagonal if asked for; infinite
    where some pair is unreachable, unless such pairs are left out."""
    sums = distances.where("i <> j").groupBy("subject").agg(F.sum(F.col("d").cast("double")).alias("all_d"), F.count("*").alias("reached"))
    mean = F.col("all_d") / (F.col("reached") + (n if include_diagonal else 0))
    if include_infinite:
        mean = F.when(F.col("reached") < n * (n - 1), F.lit(float("inf"))).otherwise(mean)
    return sums.select("subject", mean.alias("path_length"))


def mean_weight(edges: DataFrame, n: int) -> DataFrame:
    """Mean entry of the weight matrix, diagonal included."""
    return edges.groupBy("subject").agg((F.sum(F.col("w").cast("double")) * 2 / (n * n)).alias("mean_weight"))


def _with_community(edges: DataFrame, communities: DataFrame, end: str, name: str) -> DataFrame:
    """edges with the community of the node at one end. communities(node, ci) are common to all subjects, communities(subject, node, ci) each
    subject's own."""
    if "subject" in communities.columns:
        return edges.join(communities.select("subject", F.col("node").alias(end), F.col("ci").alias(name)), ["subject", end])
    return edges.join(F.broadcast(communities.select(F.col("node").alias(end), F.col("ci").alias(name))), end)


def participation(edges: DataFrame, communities: DataFrame, nodes: DataFrame, degree: str = "undirected") -> DataFrame:
    """1 - sum over communities of (weight into it / strength) squared; 0 for isolated nodes.

    communities are (node, ci), or (subject, node, ci) where each subject has its own. degree: undirected, or for edges from i to j the weights that go 'out' of a node or come 'in'."""
    if degree == "undirected":
        edges_of = symmetric(edges)
    elif degree in ("out", "in"):
        edges_of = edges.select("subject", *((F.col("i"), F.col("j")) if degree == "out" else (F.col("j").alias("i"), F.col("i").alias("j"))), "w")
    else:
        raise ValueError(f"degree must be undirected, out or in, not {degree}")
    per = _with_community(edges_of, communities, "j", "ci").groupBy("subject", F.col("i").alias("node"), "ci").agg(F.sum(F.col("w").cast("double")).alias("k"))
    p = per.groupBy("subject", "node").agg((1 - F.sum(F.col("k") * F.col("k")) / F.pow(F.sum("k"), 2)).alias("participation"))
    return _on_all(p, edges, nodes, "participation", 0.0)


def neighbour_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Weighted mean degree of the neighbours: sum of w_ij k_j over the strength; null for isolated nodes."""
    d = degree(edges, nodes).select("subject", F.col("node").alias("j"), "degree")
    s = symmetric(edges).join(d, ["subject", "j"]).groupBy("subject", F.col("i").alias("node"))
    v = s.agg(F.try_divide(F.sum(F.col("w") * F.col("degree")).cast("double"), F.sum("w").cast("double")).alias("neighbour_degree"))
    return every_node(edges, nodes).join(v, ["subject", "node"], "left")


def module_graph(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(subject, ci, cj, w): weights pooled by community, both directions, so a module's own entry counts edges twice."""
    return _with_community(_with_community(symmetric(edges), communities, "i", "ci"), communities, "j", "cj").groupBy("subject", "ci", "cj").agg(F.sum(F.col("w").cast("double")).alias("w"))


def modularity(edges: DataFrame, communities: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Q = sum over modules of pooled own weight / s - gamma * (pooled row sum / s) squared."""
    rows = module_graph(edges, communities).groupBy("subject", "ci").agg(F.sum("w").alias("row"), F.sum(F.when(F.col("ci") == F.col("cj"), F.col("w")).otherwise(0.0)).alias("own"))
    return rows.groupBy("subject").agg((F.sum("own") / F.sum("row") - gamma * F.sum(F.col("row") * F.col("row")) / F.pow(F.sum("row"), 2)).alias("q"))


def summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges, and largest, smallest, mean and median degree of each graph."""
    d = degree(edges, nodes).groupBy("subject").agg(
        F.count("*").alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"),
        F.avg("degree").alias("mean_degree"), F.percentile("degree", F.lit(0.5)).alias("median_degree"),
    )
    return d


def transitivity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Three times the triangles over the connected triples, and the mean unweighted clustering coefficient."""
    t = triangles(edges).select("subject", F.explode(F.array("a", "b", "c")).alias("node")).groupBy("subject", "node").agg(F.count("*").alias("t"))
    k = F.col("degree")
    per = degree(edges, nodes).join(t, ["subject", "node"], "left").select("subject", F.coalesce("t", F.lit(0)).alias("t"), (k * (k - 1) / 2).alias("triples"))
    return per.groupBy("subject").agg(F.coalesce(F.try_divide(F.sum("t").cast("double"), F.sum("triples")), F.lit(0.0)).alias("transitivity"), F.avg(F.coalesce(F.try_divide(F.col("t").cast("double"), F.col("triples")), F.lit(0.0))).alias("mean_clustering"))


def degree_histogram(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return degree(edges, nodes).groupBy("subject", "degree").agg(F.count("*").alias("n"))


def global_mean(values: DataFrame, name: str, n: int) -> DataFrame:
    """Mean of a node measure over all n nodes of a graph, whether or not they have a row."""
    return values.groupBy("subject").agg((F.sum(name) / n).alias(name))


def long(values: DataFrame, name: str) -> DataFrame:
    """A node measure as (subject, node, measure, value)."""
    return values.select("subject", "node", F.lit(name).alias("measure"), F.col(name).cast("double").alias("value"))
