"""Network-level inference over edge statistics stats(i, j, stat), i < j: components, NBS, threshold-free scores, DDT."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortgraph.operators import resample, stats
from cohortgraph.operators.lineage import placed


def above(edge_stats: DataFrame, limit: float) -> DataFrame:
    return edge_stats.where(F.col("stat") > limit)


def whole_graphs(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by keys, cut so that no graph lies in two of them."""
    rest = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        other = (pdf[list(keys)] != pdf[list(keys)].iloc[-1]).any(axis=1).to_numpy()
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if cut:
            yield pdf.iloc[:cut]
        rest = pdf.iloc[cut:]
    if rest is not None and len(rest):
        yield rest


def _sorted_graphs(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of n nodes, for edges a - b of any number of graphs at once."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, before[a], least)
        np.minimum.at(label, before[b], least)
        label = label[label]
        if (label == before).all():
            return label


def components(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, i, j, component, size): connected components within each group of keys, named by their smallest node;
    size counts edges. A group is the edges of one graph; a task works on all graphs of a batch at once."""
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_graphs(batches, keys):
            graph = pdf.groupby(list(keys), sort=False).ngroup().to_numpy()
            i, j = pdf["i"].to_numpy(np.int64), pdf["j"].to_numpy(np.int64)
            nodes, at = np.unique(np.concatenate((np.stack((graph, i), 1), np.stack((graph, j), 1))), axis=0, return_inverse=True)
            at = at.ravel()
            label = _labels(at[: len(i)], at[len(i) :], len(nodes))[at[: len(i)]]
            size = np.bincount(label, minlength=len(nodes))[label]
            yield pdf[[*keys, "i", "j"]].assign(component=nodes[label, 1].astype(np.int32), size=size.astype(np.int32))

    fields = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", i int, j int, component int, size int"
    return _sorted_graphs(edges.select(*keys, "i", "j"), keys).mapInPandas(run, fields)


def nbs(permuted: DataFrame, thresholds: Sequence[float], n: int) -> DataFrame:
    """(threshold, component, size, p): components of the edges whose statistic passes each threshold, and the share of the n
    permutations whose largest component has at least as many edges. permuted(perm, i, j, stat), observed at perm 0."""
    grid = F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))
    passed = permuted.select("perm", "i", "j", "stat", grid.alias("threshold")).where("stat > threshold")
    sized = components(passed, ["perm", "threshold"]).select("perm", "threshold", "component", "size").distinct()
    found = sized.where("perm = 0").select("threshold", "component", "size")
    largest = sized.where("perm > 0").groupBy("perm", "threshold").agg(F.max("size").alias("largest"))
    null = largest.groupBy("threshold", "largest").agg(F.count("*").alias("c")).withColumnRenamed("threshold", "at")
    beyond = found.join(null, (F.col("threshold") == F.col("at")) & (F.col("largest") >= F.col("size")), "left")
    return beyond.groupBy("threshold", "component", "size").agg((F.coalesce(F.sum("c"), F.lit(0)) / n).alias("p"))


def without_single_edges(edges: DataFrame) -> DataFrame:
    """Edges but for those that are a component of their own."""
    ends = edges.select(F.explode(F.array("i", "j")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    a, b = ends.select(F.col("node").alias("i"), F.col("d").alias("di")), ends.select(F.col("node").alias("j"), F.col("d").alias("dj"))
    return edges.join(a, "i").join(b, "j").where("not (di = 1 and dj = 1)").select(*edges.columns)


def significant_components(labelled: DataFrame, tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Labelled edges of the components with p under alpha, components numbered from 1 without gaps."""
    kept = labelled.join(tests.where(F.col("p") < alpha).select("component"), "component", "left_semi")
    return relabelled(kept)


def relabelled(labelled: DataFrame) -> DataFrame:
    return labelled.join(_ordered(labelled), "component").drop("component").withColumnRenamed("label", "component")


def _ordered(labelled: DataFrame) -> DataFrame:
    """(component, label): components numbered from 1 in their order."""
    return placed(labelled.select("component").distinct(), [], ["component"]).select("component", (F.col("place") + 1).cast("int").alias("label"))


def larger_components(labelled: DataFrame, least: int = 2) -> DataFrame:
    return labelled.where(F.col("size") >= least)


def ladder(edge_stats: DataFrame, n_nodes: int, steps: int = 100) -> DataFrame:
    """(r, h): steps thresholds from the smallest non-zero statistic up to the 99.5th percentile, end excluded.

    The percentile is over the full symmetric matrix with its zero diagonal: its place among the zeros and the doubled edges
    is worked out from the edges alone."""
    total = n_nodes * n_nodes
    place = (total - 1) * 0.995
    low, part = int(place), place - int(place)
    # Only the top of the ascending matrix is above the percentile; each edge fills two places of it.
    top = (total - 1 - low) // 2 + 1
    largest = edge_stats.where("stat > 0").select("stat").orderBy(F.desc("stat")).limit(top).agg(F.sort_array(F.collect_list("stat"), asc=False).alias("top"))
    at = lambda x: F.coalesce(F.try_element_at("top", F.lit((total - 1 - x) // 2 + 1)), F.lit(0.0))
    ends = edge_stats.where("stat > 0").agg(F.min("stat").alias("lo")).crossJoin(largest).select("lo", (at(low) + part * (at(low + 1) - at(low))).alias("hi"))
    return ends.select(F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("r"), "lo", "hi").select("r", (F.col("lo") + F.col("r") * (F.col("hi") - F.col("lo")) / steps).alias("h"))


def rungs_of(stat: np.ndarray, n_nodes: int, steps: int) -> np.ndarray:
    """ladder() of one graph's statistics."""
    full = np.sort(np.concatenate((stat, stat, np.zeros(max(0, n_nodes * n_nodes - 2 * len(stat))))))
    some = stat[stat > 0]
    if not len(some):
        return np.zeros(0)
    place = (len(full) - 1) * 0.995
    low = int(place)
    hi = full[low] + (place - low) * (full[min(low + 1, len(full) - 1)] - full[low])
    return some.min() + np.arange(steps) * (hi - some.min()) / steps


def _scores(stat: np.ndarray, i: np.ndarray, j: np.ndarray, h: np.ndarray, e_power: float, h_power: float) -> np.ndarray:
    """Sum over thresholds below an edge's statistic of size ** E * h ** H. From the top threshold down components only
    merge, so one pass in descending order of statistics serves all thresholds."""
    order = np.argsort(-stat, kind="stable")
    nodes, at = np.unique(np.concatenate((i[order], j[order])), return_inverse=True)
    a, b, below = at[: len(stat)], at[len(stat) :], -stat[order]
    label, out, k = np.arange(len(nodes)), np.zeros(len(stat)), 0
    for level in h[::-1]:
        end = int(np.searchsorted(below, -level, "left"))
        for x, y in zip(a[k:end].tolist(), b[k:end].tolist()):
            if label[x] != label[y]:
                label[label == label[y]] = label[x]
        k = max(k, end)
        own = label[a[:k]]
        out[:k] += np.bincount(own, minlength=len(nodes))[own] ** e_power * level**h_power
    scores = np.zeros(len(stat))
    scores[order] = out
    return scores


def threshold_free(edge_stats: DataFrame, rungs: DataFrame, e_power: float = 0.5, h_power: float = 3.0) -> DataFrame:
    """(i, j, score): threshold-free scores of the edges of one graph. rungs(r, h) are a bounded list of thresholds."""
    h = np.array([r["h"] for r in rungs.orderBy("r").select("h").collect()])  # as many as there are steps

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"], "j": pdf["j"], "score": _scores(pdf["stat"].to_numpy(), pdf["i"].to_numpy(), pdf["j"].to_numpy(), h, e_power, h_power)})

    return edge_stats.withColumn("__g", F.lit(0)).groupBy("__g").applyInPandas(run, "i int, j int, score double")


def threshold_free_each(permuted: DataFrame, n_nodes: int, steps: int = 100, e_power: float = 0.5, h_power: float = 2.75) -> DataFrame:
    """(perm, i, j, score): threshold-free scores of the absolute statistics of each permutation, over its own thresholds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_graphs(batches, ["perm"]):
            score, stat, i, j = np.zeros(len(pdf)), pdf["stat"].abs().to_numpy(), pdf["i"].to_numpy(), pdf["j"].to_numpy()
            ends = np.flatnonzero(np.diff(pdf["perm"].to_numpy())) + 1
            for lo, hi in zip([0, *ends], [*ends, len(pdf)]):
                score[lo:hi] = _scores(stat[lo:hi], i[lo:hi], j[lo:hi], rungs_of(stat[lo:hi], n_nodes, steps), e_power, h_power)
            yield pdf[["perm", "i", "j"]].assign(score=score)

    return _sorted_graphs(permuted.select("perm", "i", "j", "stat"), ["perm"]).mapInPandas(run, "perm int, i int, j int, score double")


def threshold_free_test(permuted: DataFrame, n_nodes: int, n: int, steps: int = 100, e_power: float = 0.5, h_power: float = 2.75, alpha: float = 0.05) -> DataFrame:
    """(i, j, score, p, t_max): observed scores, the share of permutations with at least the edge's score, and the score at
    place floor(alpha n) of the largest scores in descending order."""
    scored = threshold_free_each(permuted, n_nodes, steps, e_power, h_power).withColumnRenamed("score", "stat")
    obs = scored.where("perm = 0").select("i", "j", F.col("stat").alias("score"))
    p = scored.where("perm > 0").join(obs, ["i", "j"]).groupBy("i", "j", "score").agg((F.count_if(F.col("stat") >= F.col("score")) / n).alias("p"))
    return p.crossJoin(F.broadcast(resample.critical(scored, alpha, n)))


def threshold_free_masks(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(i, j, corrected, shown): whether the score passes the single threshold, and 1 - p where 0 < p <= alpha, else 0."""
    shown = F.when((F.col("p") > 0) & (F.col("p") <= alpha), 1 - F.col("p")).otherwise(0.0)
    return tests.select("i", "j", (F.col("score") > F.col("t_max")).cast("int").alias("corrected"), shown.alias("shown"))


# Difference degree test


def logit_difference(tests: DataFrame, clip: float = 12.0) -> DataFrame:
    """(i, j, d): logit of 1 - p of each edge, clipped on both sides."""
    d = 1 - F.col("p")
    inner = F.when(d <= 0, -clip).when(d >= 1, clip).otherwise(F.ln(F.try_divide(d, 1 - d)))
    return tests.select("i", "j", F.least(F.greatest(inner, F.lit(-clip)), F.lit(clip)).alias("d"))


def ddt_moments(logits: DataFrame, n_nodes: int) -> DataFrame:
    """One row (e_bar, v_bar, m, mu, sigma2): moments of the off-diagonal entries and the parameters of null networks with
    the same ones; the mean diagonal is 0."""
    first = logits.agg(F.avg("d").alias("e_bar"), F.var_pop("d").alias("v_bar"))
    m = F.greatest(F.lit(2), F.floor(F.try_divide(-F.pow("e_bar", 2), F.col("v_bar")))).cast("int")
    mu = F.sqrt(F.greatest(F.col("e_bar"), F.lit(0.0)) / F.col("m"))
    out = first.withColumn("m", m).withColumn("mu", mu)
    return out.withColumn("sigma2", -F.pow("mu", 2) + F.sqrt(F.pow("mu", 4) + F.col("v_bar") / F.col("m")))


def network_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree): edges of each node in one network of edges(i, j)."""
    ends = edges.select(F.explode(F.array("i", "j")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.join(ends, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def observed_degree(logits: DataFrame, nodes: DataFrame, gamma: float) -> DataFrame:
    """(node, degree): entries over gamma in the row of each node."""
    return network_degree(logits.where(F.col("d") > gamma), nodes)


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


#: Parts in which random numbers are drawn.
DRAW_PARTS = 64


def mixture_threshold(spark: SparkSession, m: int, mu: float, sigma2: float, draws: int = 1_000_000, seed: int = 0) -> float:
    """97.5th percentile of the scaled difference of a non-central and a central chi-square, as a probability.

    Both have m degrees of freedom; Spark draws them in a fixed number of parts, each with a seed of its own, and takes the
    percentile, so the cluster's size makes no difference."""
    lam = 4 * m * mu * mu / (2 * sigma2)
    c = 2 * sigma2 / 4
    z = lambda k: F.randn(seed + k)
    noncentral, central = F.pow(z(0) + math.sqrt(lam), 2), F.pow(z(1), 2)
    for k in range(1, m):
        noncentral, central = noncentral + F.pow(z(2 * k), 2), central + F.pow(z(2 * k + 1), 2)
    h = spark.range(0, draws, 1, DRAW_PARTS).select((c * noncentral - c * central).alias("h"))
    return h.agg(expit(F.percentile("h", F.lit(0.975)))).first()[0]


def null_networks(spark: SparkSession, n: int, m: int, mu: float, sigma2: float, u: int, seed: int = 0) -> DataFrame:
    """(u, i, j, c): u null networks of n nodes, Gram matrices of n x m normal draws; both triangles and the diagonal."""

    def run(batches):
        for pdf in batches:
            for k in pdf["id"]:
                rows = np.random.default_rng([seed, int(k)]).normal(mu, math.sqrt(sigma2), (n, m))
                i, j = np.indices((n, n)).reshape(2, -1)
                yield pd.DataFrame({"u": int(k), "i": (i + 1).astype(np.int32), "j": (j + 1).astype(np.int32), "c": (rows @ rows.T).ravel()})

    return spark.range(0, u, 1, min(u, DRAW_PARTS)).mapInPandas(run, "u int, i int, j int, c double")


def empirical_threshold(null: DataFrame) -> float:
    """Largest over null networks of the 97.5th percentile of off-diagonal entries, as a probability."""
    per = null.where("i <> j").groupBy("u").agg(F.percentile("c", F.lit(0.975)).alias("q"))
    return per.agg(expit(F.max("q"))).first()[0]


def null_diagnostics(null: DataFrame) -> DataFrame:
    off = F.col("i") != F.col("j")
    return null.agg(F.avg(F.when(off, F.col("c"))).alias("off_mean"), F.var_pop(F.when(off, F.col("c"))).alias("off_var"), F.avg(F.when(~off, F.col("c"))).alias("diagonal_mean"))


def difference_degree(logits: DataFrame, nodes: DataFrame, n: int, method: str = "addt", u: int = 1000, draws: int = 1_000_000, seed: int = 0, alpha: float = 0.05, least: int = 3) -> DataFrame:
    """(node, degree, null_p, null_degree, pmf, kept): nodes whose observed difference degree passes the null's.

    method addt takes the threshold from the mixture, eddt from the null networks. kept is the degree where it is over a
    seeded binomial draw, its binomial probability under alpha, and itself at least least; else 0."""
    spark = logits.sparkSession
    p = ddt_moments(logits, n).first()
    null = null_networks(spark, n, p["m"], p["mu"], p["sigma2"], u, seed)
    if method not in ("addt", "eddt"):
        raise stats.MethodError(f"no method {method}")
    limit = mixture_threshold(spark, p["m"], p["mu"], p["sigma2"], draws, seed) if method == "addt" else empirical_threshold(null)
    gamma = math.log(limit / (1 - limit))
    rates = null.groupBy(F.col("i").alias("node")).agg((F.count_if(F.col("c") >= gamma) / (u * (n - 1))).alias("null_p"))

    @F.pandas_udf("struct<null_degree: int, pmf: double>")
    def tail(node: pd.Series, degree: pd.Series, rate: pd.Series) -> pd.DataFrame:
        rate = rate.clip(0, 1)
        drawn = [np.random.default_rng([seed, int(v)]).binomial(n - 1, r) for v, r in zip(node, rate)]
        pmf = [math.comb(n - 1, int(d)) * r ** int(d) * (1 - r) ** (n - 1 - int(d)) for d, r in zip(degree, rate)]
        return pd.DataFrame({"null_degree": np.array(drawn, np.int32), "pmf": pmf})

    seen = observed_degree(logits, nodes, gamma).join(rates, "node").withColumn("x", tail("node", "degree", "null_p"))
    kept = (F.col("degree") > F.col("x.null_degree")) & (F.col("x.pmf") < alpha) & (F.col("degree") >= least)
    return seen.select("node", "degree", "null_p", "x.null_degree", "x.pmf", F.when(kept, F.col("degree")).otherwise(0).alias("kept"))
