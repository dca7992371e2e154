"""Two-sample tests and diagnostics for many variables at once: grouped plans for statistics, numpy for tails.

rows(keys..., cohort, value); group a is compared with group b, by default patient with control.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortgraph.functions import distributions as dist

A, B = "patient", "control"


class MethodError(ValueError):
    """The test asked for does not exist."""


def moments(rows: DataFrame, keys: Sequence[str], a: str = A, b: str = B, subjects: DataFrame | None = None) -> DataFrame:
    """(keys, na, ma, va, nb, mb, vb): counts, means and sample variances of both groups.

    With subjects(subject, cohort) every one of them counts for every variable, and one without a row has the value 0: sums and
    the cohorts' sizes tell the moments, and no row is made for it."""
    v, in_a, in_b = F.col("value").cast("double"), F.col("cohort") == a, F.col("cohort") == b
    names = ("na", "ma", "va", "nb", "mb", "vb")
    if subjects is None:
        side = lambda c: (F.count_if(c), F.avg(F.when(c, v)), F.var_samp(F.when(c, v)))
        return rows.where(in_a | in_b).groupBy(*keys).agg(*(x.alias(n) for n, x in zip(names, (*side(in_a), *side(in_b)))))
    sizes = subjects.agg(F.count_if(in_a).alias("na"), F.count_if(in_b).alias("nb"))
    total = lambda c, x, name: F.sum(F.when(c, x).otherwise(0.0)).alias(name)
    sums = rows.where(in_a | in_b).groupBy(*keys).agg(total(in_a, v, "sa"), total(in_a, v * v, "qa"), total(in_b, v, "sb"), total(in_b, v * v, "qb"))
    mean, spread = lambda s, n: F.try_divide(F.col(s), F.col(n)), lambda q, s, n: F.try_divide(F.col(q) - F.try_divide(F.col(s) * F.col(s), F.col(n)), F.col(n) - 1)
    of = {"na": F.col("na"), "ma": mean("sa", "na"), "va": spread("qa", "sa", "na"), "nb": F.col("nb"), "mb": mean("sb", "nb"), "vb": spread("qb", "sb", "nb")}
    return sums.crossJoin(F.broadcast(sizes)).select(*keys, *(of[n].alias(n) for n in names))  # sizes: one row


def summary_by_cohort(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy("cohort", *keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def welch(rows: DataFrame, keys: Sequence[str], a: str = A, b: str = B, subjects: DataFrame | None = None) -> DataFrame:
    """(keys, t, df): Welch's statistic and its degrees of freedom; null where both variances are 0."""
    x, y = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    m = moments(rows, keys, a, b, subjects).withColumns({"x": x, "y": y})
    t = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(F.col("x") + F.col("y")))
    df = F.try_divide(F.pow(F.col("x") + F.col("y"), 2), F.pow("x", 2) / (F.col("na") - 1) + F.pow("y", 2) / (F.col("nb") - 1))
    return m.where("na > 1 and nb > 1").select(*keys, t.alias("t"), df.alias("df"))


def pooled_t(rows: DataFrame, keys: Sequence[str], tail: str = "both", a: str = A, b: str = B, subjects: DataFrame | None = None) -> DataFrame:
    """(keys, t) with pooled variance: absolute for both tails, negated for left; 0 where nothing varies."""
    if tail not in ("both", "left", "right"):
        raise MethodError(f"no tail {tail}")
    n = F.col("na") + F.col("nb") - 2
    s = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / n)
    t = F.coalesce(F.try_divide(F.col("ma") - F.col("mb"), s * F.sqrt(1 / F.col("na") + 1 / F.col("nb"))), F.lit(0.0))
    return moments(rows, keys, a, b, subjects).where("na > 1 and nb > 1").select(*keys, {"both": F.abs(t), "left": -t, "right": t}[tail].alias("t"), n.alias("df"))


def variance_ratio(rows: DataFrame, keys: Sequence[str], a: str = A, b: str = B, subjects: DataFrame | None = None) -> DataFrame:
    """(keys, f, d1, d2): ratio of sample variances."""
    return moments(rows, keys, a, b, subjects).where("na > 1 and nb > 1").select(*keys, F.try_divide("va", "vb").alias("f"), (F.col("na") - 1).alias("d1"), (F.col("nb") - 1).alias("d2"))


def mid_ranks(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with rank, ties at their mean, within each group of keys."""
    by, same = Window.partitionBy(*keys).orderBy("value"), Window.partitionBy(*keys, "value")
    return rows.withColumn("rank", F.rank().over(by) + (F.count("*").over(same) - 1) / 2)


def mann_whitney(rows: DataFrame, keys: Sequence[str], a: str = A, b: str = B) -> DataFrame:
    """(keys, u1, u2, ties, na, nb): both U statistics; ties is the sum of t^3 - t over runs of equal values."""
    ranked = mid_ranks(rows.where(F.col("cohort").isin(a, b)), keys).withColumn("t", F.count("*").over(Window.partitionBy(*keys, "value")))
    na, nb = F.count_if(F.col("cohort") == a), F.count_if(F.col("cohort") == b)
    m = ranked.groupBy(*keys).agg(na.alias("na"), nb.alias("nb"), F.sum(F.when(F.col("cohort") == a, F.col("rank")).otherwise(0.0)).alias("ra"), F.sum((F.col("t") * F.col("t") - 1).cast("double")).alias("ties"))
    u1 = F.col("ra") - F.col("na") * (F.col("na") + 1) / 2
    return m.select(*keys, u1.alias("u1"), (F.col("na") * F.col("nb") - u1).alias("u2"), "ties", "na", "nb")


def levene(rows: DataFrame, keys: Sequence[str], a: str = A, b: str = B) -> DataFrame:
    """(keys, w, df): one-way statistic of absolute deviations from each group's median."""
    rows = rows.where(F.col("cohort").isin(a, b))
    mid = rows.groupBy(*keys, "cohort").agg(F.percentile("value", F.lit(0.5)).alias("mid"))
    z = rows.join(mid, [*keys, "cohort"]).withColumn("value", F.abs(F.col("value") - F.col("mid"))).drop("mid")
    m = moments(z, keys, a, b)
    n, grand = F.col("na") + F.col("nb"), (F.col("na") * F.col("ma") + F.col("nb") * F.col("mb")) / (F.col("na") + F.col("nb"))
    between = F.col("na") * F.pow(F.col("ma") - grand, 2) + F.col("nb") * F.pow(F.col("mb") - grand, 2)
    within = F.col("va") * (F.col("na") - 1) + F.col("vb") * (F.col("nb") - 1)
    return m.where("na > 1 and nb > 1").select(*keys, F.try_divide((n - 2) * between, within).alias("w"), (n - 2).alias("df"))


def t_p(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic."""

    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(dist.t_two_sided(t.to_numpy(float), df.to_numpy(float)))

    return tail(t, df)


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    """Upper-tail p of an F statistic."""

    @F.pandas_udf("double")
    def tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return pd.Series(dist.f_sf(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))

    return tail(f, d1, d2)


def chi2_p(x: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(dist.chi2_sf(x.to_numpy(float), df.to_numpy(float)))

    return tail(x, df)


def mann_whitney_p(u: DataFrame) -> DataFrame:
    """mann_whitney() with p: two-sided normal tail with tie and continuity corrections."""

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(1, 2 * dist.normal_sf(z.to_numpy(float))))

    n = (F.col("na") + F.col("nb")).cast("double")
    var = F.col("na") * F.col("nb") / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1)))
    z = F.try_divide(F.greatest("u1", "u2") - F.col("na") * F.col("nb") / 2 - 0.5, F.sqrt(var))
    return u.withColumn("p", tail(F.coalesce(z, F.lit(0.0))))


def raw_statistic(rows: DataFrame, keys: Sequence[str], method: str = "f", a: str = A, b: str = B, subjects: DataFrame | None = None) -> DataFrame:
    """(keys, stat): absolute statistic of a method, 0 where it is undefined. Ranks need a row for every subject."""
    if method == "welch":
        s = welch(rows, keys, a, b, subjects).withColumnRenamed("t", "stat")
    elif method == "f":
        s = variance_ratio(rows, keys, a, b, subjects).withColumnRenamed("f", "stat")
    elif method == "mannwhitneyu":
        s = mann_whitney(rows, keys, a, b).withColumnRenamed("u1", "stat")
    else:
        raise MethodError(f"no method {method}; there are welch, f and mannwhitneyu")
    return s.select(*keys, F.coalesce(F.abs("stat"), F.lit(0.0)).alias("stat"))


def counts_below(tests: DataFrame, keys: Sequence[str], bound: float) -> DataFrame:
    """(keys, n): tests with p under the bound, 0 where there are none."""
    return tests.groupBy(*keys).agg(F.count_if(F.col("p") < bound).alias("n"))


def outliers(rows: DataFrame, keys: Sequence[str], factor: float = 2.5) -> DataFrame:
    """Rows above the third quartile by more than factor interquartile ranges."""
    q = rows.groupBy(*keys).agg(F.percentile("value", F.lit(0.25)).alias("q1"), F.percentile("value", F.lit(0.75)).alias("q3"))
    return rows.join(q, list(keys)).where(F.col("value") > F.col("q3") + factor * (F.col("q3") - F.col("q1"))).select(*rows.columns)


def normal_fit(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sigma"))


def normal_density(x: Column, mu: Column, sigma: Column) -> Column:
    return F.exp(-F.pow((x - mu) / sigma, 2) / 2) / (sigma * math.sqrt(2 * math.pi))


def histogram(rows: DataFrame, keys: Sequence[str], bins: int = 50) -> DataFrame:
    """(keys, bin, n): counts in bins equal widths from least to largest, numbered from 1; the largest is in the last."""
    ends = rows.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = F.least(F.floor(F.coalesce(F.try_divide((F.col("value") - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))) + 1, F.lit(bins)).cast("int")
    return rows.join(ends, list(keys)).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """(W, p) by Royston's 1995 approximation; the p of three values is exact. Fewer, or equal ones, give 1 and 1."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0, 1.0
    if n == 3:
        w = max(0.75, min(1.0, (x[2] - x[0]) ** 2 / 2 / ((x - x.mean()) ** 2).sum()))
        return float(w), float(max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    m = dist.normal_quantile((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    ss, u = m @ m, 1 / math.sqrt(n)
    a = m / math.sqrt(ss)
    if n <= 5:
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, a[-1]], u)
        a = m / math.sqrt((ss - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[-1], a[0] = last, -last
    else:
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, a[-1]], u)
        second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u)
        phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a = m / math.sqrt(phi)
        a[-1], a[-2], a[0], a[1] = last, second, -last, -second
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if n < 12:  # the tail is that of -log(gamma - log(1 - W))
        gamma, y = 0.459 * n - 2.273, math.log(max(1 - w, 1e-300))
        if y >= gamma:
            return w, 0.0
        mu, sigma = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        return w, float(dist.normal_sf((-math.log(gamma - y) - mu) / sigma))
    k = math.log(n)
    mu, sigma = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
    return w, float(dist.normal_sf((math.log(max(1 - w, 1e-300)) - mu) / sigma))


def shapiro(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, w, p) of each group of keys; a group has one value for each subject."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(pdf["value"].to_numpy())
        return pd.DataFrame([[*key, w, None if math.isnan(p) else p]], columns=[*keys, "w", "p"])

    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", w double, p double")


def benjamini_hochberg(tests: DataFrame, family: Sequence[str] = (), p: str = "p") -> DataFrame:
    """tests with q, the adjusted p, within each family: the least over larger or equal p of p * m / rank.

    Equal p have the last of their ranks, so counts of distinct p are enough; without families they are summed up in parts of
    the range of p, and what meets in one place is one row for each part."""
    counts = tests.groupBy(*family, F.col(p).alias("__p")).agg(F.count("*").alias("__c"))
    part = F.least(F.floor(F.col("__p") * BH_PARTS), F.lit(BH_PARTS - 1)).alias("__part")
    sums = counts.groupBy(*family, part).agg(F.sum("__c").alias("__n"))
    over = Window.partitionBy(*family).orderBy("__part") if family else Window.orderBy("__part")
    whole = Window.partitionBy(*family) if family else Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = sums.withColumns({"__before": F.sum("__n").over(over) - F.col("__n"), "__m": F.sum("__n").over(whole)}).drop("__n")
    within = Window.partitionBy(*family, "__part").orderBy("__p")
    step = F.col("__p") * F.col("__m") / (F.col("__before") + F.sum("__c").over(within))
    stepped = counts.withColumn("__part", part).join(before, [*family, "__part"]).withColumn("__step", F.least(F.lit(1.0), step))
    later = stepped.groupBy(*family, "__part").agg(F.min("__step").alias("__least"))
    after = (Window.partitionBy(*family).orderBy(F.desc("__part")) if family else Window.orderBy(F.desc("__part"))).rowsBetween(Window.unboundedPreceding, -1)
    later = later.withColumn("__later", F.min("__least").over(after)).drop("__least")
    down = Window.partitionBy(*family, "__part").orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.min("__step").over(down), F.col("__later"))
    adjusted = stepped.join(later, [*family, "__part"]).select(*family, F.col("__p").alias(p), q.alias("q"))
    return tests.join(adjusted, [*family, p]).select(*tests.columns, "q")


#: Parts of the range of p in which ranks are counted.
BH_PARTS = 4096


def bonferroni(tests: DataFrame, family: Sequence[str] = (), p: str = "p") -> DataFrame:
    """tests with q = p times the number of tests of the family, at most 1."""
    sizes = tests.groupBy(*family).agg(F.count("*").alias("__m"))
    joined = tests.join(sizes, list(family)) if family else tests.crossJoin(F.broadcast(sizes))  # one row
    return joined.select(*tests.columns, F.least(F.lit(1.0), F.col(p) * F.col("__m")).alias("q"))
