"""Cohort labelling, identity matching, quality checks and demographics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgraph.operators import stats
from cohortgraph.operators.edges import symmetric
from cohortgraph.operators.lineage import placed


def cohort_of(name: Column, patients: Sequence[str], controls: Sequence[str]) -> Column:
    """patient if the name contains a patient key, else control if it contains a control key, else null."""
    has = lambda keys: F.exists(F.array(*map(F.lit, keys)), lambda k: name.contains(k))
    return F.when(has(patients), "patient").when(has(controls), "control")


def classify(subjects: DataFrame, patients: Sequence[str], controls: Sequence[str]) -> DataFrame:
    """subjects with their cohort; those that fit neither go."""
    return subjects.withColumn("cohort", cohort_of(F.col("name"), patients, controls)).where("cohort is not null")


def capped(subjects: DataFrame, n: int) -> DataFrame:
    """The first n subjects of each cohort by name."""
    return placed(subjects, ["cohort"], ["name"], "nth").where(F.col("nth") < n).drop("nth")


def excluding(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("subject"), "subject", "left_anti")


def restricted(rows: DataFrame, kept: DataFrame) -> DataFrame:
    return rows.join(kept.select("subject"), "subject", "left_semi")


def digits(name: Column) -> Column:
    """First run of digits of an identifier."""
    return F.regexp_extract(name, "[0-9]+", 0)


def matched_by_digits(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Rows of left and right whose identifiers share their first run of digits; a side without digits matches nothing."""
    a, b = left.withColumn("key", digits(F.col(left_id))), right.withColumn("key", digits(F.col(right_id)))
    return a.where("key <> ''").join(b, "key").drop("key")


def quality(edges: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject, entries, off_diagonal, state): state is empty, diagonal or ok."""
    sums = edges.groupBy("subject").agg(F.count("*").alias("entries"), F.count_if(F.col("i") != F.col("j")).alias("off_diagonal"))
    n, off = F.coalesce("entries", F.lit(0)), F.coalesce("off_diagonal", F.lit(0))
    return subjects.select("subject").join(sums, "subject", "left").select("subject", n.alias("entries"), off.alias("off_diagonal"), F.when(n == 0, "empty").when(off == 0, "diagonal").otherwise("ok").alias("state"))


def without_diagonal(edges: DataFrame, subjects: DataFrame, nodes: DataFrame) -> DataFrame:
    """(subject, node) whose diagonal entry is zero."""
    held = edges.where("i = j").select("subject", F.col("i").alias("node"))
    return subjects.select("subject").crossJoin(F.broadcast(nodes)).join(held, ["subject", "node"], "left_anti")


def demographics(subjects: DataFrame) -> DataFrame:
    """Counts by gender, mean and population deviation of age, for each cohort; rows without an age do not count."""
    return subjects.where("age is not null").groupBy("cohort").agg(
        F.count("*").alias("n"), F.count_if(F.col("gender") == 1).alias("male"), F.count_if(F.col("gender") == 2).alias("female"), F.avg("age").alias("age_mean"), F.stddev_pop("age").alias("age_std")
    )


def flag_shares(rows: DataFrame, flags: Sequence[str], n: int) -> DataFrame:
    """For each flag column, the percentage of n subjects with a value over 0."""
    one = rows.agg(*(F.count_if(F.col(c) > 0).alias(c) for c in flags))
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, flags)), F.array(*flags))).alias("flag", "k")).select("flag", (F.col("k") * 100.0 / n).alias("percent"))


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, observed, expected, part): part sums to the chi-square statistic of independence."""
    cells = rows.groupBy(a, b).agg(F.count("*").alias("observed"))
    full = rows.select(a).distinct().crossJoin(rows.select(b).distinct()).join(cells, [a, b], "left").fillna(0, ["observed"])
    ra, rb = rows.groupBy(a).agg(F.count("*").alias("na")), rows.groupBy(b).agg(F.count("*").alias("nb"))
    whole = rows.agg(F.count("*").alias("n"))
    expected = F.col("na") * F.col("nb") / F.col("n")
    out = full.join(ra, a).join(rb, b).crossJoin(F.broadcast(whole)).select(a, b, "observed", expected.alias("expected"))
    return out.withColumn("part", F.pow(F.col("observed") - F.col("expected"), 2) / F.col("expected"))


def crosstab_test(cells: DataFrame, a: str, b: str) -> DataFrame:
    """(chi2, df, p): the test of independence of a crosstab's cells."""
    sums = cells.agg(F.sum("part").cast("double").alias("chi2"), ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).cast("long").alias("df"))
    return sums.withColumn("p", stats.chi2_p(F.col("chi2"), F.col("df")))


def load_summary(rows: DataFrame, load: Column) -> DataFrame:
    """(n, mean, std): a load of subjects, such as a count of medications; rows without one do not count."""
    return rows.select(load.cast("double").alias("x")).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def removed_counts(removed: DataFrame, least: int = 100) -> DataFrame:
    """Subjects that lost more than least edges, and how many."""
    return removed.groupBy("subject").agg(F.count("*").alias("n_removed")).where(F.col("n_removed") > least)


def volume_summary(volumes: DataFrame, value: str = "v0") -> DataFrame:
    return volumes.groupBy("node").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def isolated(edges: DataFrame) -> DataFrame:
    """Degree of each (subject, node) that has an edge."""
    return symmetric(edges).groupBy("subject", F.col("i").alias("node")).agg(F.count("*").alias("degree"))
