"""Lineage cuts, and exact numbers of rows in order without a window over all of them."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the folder that spark.checkpoint.dir names; a local session without one gets its own."""
    context = df.sparkSession.sparkContext
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) is None and not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return df.checkpoint()


def placed(rows: DataFrame, group: Sequence[str], order: Sequence, place: str = "place", total: str | None = None) -> DataFrame:
    """rows with their number, from 0, in the order inside their group, and the rows of the group where total names it.

    Rows are range-partitioned by group and order, so a group of any size is many tasks' work; a task counts its own, and only
    counts of (group, part) are added up. order must tell rows apart, else equal ones are numbered in any order."""
    by = [*(F.col(g).asc_nulls_first() for g in group), *order]
    held = checkpointed(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    parts = held.groupBy(*group, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    of = Window.partitionBy(*(group or [F.lit(0)]))  # a row for each part
    shift = (F.sum("__n").over(of.orderBy("__part")) - F.col("__n") - F.col("__first")).alias("__shift")
    parts = parts.select(*(F.col(g).alias(f"__{k}") for k, g in enumerate(group)), F.col("__part").alias("__p"), shift, F.sum("__n").over(of).alias("__total"))
    same = F.col("__part") == F.col("__p")
    for k, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"__{k}"))
    return held.join(parts, same).select(*rows.columns, (F.col("__at") + F.col("__shift")).cast("long").alias(place), *([F.col("__total").alias(total)] if total else []))
