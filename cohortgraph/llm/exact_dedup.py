"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised texts, an external sort places equal texts next to each other, and
the sort-based aggregation compares neighbours in full. Everything is built from DataFrame functions.

The range key is a bounded prefix of the normalised text, then its 64-bit hash, then a slice drawn from doc_id. The
bounded prefix keeps the splitter sample small whatever the texts' lengths. The slice lets splitters fall inside a
group of equal texts, so a group that holds a third of all rows is sorted by several tasks; each leaves one row, and
those few rows meet by SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgraph.llm.shared import SPACE, row_keys, table

#: Slices into which a group of equal texts may be cut.
SLICES = 64
#: Characters of the normalised text in the range key.
KEY_CHARS = 24


def _normal(rows: DataFrame, dealt: Column) -> DataFrame:
    """rows (id, t and others) with length, normalised text and slice in place of t."""
    return rows.select("*", F.length("t").cast("long").alias("n"), F.regexp_replace("t", f"{SPACE}+", "").alias("norm"), F.pmod(dealt, F.lit(SLICES)).cast("int").alias("slice")).drop("t")


def _runs(rows: DataFrame, *tie: str) -> DataFrame:
    """One row for each group and slice: sha, slice, best, copies. best is the most code points, the smallest id, then tie."""
    keyed = rows.select("*", F.substring("norm", 1, KEY_CHARS).alias("head"), F.xxhash64("norm").alias("h"))
    best = F.max(F.struct(F.col("n"), (-F.col("id")).alias("neg"), *tie)).alias("best")
    return table(
        keyed.repartitionByRange("head", "h", "slice")
        .groupBy("head", "h", "slice", "norm")
        .agg(best, F.count("*").alias("copies"))
        .select(F.sha2("norm", 256).alias("sha"), "slice", "best", "copies"), "runs",
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical once white space is removed; null counts as empty, and empty texts are one group.
    Of a group the row with the most code points stays, then the smallest id. A null id loses every tie and stays only
    where all of its group are null. Rows that repeat both id and text are each counted; all of them are kept or none.
    Other columns of docs are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = _normal(docs.select(F.col(id_col).alias("id"), text.alias("t")), F.xxhash64("id"))
    runs = _runs(rows)
    whole = runs.groupBy("sha").agg(F.max("best").alias("best"), F.sum("copies").alias("group_size"))
    members = rows.select("id", F.sha2("norm", 256).alias("text_sha256"), "slice", "n")
    # The winner is sent to each slice of its group, so the join back to the rows has no key hotter than a slice.
    winners = whole.select("sha", (-F.col("best.neg")).alias("keep_id"), F.col("best.n").alias("keep_n"), "group_size")
    winners = runs.select("sha", "slice").join(winners, "sha").withColumnsRenamed({"sha": "w_sha", "slice": "w_slice"})
    out = members.join(winners, (F.col("text_sha256") == F.col("w_sha")) & (F.col("slice") == F.col("w_slice")))
    return out.select(
        F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))).alias("kept"), "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of exact_groups; all columns stay.

    Rows are told apart by all their columns, so null and repeated ids do no harm: of rows that tie by length and id one
    stays, and so does one of fully equal rows."""
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *(k.alias(f"k{i}") for i, k in enumerate(row_keys(docs), 1)))
    whole = _runs(_normal(keyed.drop("row"), F.col("k1")), "k1", "k2").groupBy("sha").agg(F.max("best").alias("best"))
    stay = whole.select(F.col("best.k1").alias("k1"), F.col("best.k2").alias("k2"))
    return keyed.select("row", "k1", "k2").dropDuplicates(["k1", "k2"]).join(stay, ["k1", "k2"], "left_semi").select("row.*")


SQL = """
WITH r AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm FROM documents),
     g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
                  count(*) OVER (PARTITION BY norm) AS group_size FROM r)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
