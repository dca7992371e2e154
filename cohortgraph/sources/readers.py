"""Readers of cohort inputs: matrix and volume files, metadata, atlas; and the long tables of this library as Parquet."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = "subject string, i int, j int, w double"


def _name(prefix: str, suffix: str):
    """File name without its folder, prefix and suffix."""
    base = F.regexp_extract("path", "([^/]+)$", 1)
    return F.substring(base, F.lit(len(prefix) + 1), F.length(base) - len(prefix) - len(suffix))


def files(spark: SparkSession, folder: str, prefix: str = "", suffix: str = "") -> DataFrame:
    """(subject, content, length) of the files of a folder whose names start and end so; subject is the rest of the name."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*{suffix}").load(folder)
    return found.select(_name(prefix, suffix).alias("subject"), "content", "length")


_MATLAB = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


def matlab_matrix(data: bytes, name: str) -> np.ndarray:
    """The real numeric matrix of a name in a MATLAB level 5 file."""
    if len(data) < 128:
        raise ValueError("too short for a MATLAB file")
    order = "<" if data[126:128] == b"IM" else ">"

    def elements(block: bytes):
        at = 0
        while at + 8 <= len(block):
            kind, size = struct.unpack_from(order + "II", block, at)
            if kind >> 16:  # small element: type and size share a word
                yield kind & 0xFFFF, block[at + 4 : at + 4 + (kind >> 16)]
                at += 8
            else:
                yield kind, block[at + 8 : at + 8 + size]
                at += 8 + size + (-size % 8 if kind != 15 else 0)

    for kind, body in elements(data[128:]):
        if kind == 15:
            kind, body = next(elements(zlib.decompress(body)))
        if kind != 14:
            continue
        parts = list(elements(body))
        shape = np.frombuffer(parts[1][1], order + "i4")
        if parts[2][1].decode() == name:
            stored, raw = parts[3]
            return np.frombuffer(raw, order + _MATLAB[stored]).reshape(shape, order="F")
    raise KeyError(name)


def matlab_edges(spark: SparkSession, folder: str, suffix: str = "_fiber_number.mat", name: str = "Measure") -> DataFrame:
    """edges(subject, i, j, w), i <= j and w not 0, from a folder of MATLAB matrices, one file a subject."""

    def decode(batches):
        for pdf in batches:
            for s, data in zip(pdf["subject"], pdf["content"]):
                m = np.asarray(matlab_matrix(bytes(data), name), float)
                i, j = np.nonzero(np.triu(m))
                yield pd.DataFrame({"subject": s, "i": (i + 1).astype(np.int32), "j": (j + 1).astype(np.int32), "w": m[i, j]})

    return files(spark, folder, suffix=suffix).select("subject", "content").mapInPandas(decode, EDGES)


def _lines(text: Column) -> Column:
    """The lines of a text that are not blank."""
    return F.filter(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(x) != "")


def text_volumes(spark: SparkSession, folder: str, prefix: str = "volume_ROI_", suffix: str = ".txt") -> DataFrame:
    """volumes(subject, node, v0, v1) from white-space separated text, a line for each node; empty files and blank lines are skipped."""
    lines = files(spark, folder, prefix, suffix).where("length > 0").select("subject", F.posexplode(_lines(F.decode("content", "UTF-8"))).alias("k", "line"))
    cells = F.split(F.trim("line"), r"\s+")
    return lines.select("subject", (F.col("k") + 1).alias("node"), F.get(cells, F.lit(0)).try_cast("double").alias("v0"), F.get(cells, F.lit(1)).try_cast("double").alias("v1"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """subjects(name, age, gender) from a CSV with Subject, Age and Gender; an empty age is null."""
    raw = spark.read.csv(path, header=True)
    return raw.select(F.col("Subject").alias("name"), F.col("Age").try_cast("int").alias("age"), F.col("Gender").try_cast("int").alias("gender"))


def response(spark: SparkSession, path: str) -> DataFrame:
    """response(id, responder, duration) from a CSV with ID, Rep_M6_MADRS and duree_ma_M0."""
    raw = spark.read.csv(path, header=True)
    return raw.select(F.col("ID").alias("id"), F.col("Rep_M6_MADRS").try_cast("int").alias("responder"), F.col("duree_ma_M0").try_cast("double").alias("duration"))


def medication(spark: SparkSession, path: str) -> DataFrame:
    """medication(id, load, a, b, c, d) from a CSV with these columns in this order after ID."""
    raw = spark.read.csv(path, header=True)
    load, *flags = [c for c in raw.columns if c != "ID"][:5]
    return raw.select(F.col("ID").alias("id"), F.col(f"`{load}`").try_cast("double").alias("load"), *(F.col(f"`{c}`").try_cast("int").alias(n) for c, n in zip(flags, "abcd")))


def atlas(spark: SparkSession, path: str) -> DataFrame:
    """atlas(node, x, y, z) from tab separated coordinates, a line for each node in order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(_lines(F.col("value"))).alias("k", "line"))
    cells = F.split(F.trim("line"), r"\s+")
    return lines.select((F.col("k") + 1).alias("node"), *(F.get(cells, F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")))


def write_table(df: DataFrame, folder: str, name: str, by: str | None = None) -> None:
    """One table of a cohort bundle as Parquet, in folders by a column if asked for."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(f"{folder}/{name}")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def feature_table(values: DataFrame, hits: DataFrame, on: list[str]) -> DataFrame:
    """Wide table, a row for each subject, of the values named by hits: what a classifier reads."""
    named = values.join(hits.select(*on).distinct(), on, "left_semi").select("subject", F.concat_ws("_", *on).alias("feature"), "value")
    return named.groupBy("subject").pivot("feature").agg(F.first("value"))
