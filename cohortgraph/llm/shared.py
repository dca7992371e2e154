"""Small helpers that several operators share: lineage cuts and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, as a regular-expression class.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: CRC-32 of a short string's UTF-8, bit by bit: bytes go in one after another, each followed by eight shifts, given as -1.
CRC_SQL = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: [('0x' || x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and Spark is local, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="spark-checkpoints-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from there, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is removed when the session's file system closes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where, files = _file_system(spark, path)
    files.deleteOnExit(where)
    if _open:
        _open[-1].append(path)
    return path


#: Paths that were made inside each open temporary() block.
_open: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that operators make for themselves inside the block go at its end, once all that reads them has been written."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    where, files = _file_system(spark, path)
    files.delete(where, True)


def store(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lineage cut with column pruning."""
    return store(df, new_path(df.sparkSession, name))


class Scratch:
    """Tables that are removed at the end of a with block, after all that reads them has been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_path(self.spark, name))
        return store(df, self.paths[-1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)
        let_go(self.spark)


def let_go(spark: SparkSession) -> None:
    """Has the driver collect what is no longer referenced: only then does Spark's cleaner remove the shuffles and broadcasts of
    the many small steps that an iterative operator has behind it."""
    spark.sparkContext._jvm.System.gc()


#: Bits of a key filter, whatever the number of keys: at most FILTER / 64 rows are sent to the tasks.
FILTER = 1 << 24


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """(cell, bits): a bitmap of hashed keys (long), of fixed size. Where there are very many keys it lets more through."""
    cells = keys.select(F.pmod(key, F.lit(FILTER)).alias("h"))
    return cells.groupBy(F.shiftrightunsigned("h", 6).cast("int").alias("__cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("__bits"))


def in_filter(df: DataFrame, key: str, held: DataFrame) -> DataFrame:
    """df with __in: whether the filter may hold the row's key (long). Nothing is shuffled."""
    where = df.withColumn("__h", F.pmod(key, F.lit(FILTER))).withColumn("__cell", F.shiftrightunsigned("__h", 6).cast("int"))
    bit = F.expr("shiftrightunsigned(__bits, cast(__h & 63 as int)) & 1L") == 1
    return where.join(F.broadcast(held), "__cell", "left").withColumn("__in", F.coalesce(bit, F.lit(False))).drop("__h", "__cell", "__bits")


def among(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of df whose key (long) is among keys, a table of that one column: most others are filtered out before the shuffle."""
    return in_filter(df, key, key_filter(keys, key)).where("__in").drop("__in").join(keys.distinct(), key, "left_semi")


def row_keys(df: DataFrame) -> tuple[Column, Column]:
    """A 128-bit key of a whole row in two longs, nulls told apart from other values. Rows are the same where all columns
    that can be hashed (not maps and variants) are."""
    names = [f"`{name.replace('`', '``')}`" for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    nulls = F.array(*(F.col(c).isNull() for c in names))
    return F.xxhash64(nulls, *names), F.xxhash64(F.lit(1), *reversed(names), nulls)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list, by alternating large and small stars.

    Returns (id, component) for each node of an edge; component is the smallest id reachable. Self-loops and
    nulls are ignored, so a node that has only those is absent. Ids may be of any orderable type. A hub's edges
    are split by Spark's skew join; minima are combined before the shuffle; each round ends in a checkpoint.
    """
    spark, x, y, held = edges.sparkSession, F.col(a), F.col(b), []

    def kept(df: DataFrame) -> DataFrame:
        """df, stored; what came before the last two tables is no longer read and goes."""
        held.append(new_path(spark, "star"))
        out = store(df, held[-1])
        for path in held[:-2]:
            remove(spark, path)
        del held[:-2]
        return out

    e = kept(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    seen = None
    while True:
        size = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if size == seen or size[0] == 0:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        seen = size
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = kept(both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = kept(small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct())
