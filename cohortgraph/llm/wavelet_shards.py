"""Token-id output as one wavelet matrix per shard.

Documents are ordered by id with a range partitioning, encoded, and cut into shards of a bounded number of tokens at
document boundaries. A shard's ids become succinct bit-planes with a rank directory: any token can be read, counted up to
a position, or located by occurrence without unpacking the rest. A shard is one row of a compressed Parquet file in the
folder given, with its documents' ids and lengths beside the planes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortgraph.llm.tokens import word_ids

#: Tokens after which a shard ends; a longer document is a shard of its own.
SHARD_TOKENS = 2_000_000
#: Words that a worker remembers while it encodes: an executor's workers share its memory with Spark.
WORDS_HELD = 600_000
#: Parts in which rows that are equal in id and text may be written.
SALTS = 64
#: Bits between two entries of the rank directory.
BLOCK = 512
_HEAD = struct.Struct("<4sBQ")
SCHEMA = "part int, seq int, doc_ids array<long>, lengths array<long>, n_tokens long, matrix binary"


class WaveletMatrix:
    """Read access to the bytes that build() makes. Positions and counts are numpy arrays or numbers."""

    def __init__(self, data: bytes):
        magic, self.bits, self.size = _HEAD.unpack_from(data)
        if magic != b"WVM1":
            raise ValueError("not a wavelet matrix")
        at, plane, blocks = _HEAD.size, -(-self.size // BLOCK) * (BLOCK // 8), -(-self.size // BLOCK) + 1
        self.zeros = np.frombuffer(data, "<u8", self.bits, at).astype(np.int64)
        at += 8 * self.bits
        self.planes, self.ranks = [], []
        for _ in range(self.bits):
            self.planes.append(np.frombuffer(data, np.uint8, plane, at))
            at += plane
            self.ranks.append(np.frombuffer(data, "<u4", blocks, at))
            at += 4 * blocks

    @staticmethod
    def build(ids: np.ndarray, bits: int) -> bytes:
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        n, blocks = len(x), -(-len(x) // BLOCK)
        zeros, body = [], []
        for shift in range(bits - 1, -1, -1):
            b = (x >> x.dtype.type(shift)) & x.dtype.type(1) != 0
            plane = np.zeros(blocks * BLOCK // 8, np.uint8)
            packed = np.packbits(b, bitorder="little")
            plane[: len(packed)] = packed
            ones = np.bitwise_count(plane.view(np.uint64)).reshape(blocks, BLOCK // 64).sum(axis=1)
            body += [plane.tobytes(), np.concatenate(([0], np.cumsum(ones))).astype("<u4").tobytes()]
            low = np.flatnonzero(~b)
            zeros.append(len(low))
            x = np.concatenate((x.take(low), x.take(np.flatnonzero(b))))  # places cost a third of what masks do
        return b"".join((_HEAD.pack(b"WVM1", bits, n), np.array(zeros, "<u8").tobytes(), *body))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position."""
        block, words = at // BLOCK, self.planes[level].view(np.uint64)
        out = self.ranks[level][np.minimum(block, len(self.ranks[level]) - 1)].astype(np.int64)
        for k in range(BLOCK // 64):
            w = block * (BLOCK // 64) + k
            take = np.clip(at - w * 64, 0, 64)
            some = take > 0
            mask = np.where(take == 64, ~np.uint64(0), (np.uint64(1) << (take % 64).astype(np.uint64)) - np.uint64(1))
            out[some] += np.bitwise_count(words[w[some]] & mask[some]).astype(np.int64)
        return out

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return self.planes[level][at >> 3] >> (at & 7).astype(np.uint8) & 1 != 0

    def access(self, at) -> np.ndarray:
        """Ids at the positions."""
        at = np.atleast_1d(np.asarray(at, np.int64)).copy()
        out = np.zeros(len(at), np.uint32)
        for level in range(self.bits):
            one, before = self._bit(level, at), self._ones(level, at)
            out = out << np.uint32(1) | one
            at = np.where(one, self.zeros[level] + before, at - before)
        return out

    def rank(self, token: int, at) -> np.ndarray:
        """How often the token occurs before each position."""
        hi = np.atleast_1d(np.asarray(at, np.int64)).copy()
        lo = np.zeros_like(hi)
        if token >> self.bits:
            return lo
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if token >> (self.bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return hi - lo

    def select(self, token: int) -> np.ndarray:
        """Positions of all occurrences of the token, ascending."""
        count = int(self.rank(token, self.size)[0])
        lo = np.zeros(1, np.int64)
        for level in range(self.bits):
            a = self._ones(level, lo)
            lo = self.zeros[level] + a if token >> (self.bits - 1 - level) & 1 else lo - a
        at = lo[0] + np.arange(count if not token >> self.bits else 0)
        for level in range(self.bits - 1, -1, -1):
            if token >> (self.bits - 1 - level) & 1:
                at = self._find(level, at - self.zeros[level], True)
            else:
                at = self._find(level, at, False)
        return at

    def _find(self, level: int, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th one (or zero) of a plane: binary search in the directory, then inside the block."""
        held = self.ranks[level].astype(np.int64)
        held = held if one else np.arange(len(held)) * BLOCK - held
        block = np.searchsorted(held, k, "right") - 1
        bits = np.unpackbits(self.planes[level].reshape(-1, BLOCK // 8)[block], axis=1, bitorder="little").astype(bool) if len(k) else np.zeros((0, BLOCK), bool)
        seen = np.cumsum(bits if one else ~bits, axis=1)
        return block * BLOCK + (seen <= (k - held[block])[:, None]).sum(axis=1)

    def all(self) -> np.ndarray:
        """Every id in turn: planes are undone from the lowest bit up."""
        v = np.zeros(self.size, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            b = np.unpackbits(self.planes[level], count=self.size, bitorder="little").astype(bool)
            up = np.empty_like(v)
            up[np.flatnonzero(~b)] = v[: self.zeros[level]]
            up[np.flatnonzero(b)] = v[self.zeros[level] :] | v.dtype.type(1 << (self.bits - 1 - level))
            v = up
        return v.astype(np.uint32)


def write_shards(docs: DataFrame, path: str, tokenizer: str, bits: int = 16, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode docs in ascending id order, end_id after each, and write wavelet shards to the folder path.

    A null text counts as empty and gives its end id alone; null ids come first; rows that repeat an id follow each other,
    however many they are: many tasks write them.
    An empty table gives no shards. Other columns are not written.
    """

    def encode(batches):
        part, seq = TaskContext.get().partitionId(), 0
        encoder = word_ids(tokenizer, memo=WORDS_HELD)
        end = np.array([end_id], np.uint32)
        ids, names, lengths, held = [], [], [], 0

        def shard():
            x = np.concatenate(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([names], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([len(x)], pa.int64()), pa.array([WaveletMatrix.build(x, bits)], pa.binary())],
                ["part", "seq", "doc_ids", "lengths", "n_tokens", "matrix"],
            )

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), encoder.texts(b.column(1))):
                if held and held + len(x) >= shard_tokens:
                    yield shard()
                    ids, names, lengths, held, seq = [], [], [], 0, seq + 1
                ids += [x, end]
                names.append(i)
                lengths.append(len(x) + 1)
                held += len(x) + 1
        if names:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    salted = rows.withColumn("salt", F.monotonically_increasing_id() % SALTS)
    ordered = salted.repartitionByRange("id", F.substring("t", 1, 64), "salt").sortWithinPartitions("id", "t").drop("salt")
    ordered.mapInArrow(encode, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, shard_start): tokens before each shard. Sums of parts meet in one small window, one row for each task."""
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = shards.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("inside"))
    return inside.join(parts, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("shard_start"))


def documents_of(shards: DataFrame, digest: bool = False, id_col: str = "doc_id") -> DataFrame:
    """One row for each document in the shards: id, start, n_tokens, and its ids, or with digest their ids_crc32."""
    last = "ids_crc32" if digest else "ids"

    def decode(batches):
        for b in batches:
            for part, seq, names, lengths, data in zip(*(b.column(n).to_pylist() for n in ("part", "seq", "doc_ids", "lengths", "matrix"))):
                ids, n = WaveletMatrix(data).all().astype("<u4"), len(names)
                ends = np.cumsum(lengths)
                each = [ids[a:z] for a, z in zip((ends - lengths).tolist(), ends.tolist())]
                made = pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()) if digest else pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(names, pa.int64()), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), made],
                    ["part", "seq", id_col, "local", "n_tokens", last],
                )

    rows = shards.mapInArrow(decode, f"part int, seq int, `{id_col}` long, local long, n_tokens long, {last} {'long' if digest else 'array<long>'}")
    starts = shard_starts(shards.select("part", "seq", "n_tokens"))
    return rows.join(starts, ["part", "seq"]).select(id_col, (F.col("local") + F.col("shard_start")).alias("start"), "n_tokens", last)


def token_counts(shards: DataFrame, token: int) -> DataFrame:
    """(part, seq, n): occurrences of one token in each shard, by rank."""

    def count(batches):
        for b in batches:
            n = [int(m.rank(token, m.size)[0]) for m in map(WaveletMatrix, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["part", "seq", "n"])

    return shards.select("part", "seq", "matrix").mapInArrow(count, "part int, seq int, n long")


def token_positions(shards: DataFrame, token: int) -> DataFrame:
    """One row for each occurrence of a token: its position among all ids, by select."""

    def find(batches):
        for b in batches:
            for part, seq, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                at = WaveletMatrix(data).select(token)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.int32()), pa.array([seq] * len(at), pa.int32()), pa.array(at, pa.int64())], ["part", "seq", "local"])

    rows = shards.select("part", "seq", "matrix").mapInArrow(find, "part int, seq int, local long")
    return rows.join(shard_starts(shards.select("part", "seq", "n_tokens")), ["part", "seq"]).select((F.col("local") + F.col("shard_start")).alias("position"))
