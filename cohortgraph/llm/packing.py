"""Packing documents into sequences of fixed length: dominance reduction, then best fit.

Only lengths matter to a packing, and there are at most as many as a sequence has tokens. So the driver plans on the
histogram of lengths, which has a fixed size whatever the corpus: the Martello-Toth reduction fixes document sets that
dominate every alternative, best fit decreasing packs the remainder, both by whole multiplicities. The plan is a list of
runs "the next m pieces of length s go to sequences q, q+1, ... at offset o", and its size is bounded by the number of
lengths, not of documents. Spark numbers the pieces of each length, without bringing a length to one task, and
joins each to its run.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortgraph.llm.shared import table
from cohortgraph.llm.tokens import byte_bpe, forget

#: Fine slices of pieces, and pieces for each slice among which those of one length are numbered.
FINE, SLICE_PIECES = 1 << 16, 20_000
_PIECE = "id long, k long, piece int, start long, length long, ids_crc32 long"


def pieces_of(n: int, limit: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which takes the remainder."""
    start = 0
    while start < n:
        size = (n - start) % limit or limit
        yield start, size
        start += size


def token_pieces(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, k (64-bit key of the row), piece, start, length, ids_crc32, with_ids also ids."""

    def encode(batches):
        encoder = byte_bpe(tokenizer)
        for b in batches:
            names, keys, rows = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for i, k, t in zip(names, keys, b.column(2).to_pylist()):
                ids = np.append(encoder.ids(t), np.uint32(end_id)).astype("<u4")
                for p, (start, size) in enumerate(pieces_of(len(ids), limit)):
                    part = ids[start : start + size]
                    rows.append((i, k, p, start, size, zlib.crc32(part.tobytes()), part.astype(np.int64) if with_ids else None))
            c = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(x, kind) for x, kind in zip(c, kinds)]
            if with_ids:
                arrays.append(pa.array(c[6], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, ["id", "k", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])
        forget()

    text, i = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    rows = docs.select(i.alias("id"), F.xxhash64(i, text).alias("k"), text.alias("t"))
    return rows.mapInArrow(encode, _PIECE + (", ids array<long>" if with_ids else ""))


class Plan:
    """Sequences as runs. A run is m sequences of the same contents; runs hold (length, first rank, m, sequence, offset)."""

    def __init__(self, counts: dict[int, int], limit: int):
        self.limit, self.left = limit, {s: c for s, c in counts.items() if c > 0}
        self.sizes = sorted(self.left)
        self.taken: dict[int, int] = {}
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.fixed = 0

    def take(self, size: int, m: int) -> int:
        """Rank of the first of the next m pieces of a length."""
        first = self.taken.get(size, 0)
        self.taken[size] = first + m
        self.left[size] -= m
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))
        return first

    def open(self, contents: list[int], m: int) -> int:
        """m new sequences that hold pieces of these lengths; the first's number."""
        at = 0
        for s in contents:
            self.runs.append((s, self.take(s, m), m, self.sequences, at))
            at += s
        self.sequences += m
        return self.sequences - m

    def largest(self, room: int, other: dict[int, int] | None = None) -> int | None:
        """Largest length that fits and is left once other pieces are set aside."""
        i = bisect.bisect_right(self.sizes, room) - 1
        while i >= 0:
            s = self.sizes[i]
            if self.left[s] > (other or {}).get(s, 0):
                return s
            i -= 1
        return None

    def reduce(self) -> None:
        """Martello-Toth: for the largest piece j, alone if nothing fits beside it; with the largest k that fits if the two
        fill the sequence, or no two pieces fit beside j, or no two that fit are together longer than k and no three fit.
        Either set dominates every other set that contains j, so some best packing has it. From the largest length down;
        passes repeat while they fix anything."""
        again = True
        while again:
            again = False
            for j in reversed(list(self.sizes)):
                while self.left.get(j):
                    room = self.limit - j
                    k = self.largest(room, {j: 1})
                    if k is None:
                        m = self.left[j] if 2 * j > self.limit else 1
                        self.open([j], m)
                    elif k == room or self._dominates(j, k, room):
                        m = self.left[j] // 2 if j == k else min(self.left[j], self.left[k])
                        self.open([j, k], m)
                    else:
                        break
                    self.fixed += m
                    again = True

    def _dominates(self, j: int, k: int, room: int) -> bool:
        """No set of two or three pieces beside j can be better than k alone."""
        small: list[int] = []  # the three smallest pieces but one j
        for s in self.sizes:
            small += [s] * min(3, self.left[s] - (s == j))
            if len(small) >= 3:
                break
        if len(small) < 2 or small[0] + small[1] > room:
            return True
        if len(small) >= 3 and sum(small[:3]) <= room:
            return False
        best = 0
        for a in self.sizes:  # the longest pair that fits
            if 2 * a > room:
                break
            if self.left[a] - (a == j) < 1:
                continue
            b = self.largest(room - a, {j: 1, a: 1 + (a == j)} if a != j else {j: 2})
            if b is not None:
                best = max(best, a + b)
        return best <= k

    def best_fit(self) -> None:
        """Best fit decreasing on multiplicities: runs of open sequences are kept by the room that is left in them."""
        rooms: list[int] = []
        held: dict[int, list[tuple[int, int, int]]] = {}  # room: (sequence, m, used)

        def put(room: int, run: tuple[int, int, int]) -> None:
            if room and room >= self.sizes_least:
                if room not in held:
                    bisect.insort(rooms, room)
                    held[room] = []
                held[room].append(run)

        self.sizes_least = self.sizes[0] if self.sizes else 0
        while self.sizes:
            s = self.sizes[-1]
            i = bisect.bisect_left(rooms, s)
            if i == len(rooms):
                per = self.limit // s
                m = self.left[s] // per
                if m:
                    q = self.open([s] * per, m)
                    put(self.limit - s * per, (q, m, s * per))
                if rest := self.left.get(s, 0):
                    q = self.open([s] * rest, 1)
                    put(self.limit - s * rest, (q, 1, s * rest))
                continue
            room = rooms[i]
            q, m, used = held[room].pop()
            if not held[room]:
                del held[room]
                rooms.pop(i)
            per = min(room // s, max(1, self.left[s] // m))
            n = min(m, self.left[s] // per)
            for c in range(per):
                self.runs.append((s, self.take(s, n), n, q, used + c * s))
            if n < m:
                put(room, (q + n, m - n, used))
            put(room - per * s, (q, n, used + per * s))


def plan_of(counts: dict[int, int], limit: int) -> Plan:
    plan = Plan(counts, limit)
    plan.reduce()
    plan.best_fit()
    return plan


def pack(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset; with_ids also the piece's ids.

    A document is its ids and end_id; only documents longer than limit are cut. A null text counts as empty and gives one
    piece of one token. Null and repeated ids are packed like any other row. An empty table gives no rows. Sequences are
    numbered from 0, and each is filled without gaps.
    """
    spark = docs.sparkSession
    # Pieces are dealt to slices one by one, so neither a huge document's nor those of rows that repeat share one.
    fine = F.pmod(F.xxhash64("k", "piece", F.monotonically_increasing_id()), F.lit(FINE)).cast("int")
    pieces = table(token_pieces(docs, tokenizer, limit, end_id, id_col, text_col, with_ids).withColumn("fine", fine), "pieces")
    slices = min(FINE, max(256, -(-pieces.count() // SLICE_PIECES)))
    pieces = pieces.withColumn("slice", F.col("fine") % slices)
    counted = table(pieces.select("length", "slice").groupBy("length", "slice").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # limit rows at most
    plan = plan_of(counts, limit)
    runs = spark.createDataFrame(plan.runs, "s long, first long, m long, sequence long, at long")  # bounded by the number of lengths
    before = counted.select("length", "slice", (F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("before"))
    numbered = (
        pieces.withColumn("nth", F.row_number().over(Window.partitionBy("length", "slice").orderBy("id", "k", "piece")) - 1)
        .join(before, ["length", "slice"])
        .withColumn("rank", F.col("nth") + F.col("before"))
    )
    fits = (F.col("length") == F.col("s")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("m"))
    out = numbered.join(F.broadcast(runs), fits)
    return out.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), F.col("at").alias("offset"), *(["ids"] if with_ids else []),
    )
