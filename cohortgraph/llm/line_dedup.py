"""Line deduplication by range-partitioned line hashes.

Lines travel as 128-bit hashes with their document and position. A range partitioning with sampled splitters over (hash,
document) and a secondary sort by document and position put the occurrences of a line next to each other; one pass over
each partition counts documents per line and tells which occurrences go. Because the splitters also use the document, a
line found in a third of all documents is spread over many partitions; only the first and last line of a partition can
have occurrences elsewhere, and those few summaries meet in a second, small step. What comes back is a compressed bitmap
of kept lines per document; texts move only when bitmaps are applied.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgraph.llm.shared import table
from cohortgraph.llm.text_arrays import text_bytes

_STRIP = b" \t\n\x0b\x0c\r"
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_LINE = "h1 long, h2 long, id long, k1 long, k2 long, pos int"
_FOUND = "h1 long, h2 long, id long, k1 long, k2 long, pos int, docs int, edge boolean"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t, and a 128-bit key of the row, so that null or repeated ids do no harm."""
    text, i = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    return docs.select(i.alias("id"), text.alias("t")).select("id", "t", F.xxhash64("id", "t").alias("k1"), F.xxhash64(F.lit(1), "t", "id").alias("k2"))


def _lines(min_chars: int):
    def emit(batches):
        for b in batches:
            h, row, pos = [], [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                for p, line in enumerate(text_bytes(t).translate(_FOLD).split(b"\n")):
                    key = line.strip(_STRIP)
                    if key and (min_chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
                        h.append(xxhash.xxh3_128_digest(key))
                        row.append(r)
                        pos.append(p)
            two = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
            take = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(two[:, 0]), pa.array(two[:, 1]), b.column(0).take(take), b.column(2).take(take), b.column(3).take(take), pa.array(pos, pa.int32())],
                ["h1", "h2", "id", "k1", "k2", "pos"],
            )

    return emit


def _scan(least: int, keep_first: bool):
    """Goes through one sorted partition. Rows out: occurrences to drop (edge false); and of the first and last line
    of the partition, where they are not decided here, all occurrences, with the number of documents seen (edge true)."""

    def emit(batches):
        carry, opening = None, True  # opening: the first line of what comes next is not decided here
        names = ["h1", "h2", "id", "k1", "k2", "pos"]

        def decide(x: pa.Table, last: bool):
            nonlocal opening
            if not x.num_rows:
                return None, []
            a = {n: x.column(n).to_numpy(zero_copy_only=False) for n in ("h1", "h2", "k1", "k2")}
            new_line, new_doc = np.ones(x.num_rows, bool), np.ones(x.num_rows, bool)
            new_line[1:] = (a["h1"][1:] != a["h1"][:-1]) | (a["h2"][1:] != a["h2"][:-1])
            new_doc[1:] = new_line[1:] | (a["k1"][1:] != a["k1"][:-1]) | (a["k2"][1:] != a["k2"][:-1])
            begin = np.flatnonzero(new_line)
            docs = np.add.reduceat(new_doc.astype(np.int64), begin)
            run = np.cumsum(new_line) - 1
            edge = np.zeros(len(begin), bool)
            edge[0] = opening
            if last:
                edge[-1] = True
            rest = None
            if not last:  # the last line may go on in the next batch
                rest, x, run, new_line = x.slice(begin[-1]), x.slice(0, begin[-1]), run[: begin[-1]], new_line[: begin[-1]]
                if not x.num_rows:
                    return rest, []
            opening = False
            drop = (docs >= least)[run] & ~edge[run]
            if keep_first:
                drop &= ~new_line
            out = drop | edge[run]
            found = x.append_column("docs", pa.array(docs[run].astype(np.int32))).append_column("edge", pa.array(edge[run]))
            return rest, found.filter(pa.array(out)).combine_chunks().to_batches()

        for b in batches:
            now = pa.Table.from_batches([b]).select(names)
            carry, out = decide(now if carry is None else pa.concat_tables([carry, now]).combine_chunks(), last=False)
            yield from out
            if carry is not None and carry.num_rows > _LONG:
                # A very common line: its occurrences are written out as edge rows as they come; the count is theirs.
                # What is left of the line, here and in later batches, goes to the same count, so it is edge as well.
                yield from _flush(carry)
                carry, opening = None, True
        if carry is not None:
            yield from decide(carry, last=True)[1]

    return emit


#: Occurrences of one line that a task holds before writing them out undecided.
_LONG = 200_000


def _flush(x: pa.Table) -> list[pa.RecordBatch]:
    """All of x as edge rows. It may end inside a document, whose other occurrences are edge rows too: documents are counted
    by their keys."""
    n = x.num_rows
    done = x.append_column("docs", pa.array(np.zeros(n, np.int32))).append_column("edge", pa.array(np.ones(n, bool)))
    return done.combine_chunks().to_batches()


def _bitmap(batches):
    for b in batches:
        maps, dropped = [], []
        for n, gone in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
            keep = np.ones(n, bool)
            keep[gone or []] = False
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6))
            dropped.append(n - int(keep.sum()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3).cast(pa.int64()), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], ["id", "k1", "k2", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """One row for each different row of docs: id, k1, k2, n_lines, n_dropped, keep.

    Lines are split at \\n; a null or empty text has one empty line. A line's key is the line without ASCII white space at
    both ends, A-Z lower-cased. Keys of at least min_chars code points found in at least min_docs documents lose all
    their lines, with keep_first all but the first by id and position. keep is a zlib-compressed bitmap, one bit for each
    line, lowest bit first. (k1, k2) names the row, so null or repeated ids are judged by their own texts; rows equal in id
    and text count as one document. Other columns are ignored.
    """
    rows = _keyed(docs, id_col, text_col)
    lines = rows.select("id", "t", "k1", "k2").mapInArrow(_lines(max(1, min_chars)), _LINE)
    ranged = lines.repartitionByRange("h1", "h2", "id", "k1", "k2")
    found = table(ranged.sortWithinPartitions("h1", "h2", "id", "k1", "k2", "pos").mapInArrow(_scan(min_docs, keep_first), _FOUND), "line-runs")
    edges = found.where("edge")
    totals = edges.groupBy("h1", "h2", "k1", "k2").agg(F.min(F.struct("id", "k1", "k2", "pos")).alias("first")).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    # A partition has two undecided lines and two for each _LONG occurrences in it at most, so totals stay far smaller than edges.
    late = edges.join(F.broadcast(totals.where(F.col("n") >= min_docs)), ["h1", "h2"])
    if keep_first:
        late = late.where(~F.struct("id", "k1", "k2", "pos").eqNullSafe(F.col("first")))
    gone = found.where("not edge").select("k1", "k2", "pos").union(late.select("k1", "k2", "pos")).groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))
    heads = rows.select("id", "k1", "k2", (F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit(""))) + 1).alias("n")).dropDuplicates(["k1", "k2"])
    return heads.join(gone, ["k1", "k2"], "left").select("id", "k1", "k2", "n", "gone").mapInArrow(_bitmap, "id long, k1 long, k2 long, n_lines long, n_dropped long, keep binary")


def kept_lines(text: str, keep: bytes, n: int) -> str:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n, bitorder="little")
    return "\n".join(line for line, k in zip(text.split("\n"), bits.tolist()) if k)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_lines, n_dropped, kept_text; with digest its SHA-256, kept_sha256, instead."""
    name = "kept_sha256" if digest else "kept_text"

    def emit(batches):
        for b in batches:
            out = []
            for t, keep, n, dropped in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                kept = kept_lines(t, keep, n) if dropped else t
                out.append(hashlib.sha256(text_bytes(kept)).hexdigest() if digest else kept)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.string())], [id_col, "n_lines", "n_dropped", name])

    rows = _keyed(docs, id_col, text_col).join(bitmaps.drop("id"), ["k1", "k2"])
    return rows.select("id", "n_lines", "n_dropped", "t", "keep").mapInArrow(emit, f"`{id_col}` long, n_lines long, n_dropped long, {name} string")


SQL = r"""
WITH l AS (SELECT r, doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
           FROM (SELECT r, doc_id, unnest(x) AS line, unnest(range(len(x))) AS pos
                 FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
f AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.key = f.key GROUP BY r, doc_id
"""
