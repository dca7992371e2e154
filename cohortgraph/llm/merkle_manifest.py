"""Merkle manifest of a dataset, in blocks with van Emde Boas layout.

Every row is a leaf, every language a tree over its rows by id, and the trees' roots are the leaves of one last tree. Leaves
are numbered by a range partitioning and counts of its parts. A tree is cut into aligned subtrees of a fixed height, one row
each: construction and lookups see one bounded block at a time, and the blocks' roots are the leaves of the next level, so
a corpus of 2 ** 40 rows has five levels. Inside a block, nodes lie in van Emde Boas order: the tree is cut at half its
height, the top half is stored first and then each bottom half, all in the same way. A node's address comes from its level
and number alone by three small tables, so that neither pointers nor a size of cache lines are stored.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortgraph.llm.shared import CRC_SQL, table

#: Height of a block: it has up to 2 ** HEIGHT leaves.
HEIGHT = 8
#: Parts in which rows that are equal in all that orders them may be numbered.
SALTS = 64
#: Rows of offsets up to which they are sent to all tasks.
SENT = 100_000
_WIDTH = 32


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


@lru_cache
def _cuts(levels: int) -> tuple[tuple[int, int, int], ...]:
    """For each depth but the root's: (depth of the root of the top half that ends above it, nodes of that top half, nodes of
    one bottom half that begins there)."""
    found: dict[int, tuple[int, int, int]] = {}

    def cut(root: int, n: int) -> None:
        if n > 1:
            top = n // 2
            found[root + top] = (root, (1 << top) - 1, (1 << n - top) - 1)
            cut(root, top)
            cut(root + top, n - top)

    cut(0, levels)
    return ((0, 0, 0), *(found[d] for d in range(1, levels)))


def address(height: int, depth: int, index: np.ndarray | int) -> np.ndarray | int:
    """Place of the index-th node of a depth (root: 0) in a block of that height."""
    node, cuts, place = index + (1 << depth), _cuts(height + 1), index * 0
    while depth:
        above, top, bottom = cuts[depth]
        place = place + top + (node & top) * bottom
        node, depth = node >> depth - above, above
    return place


def build_block(leaves: list[str], height: int) -> tuple[bytes, str]:
    """(nodes in van Emde Boas order, root). Two consecutive nodes become the hash of both, a last one alone that of itself;
    places of nodes that do not exist are zero."""
    nodes, level = np.zeros((2 << height) - 1, f"S{_WIDTH}"), leaves
    for depth in range(height, -1, -1):
        nodes[address(height, depth, np.arange(len(level)))] = [bytes.fromhex(x) for x in level]
        if depth:
            level = [digest("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return nodes.tobytes(), level[0]


def node_at(nodes: bytes, height: int, depth: int, index: int) -> str:
    at = _WIDTH * address(height, depth, index)
    return nodes[at : at + _WIDTH].hex()


def siblings(nodes: bytes, height: int, leaves: int) -> list[list[str]]:
    """For each leaf of a block its path to the block's root, from below: 'L' or 'R' and the sibling there, or '-'."""
    paths: list[list[str]] = [[] for _ in range(leaves)]
    n = leaves
    for up in range(height):
        place = _WIDTH * address(height, height - up, np.arange(n))
        level = [nodes[a : a + _WIDTH].hex() for a in place.tolist()]
        step = [f"L{level[i - 1]}" if i & 1 else f"R{level[i + 1]}" if i + 1 < n else "-" for i in range(n)]
        for i, path in enumerate(paths):
            path.append(step[i >> up])
        n = (n + 1) // 2
    return paths


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its path give."""
    for step in path:
        leaf = digest(step[1:] + leaf if step[0] == "L" else leaf + step[1:])
    return leaf


class Forest(NamedTuple):
    """Trees by g. levels: from the leaves up, blocks (g, block, total: nodes of the tree on this level, leaves, height, nodes, root,
    ids and notes of the leaves) of a height. roots: (g, root)."""

    levels: list[DataFrame]
    roots: DataFrame
    height: int


class Manifest(NamedTuple):
    """trees: one for each language; top: the tree over their roots; root: of that, None for an empty table."""

    trees: Forest
    top: Forest
    root: str | None


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (g and others) with total, the rows of their g, and pos, the row's number there in that order (equal rows: in any).

    Only counts of (g, part) are added up; the rows themselves are sorted in parts, which may cut a g anywhere."""
    salted = rows.withColumn("salt", F.monotonically_increasing_id() % SALTS)
    ranged = salted.repartitionByRange("g", *order, "salt").sortWithinPartitions("g", *order).drop("salt")
    held = table(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "leaves")
    parts, of_g = held.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("at").alias("first")), Window.partitionBy("g")
    shift = F.sum("n").over(of_g.orderBy("part")) - F.col("n") - F.col("first")
    parts = table(parts.select("g", "part", shift.alias("shift"), F.sum("n").over(of_g).alias("total")), "offsets")
    parts = F.broadcast(parts) if parts.count() <= SENT else parts
    return held.join(parts, ["g", "part"]).select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "total")


_BLOCK = {"g": pa.string(), "block": pa.int64(), "total": pa.int64(), "leaves": pa.int32(), "height": pa.int32(), "nodes": pa.binary(), "root": pa.string(), "ids": pa.list_(pa.int64()), "notes": pa.list_(pa.string())}
_BLOCK_SQL = "g string, block long, total long, leaves int, height int, nodes binary, root string, ids array<long>, notes array<string>"


def _build(most: int):
    def emit(batches):
        for b in batches:
            for g, block, total, found in zip(*(b.column(n).to_pylist() for n in ("g", "block", "total", "found"))):
                found.sort(key=lambda x: x["pos"])
                height = min(most, (total - 1).bit_length())
                nodes, root = build_block([x["node"] for x in found], height)
                row = [g, block, total, len(found), height, nodes, root, [x["id"] for x in found], [x["note"] for x in found]]
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, _BLOCK.values())], list(_BLOCK))

    return emit


def _ends(level: DataFrame, height: int) -> DataFrame:
    """Blocks that hold the root of their tree."""
    return level.where(F.col("total") <= 1 << height)


def forest(leaves: DataFrame, order: list[str], height: int = HEIGHT) -> Forest:
    """Trees over leaves (g, node, id, note and what order names)."""
    nodes, levels = _numbered(leaves, order), []
    while True:
        members = F.collect_list(F.struct("pos", "node", "id", "note")).alias("found")
        blocks = nodes.groupBy("g", F.shiftright("pos", height).alias("block"), "total").agg(members)
        levels.append(table(blocks.mapInArrow(_build(height), _BLOCK_SQL), "blocks"))
        more = levels[-1].where(F.col("total") > 1 << height)
        if more.isEmpty():
            break
        above = F.ceil(F.col("total") / (1 << height)).cast("long").alias("total")
        nodes = more.select("g", F.col("block").alias("pos"), above, F.col("root").alias("node"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("note"))
    return Forest(levels, reduce(DataFrame.union, (_ends(level, height).select("g", "root") for level in levels)), height)


def manifest(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", text_col: str = "text", tamper: Column | None = None,
    height: int = HEIGHT,
) -> Manifest:
    """The trees of docs. A leaf is the SHA-256 of id, source, lang, n_chars and text, each as '-' if null, else the count of
    its UTF-8 bytes, ':' and the value. Per language leaves ascend by id; null ids come first, and rows that share an id by
    leaf. Trees go in order of language, null first. Rows that are equal in all five columns are leaves of their own. Other
    columns are ignored. Where tamper holds, the note is the leaf that the row gives with one more in n_chars."""

    def leaf(chars: Column) -> Column:
        held = [F.col(id_col), F.col(source_col), F.col(lang_col), chars, F.col(text_col)]
        return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in held)), 256)

    g = F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit("-"))  # null before all others
    note = F.when(F.lit(False) if tamper is None else tamper, leaf(F.col(chars_col) + 1))
    trees = forest(docs.select(g.alias("g"), leaf(F.col(chars_col)).alias("node"), F.col(id_col).cast("long").alias("id"), note.alias("note")), ["id", "node"], height)
    top = forest(trees.roots.select(F.lit("").alias("g"), F.col("root").alias("node"), F.lit(None).cast("long").alias("id"), F.col("g").alias("note")), ["note"], height)
    root = top.roots.first()
    return Manifest(trees, top, root["root"] if root else None)


def _down(most: int):
    """The paths of a block's leaves from the path of the block; block becomes the leaf's number on its level."""

    def emit(batches):
        for b in batches:
            for g, block, n, height, nodes, notes, root, path in zip(*(b.column(c).to_pylist() for c in ("g", "block", "leaves", "height", "nodes", "notes", "subroot", "path"))):
                first = block << most
                arrays = [pa.array([g] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(notes, pa.string()), pa.array([root] * n, pa.string())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([x + path for x in siblings(nodes, height, n)], pa.list_(pa.string()))], ["g", "block", "note", "subroot", "path"])

    return emit


def _leaf_paths(blocks: DataFrame, height: int) -> DataFrame:
    used = blocks.select("g", "block", "leaves", "height", "nodes", "notes", "subroot", "path")
    return used.mapInArrow(_down(height), "g string, block long, note string, subroot string, path array<string>")


def block_paths(trees: Forest, above: DataFrame) -> DataFrame:
    """Blocks of the lowest level with subroot and path, from the block's root on. above (g, subroot, path): from a tree's root on."""
    found = None
    for level in reversed(trees.levels):
        known = _ends(level, trees.height).select("g", "block").join(above, "g").select("g", "block", "subroot", "path")
        known = known if found is None else known.union(found)
        blocks = level.join(known, ["g", "block"])
        found = _leaf_paths(blocks, trees.height).select("g", "block", "subroot", "path")
    return blocks


def _prove(root: str):
    names = ["id", "leaf", "note", "subroot", "path", "proof_sha256", "folded_root"]

    def emit(batches):
        for b in batches:
            for n, height, nodes, ids, notes, subroot, path in zip(*(b.column(c).to_pylist() for c in ("leaves", "height", "nodes", "ids", "notes", "subroot", "path"))):
                leaves = [node_at(nodes, height, height, i) for i in range(n)]
                ways = [x + path for x in siblings(nodes, height, n)]
                proof = [digest("".join(step[1:] for step in way)) for way in ways]
                folded = [fold(note or leaf, way) for leaf, note, way in zip(leaves, notes, ways)]
                text = [pa.array(x, pa.string()) for x in (leaves, notes, [subroot] * n)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *text, pa.array(ways, pa.list_(pa.string())), pa.array(proof, pa.string()), pa.array(folded, pa.string())], names)

    return emit


def proofs(m: Manifest, id_col: str = "doc_id") -> DataFrame:
    """One row for each leaf: id, leaf, note, subroot, root, path, proof_sha256 (hash of the path's siblings), folded_root (from
    the note where there is one, else the leaf, by the path), verified. An empty manifest gives no rows."""
    spark = m.trees.roots.sparkSession
    start = spark.createDataFrame([("", None, [])], "g string, subroot string, path array<string>")
    tops = _leaf_paths(block_paths(m.top, start), m.top.height).select(F.col("note").alias("g"), "path")
    blocks = block_paths(m.trees, m.trees.roots.withColumnRenamed("root", "subroot").join(tops, "g"))
    rows = blocks.select("leaves", "height", "nodes", "ids", "notes", "subroot", "path").mapInArrow(_prove(m.root), "id long, leaf string, note string, subroot string, path array<string>, proof_sha256 string, folded_root string")
    root = F.lit(m.root)
    return rows.select(F.col("id").alias(id_col), "leaf", "note", "subroot", root.alias("root"), "path", "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def tampered(id_col: str = "doc_id", every: int = 7) -> Column:
    """Rows whose id's unsigned CRC-32 is divisible by every."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0


_FIELDS = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "{chars}", "text"))

SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce('=' || lang, '-') AS g, sha256({_FIELDS.format(chars="n_chars")}) AS leaf,
    CASE WHEN {CRC_SQL.format("doc_id::VARCHAR")} % 7 = 0 AND n_chars IS NOT NULL THEN sha256({_FIELDS.format(chars="(n_chars + 1)")}) END AS changed FROM documents),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
t(g, h, i, n, node) AS (SELECT g, 0, pos, n, leaf FROM l UNION ALL
    SELECT g, h + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, h, i // 2, n),
s AS MATERIALIZED (SELECT g, node AS subroot, h AS top, row_number() OVER (ORDER BY g) - 1 AS k, count(*) OVER () AS m FROM t WHERE n = 1),
u(h, i, n, node) AS (SELECT 0, k, m, subroot FROM s UNION ALL
    SELECT h + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY h, i // 2, n),
p AS MATERIALIZED (SELECT l.r, t.h, l.pos >> t.h & 1 = 1 AS left_side, o.node FROM l JOIN t ON t.g = l.g AND t.i = l.pos >> t.h AND t.n > 1 LEFT JOIN t o ON o.g = t.g AND o.h = t.h AND o.i = xor(t.i, 1)
    UNION ALL SELECT l.r, s.top + u.h, s.k >> u.h & 1 = 1, o.node FROM l JOIN s USING (g) JOIN u ON u.i = s.k >> u.h AND u.n > 1 LEFT JOIN u o ON o.h = u.h AND o.i = xor(u.i, 1)),
f(r, h, node) AS (SELECT r, 0, coalesce(changed, leaf) FROM l UNION ALL
    SELECT f.r, f.h + 1, sha256(CASE WHEN p.left_side THEN coalesce(p.node, '') || f.node ELSE f.node || coalesce(p.node, '') END) FROM f JOIN p USING (r, h)),
e AS (SELECT r, max_by(node, h) AS folded_root FROM f GROUP BY r),
c AS (SELECT r, sha256(coalesce(string_agg(node, '' ORDER BY h), '')) AS proof_sha256 FROM p GROUP BY r)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN s USING (g) JOIN e USING (r) LEFT JOIN c USING (r), (SELECT node AS root FROM u WHERE n = 1)
"""
