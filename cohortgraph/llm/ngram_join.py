"""N-gram Jaccard self-join of documents with a token-group matrix.

A document is its set of hashed word shingles. Documents with equal sets are one *class*, held by one of its rows.

1. Order. All tokens have one order, the rarest first. How rare a token is comes from two fixed-size count sketches over the
   whole corpus: of words, which tell how often their run is to be expected, and of shingles, which show repeated passages. The
   order decides cost, never the result. Linked sets share one of the first n - ceil(t n) + 1 tokens of each, and if one is no
   larger than the other, one of its first n - ceil(2 t n / (1 + t)) + 1: its *head*.
2. Grouping. Classes that share a min-hash band are compared with one class of that band's bucket, and confirmed links make
   *groups* of similar classes (connected components). Grouping, too, decides only cost.
3. Matrix. Its rows are those first tokens, its columns the groups: an entry says that a member of the group has the token, and
   bounds the sizes of those members and the token's place in their order. A group of any number of near copies has one entry a
   token. Two groups meet where one has a token in a head, and sizes and places leave room for a link.
4. Bound. A group's token union is an OR of bitmaps over hashed tokens. The classes of the smaller group are queries: tokens of
   a query that are not in the union of the other group are missing from all its members; too many rule the group out.
5. Open. Members of qualifying groups pass the two-sided bound one by one, then whole sets are compared exactly, the likest
   first, until one links.

Links inside a group need no pair-by-pair check because its members are connected already; every other link is found.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortgraph.llm.shared import Scratch, among, components, in_filter, key_filter, table
from cohortgraph.llm.text_arrays import Words, mix, slices

#: Counters of the two frequency sketches, whatever the corpus, and the parts in which they are merged. A byte of each is sent to every task.
WORD_BITS, SHINGLE_BITS, PARTS = 18, 22, 64
#: Tasks whose sketches are merged first.
MERGED = 256
#: Steps of the order for each doubling of a count.
STEPS = 4
#: Bits of a token union for each token, and the least and most longs of one.
COLUMN_BITS, LEAST_COLUMN, MOST_COLUMN = 3, 8, 2048
#: Members of a group, and queries to one group, that are sent together, about; and the parts into which its queries are dealt.
PACK, ASKS, ASK_DEALT = 256, 64, 8
#: Parts into which the pairs of one class or group are dealt.
DEALT = 64
#: Min-hash bands and their width, for grouping.
BANDS, BAND_ROWS = 8, 3

_DOC = "r long, id long, n int, h1 long, h2 long, bands array<long>, bits array<long>, prefix array<long>"
_SEEDS = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def prefix_length(n, percent: int):
    """Tokens of a set of n of which a linked set has at least one."""
    return n + 1 - (percent * n + 99) // 100


def head_length(n, percent: int):
    """Tokens of a set of n of which a linked set that is no smaller has at least one in its own prefix."""
    return n + 1 - (2 * percent * n + 99 + percent) // (100 + percent)


class Ranks(NamedTuple):
    """How common words and shingles are, in steps of the order, by sketch cell; base: the steps of a run of unlikely words."""

    words: np.ndarray
    shingles: np.ndarray
    base: int

    def of(self, w: Words, s: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """The rank of each run s of width words that begins at word at: its expected or its counted number, the larger."""
        steps = np.concatenate(([0], np.cumsum(self.words[_cell(w.hashes, WORD_BITS)], dtype=np.int64)))
        expected = steps[np.minimum(at + width, len(steps) - 1)] - steps[at] - self.base
        return np.maximum(expected, self.shingles[_cell(s, SHINGLE_BITS)])


def _cell(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> np.uint64(64 - bits)).astype(np.int64)


def _steps(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(STEPS * np.log2(np.maximum(counts, 1))), 255).astype(np.uint8)


def _text_of(docs: DataFrame, text_col: str) -> Column:
    return F.col(text_col).cast("string").alias("t")


def corpus_ranks(docs: DataFrame, text_col: str, words: int) -> Ranks:
    """Sketches of all words and shingles of the corpus, as ranks. A shingle's count is what its cell holds over the mean and
    three deviations; a word's is all that its cell holds."""

    def packed(counts: np.ndarray) -> bytes:
        return zlib.compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)

    def count(batches):
        held = np.zeros(1 << WORD_BITS, np.uint32), np.zeros(1 << SHINGLE_BITS, np.uint32)
        for b in batches:
            for _, _, data, offsets in slices(b.column(0)):
                w = Words(data, offsets, fold=True)
                np.add.at(held[0], _cell(w.hashes, WORD_BITS), np.uint32(1))
                np.add.at(held[1], _cell(w.windows(words, short=True)[0], SHINGLE_BITS), np.uint32(1))
        if held[0].any():
            for p in range(PARTS):
                parts = (x.reshape(PARTS, -1)[p] for x in held)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([packed(x)], pa.binary()) for x in parts)], ["part", "w", "s"])

    def total(batches) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for p, *sent in zip(*(b.column(k).to_pylist() for k in ("part", "w", "s"))):
                got = [np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T).view("<u4").ravel() for x in sent]
                for x, y in zip(sums.setdefault(p, tuple(np.zeros(len(y), np.int64) for y in got)), got):
                    x += y
        return sums

    def merge(batches):
        for p, (w, s) in total(batches).items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([packed(np.minimum(x, (1 << 32) - 1))], pa.binary()) for x in (w, s))], ["part", "w", "s"])

    def rank(batches):
        for p, (w, s) in total(batches).items():
            over = s - s.mean() - 3 * math.sqrt(s.mean())
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([int(w.sum())]), pa.array([_steps(w).tobytes()]), pa.array([_steps(over + 1).tobytes()])], ["part", "n", "w", "s"])

    counted = docs.select(_text_of(docs, text_col)).mapInArrow(count, "part int, w binary, s binary")
    some = counted.withColumn("some", F.floor(F.spark_partition_id() / MERGED)).repartition("some", "part").select("part", "w", "s")
    ranked = some.mapInArrow(merge, "part int, w binary, s binary").repartition("part").mapInArrow(rank, "part int, n long, w binary, s binary")
    n, w, s = 1, np.zeros((PARTS, (1 << WORD_BITS) // PARTS), np.uint8), np.zeros((PARTS, (1 << SHINGLE_BITS) // PARTS), np.uint8)
    for r in ranked.collect():  # PARTS rows of fixed size
        n, w[r["part"]], s[r["part"]] = n + r["n"], np.frombuffer(r["w"], np.uint8), np.frombuffer(r["s"], np.uint8)
    return Ranks(w.ravel(), s.ravel(), round(STEPS * (words - 1) * math.log2(n)))


def _least_hashes(s: np.ndarray) -> np.ndarray:
    """The least of each seed's hashes of s, in blocks, so that memory does not follow the text."""
    out = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(s), 4096):
        np.minimum(out, (s[lo : lo + 4096] * _SEEDS[:, None]).min(axis=1), out=out)
    return out


def _sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for lo, hi, data, offsets in slices(column):
        s, first, _ = Words(data, offsets, fold=True).windows(words, short=True)
        for i in range(hi - lo):
            yield np.unique(s[first[i] : first[i + 1]])


def _ordered_sets(column: pa.Array, words: int, ranks: Ranks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingle hashes of each text, and the same in the common order."""
    for lo, hi, data, offsets in slices(column):
        w = Words(data, offsets, fold=True)
        s, first, at = w.windows(words, short=True)
        rank = ranks.of(w, s, at, words)
        for i in range(hi - lo):
            x, where = np.unique(s[first[i] : first[i + 1]], return_index=True)
            yield x, x[np.lexsort((mix(x), rank[first[i] : first[i + 1]][where]))]


def sketches(docs: DataFrame, ranks: Ranks, text_col: str, words: int, percent: int) -> DataFrame:
    """One small row for each row (r, id, text): set size, set hashes, min-hash bands, token bitmap, prefix in the common order."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def describe(batches):
        for b in batches:
            n, h1, h2, bands, bits, prefix = [], [], [], [], [], []
            for s, ordered in _ordered_sets(b.column(2), words, sent.value):
                n.append(len(s))
                if not len(s):
                    h1.append(0), h2.append(0), bands.append([]), bits.append([]), prefix.append([])
                    continue
                h1.append(int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().view(np.int64)))
                h2.append(int(mix(s + np.uint64(0x51ED270B9F0A3C11)).sum().view(np.int64)))
                key = mix((_least_hashes(s).reshape(BANDS, BAND_ROWS) * _SEEDS[:BAND_ROWS]).sum(axis=1) + np.arange(BANDS, dtype=np.uint64))
                bands.append(key.view(np.int64))
                longs = min(MOST_COLUMN, max(LEAST_COLUMN, 1 << (COLUMN_BITS * len(s) // 64).bit_length()))
                column = np.zeros(64 * longs, bool)
                column[(s % np.uint64(64 * longs)).astype(np.int64)] = True
                bits.append(np.packbits(column, bitorder="little").view(np.int64))
                prefix.append(ordered[: prefix_length(len(s), percent)].view(np.int64))
            long = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, long), pa.array(bits, long), pa.array(prefix, long)],
                ["r", "id", "n", "h1", "h2", "bands", "bits", "prefix"],
            )

    return docs.select("r", "id", _text_of(docs, text_col)).mapInArrow(describe, _DOC)


def _missing(a: np.ndarray, b: np.ndarray) -> int:
    """So many tokens of column a, at least, are in no set under column b. The wider column is folded onto the other."""
    if len(a) != len(b):
        w = min(len(a), len(b))
        a, b = (np.bitwise_or.reduce(x.reshape(-1, w), axis=0) for x in (a, b))
    return int(np.bitwise_count((a & ~b).view(np.uint64)).sum())  # of signed numbers numpy counts the bits of the absolute value


def _largest_partner(n: int, missing: int, percent: int) -> int:
    """Largest size of a set that can link to one of n tokens of which so many are missing from it."""
    return (n - missing) * (100 + percent) // percent - n


def _bounded(pairs: DataFrame, percent: int, group: bool) -> DataFrame:
    """(a, b, cap): pairs (a, b, na, ba, nb, bb), with group also least and most instead of nb, that the columns cannot rule
    out. cap is the size that a partner of a may have at most."""

    def check(batches):
        for x in batches:
            a_bits, b_bits = x.column("ba"), x.column("bb")
            na, keep, caps = x.column("na").to_pylist(), [], []
            lo = x.column("least" if group else "nb").to_pylist()
            hi = x.column("most").to_pylist() if group else lo
            for i in range(x.num_rows):
                n, least, most = na[i], lo[i], hi[i]
                if 100 * most < percent * n or 100 * n < percent * least:
                    keep.append(False)
                    continue
                a, b = a_bits[i].values.to_numpy(), b_bits[i].values.to_numpy()
                missing = _missing(a, b)
                cap = _largest_partner(n, missing, percent)
                ok = cap >= max(least, -(-percent * n // 100))
                if ok and not group:
                    ok = (missing + _missing(b, a)) * (100 + percent) <= (100 - percent) * (n + least)
                keep.append(ok)
                if ok:
                    caps.append(cap)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column("a").filter(mask), x.column("b").filter(mask), pa.array(caps, pa.int64())], ["a", "b", "cap"])

    return pairs.mapInArrow(check, "a long, b long, cap long")


def _token_sets(texts: DataFrame, words: int) -> DataFrame:
    """(r, tokens): sorted shingle hashes of rows (r, t)."""

    def emit(batches):
        for b in batches:
            tokens = [x.view(np.int64) for x in _sets(b.column(1), words)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.list_(pa.int64()))], ["r", "tokens"])

    return texts.select("r", "t").mapInArrow(emit, "r long, tokens array<long>")


def _near_first(a: np.ndarray, bits: pa.ListArray, sizes: np.ndarray, n: int, which: np.ndarray, percent: int) -> np.ndarray:
    """Of the columns which, those of sets that can link to a set of n tokens with column a; the likest first."""
    values, begin, width = bits.values.to_numpy(), bits.offsets.to_numpy()[:-1], np.diff(bits.offsets.to_numpy())
    apart = np.zeros(len(sizes), np.int64)
    for w in np.unique(width[which]).tolist():
        at = which[width[which] == w]
        b, v = values[begin[at][:, None] + np.arange(w)], min(w, len(a))
        x, b = np.bitwise_or.reduce(a.reshape(-1, v), axis=0), np.bitwise_or.reduce(b.reshape(len(at), -1, v), axis=1)
        apart[at] = np.bitwise_count((x ^ b).view(np.uint64)).sum(axis=1)
    which = which[apart[which] * (100 + percent) <= (100 - percent) * (n + sizes[which])]
    return which[np.argsort(apart[which], kind="stable")]


def _opened(asked: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each query in asks and the members in held, both lists of (id, n, bits, tokens), the first member found to link
    to the query; the likest by their columns are compared first, all that the columns cannot rule out if need be."""

    def check(batches):
        for x in batches:
            left, right = [], []
            for i in range(x.num_rows):
                ask, held = x.column("asks")[i].values, x.column("held")[i].values
                m, names, bits, tokens = held.field("n").to_numpy(), held.field("id").to_numpy(), held.field("bits"), held.field("tokens")
                for k, (q, n, cap) in enumerate(zip(*(ask.field(c).to_pylist() for c in ("id", "n", "cap")))):
                    which = np.flatnonzero((m <= cap) & (100 * np.minimum(m, n) >= percent * np.maximum(m, n)))
                    own = ask.field("tokens")[k].values.to_numpy()
                    for j in _near_first(ask.field("bits")[k].values.to_numpy(), bits, m, n, which, percent).tolist():
                        both = len(np.intersect1d(own, tokens[j].values.to_numpy(), assume_unique=True))
                        if both and 100 * both >= percent * (n + int(m[j]) - both):
                            left.append(min(q, int(names[j])))
                            right.append(max(q, int(names[j])))
                            break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return asked.select("asks", "held").mapInArrow(check, "a long, b long")


def _with_both(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the other columns of left at a and of right at b. One a may be in very many pairs, so its pairs
    are dealt to several keys, and left goes to each that is used."""
    dealt = pairs.withColumn("deal", F.pmod(F.xxhash64("b"), F.lit(DEALT)))
    lefts = dealt.select("a", "deal").distinct().join(left, "a")
    return dealt.join(right, "b").join(lefts, ["a", "deal"]).drop("deal")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("r")).distinct()


def _linked(pairs: DataFrame, sk: DataFrame, docs: DataFrame, words: int, percent: int, tmp: Scratch) -> DataFrame:
    """(a, b) of those of pairs (a, b) that link: the bound first, then whole texts, exactly. docs: (r, t)."""
    pairs = tmp.table(pairs, "candidates")
    side = among(sk.select("r", "n", "bits"), "r", _ends(pairs))
    near = _bounded(_with_both(pairs, side.toDF("a", "na", "ba"), side.toDF("b", "nb", "bb")), percent, group=False)
    kept = tmp.table(near.select("a", "b").distinct(), "pairs")
    texts = among(docs, "r", _ends(kept)).dropDuplicates(["r"])
    both = _with_both(kept, texts.toDF("a", "ta"), texts.toDF("b", "tb")).select("a", "b", "ta", "tb")

    def compare(batches):
        held: dict[int, np.ndarray] = {}  # the last few left sides: a bucket's first class is on the left of many pairs
        for batch in batches:
            left, right, keep = batch.column(0).to_pylist(), batch.column(1), []
            for i, (a, y) in enumerate(zip(left, _sets(batch.column(3), words))):
                if a not in held:
                    if len(held) > 64:
                        held.clear()
                    held[a] = next(_sets(batch.column(2).slice(i, 1), words))
                x = held[a]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(shared) and 100 * shared >= percent * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), right.filter(mask)], ["a", "b"])

    return tmp.table(both.mapInArrow(compare, "a long, b long"), "links")


def _stars(heads: DataFrame) -> DataFrame:
    """(a, b): each class with the first class, by smallest id, of every min-hash bucket that it is in, where sizes allow a link."""
    keyed = heads.select("r", "n", "id", F.explode("bands").alias("band"), F.pmod("r", F.lit(DEALT)).alias("deal"))
    slots = keyed.groupBy("band", "deal").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "r", "n")).alias("least"), F.count("*").alias("c"))
    first = slots.groupBy("band").agg(F.min("least").alias("least"), F.sum("c").alias("c")).where("c > 1").select("band", F.col("least.r").alias("a"), F.col("least.n").alias("na"))
    # The first class goes to each part of its bucket, so that no bucket meets in one task.
    return keyed.join(slots.select("band", "deal").join(first, "band"), ["band", "deal"]).where("r <> a").select("a", F.col("r").alias("b"), "n", "na").distinct()


def _meetings(entries: DataFrame, percent: int, tmp: Scratch) -> DataFrame:
    """(a, b): pairs of groups, a < b, that share a token and may hold linked sets. entries: (token, g, lo, hi, at); lo and hi are
    the least and most sizes of the members that have the token, at its least place in their order.

    Of linked sets x and y, x no larger, the first token that they share is in x's head, and from it on each holds all
    that they share. That leaves bounds on sizes and places."""
    by = Window.partitionBy("token")
    head = F.expr(f"at < hi + 1 - (2 * {percent} * bigint(hi) + {99 + percent}) div {100 + percent}")
    shared = entries.withColumn("head", head).withColumns({"c": F.count("*").over(by), "some": F.bool_or("head").over(by)}).where("c > 1 and some").drop("c", "some")
    shared = tmp.table(shared, "matrix")
    x, y = shared.where("head").toDF("token", "gx", "lx", "hx", "ix", "head"), shared.toDF("token", "gy", "ly", "hy", "iy", "any")
    room = F.expr(
        f"gx <> gy AND lx <= hy AND 100L * hx >= {percent} * ly AND {100 + percent} * least(hx - ix, hy - iy)"
        f" >= {percent} * (greatest(ly, lx) + greatest(lx, {percent} * ly div 100))"
    )
    return x.join(y, (x["token"] == y["token"]) & room).select(F.least("gx", "gy").alias("a"), F.greatest("gx", "gy").alias("b")).distinct()


def _unions(members: DataFrame) -> DataFrame:
    """(g, bb): the token union of each group of members (g, bits), folded to its narrowest member. Cells are combined before
    they travel and dealt by group and place."""
    cells = members.select("g", F.size("bits").alias("w"), F.posexplode("bits").alias("at", "cell")).groupBy("g", "w", "at").agg(F.bit_or("cell").alias("cell"))
    narrow = cells.groupBy("g").agg(F.min("w").alias("least"))
    folded = cells.join(narrow, "g").groupBy("g", (F.col("at") % F.col("least")).alias("at")).agg(F.bit_or("cell").alias("cell"))
    return folded.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cell"))), lambda x: x["cell"]).alias("bb"))


def _classified(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """One row for each row of docs: r (a hash of id and text), id, n, class_id, n_links, root, component_id."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).select(F.xxhash64("id", "t").alias("r"), "id", "t")
    texts = rows.select("r", "t")
    sk = table(sketches(rows, corpus_ranks(rows, "t", words), "t", words, percent), "sketches")
    same = ["h1", "h2", "n"]
    with Scratch(spark) as tmp:
        # Classes: a hot class is put together in parts.
        slots = sk.where("n > 0").groupBy(*same, F.pmod("r", F.lit(DEALT)).alias("deal")).agg(F.min("id").alias("class_id"), F.min(F.struct(F.col("id").isNull(), "id", "r")).alias("head"))
        slots = tmp.table(slots, "class-parts")
        names = tmp.table(slots.groupBy(*same).agg(F.min("class_id").alias("class_id"), F.min("head").alias("head")).select(*same, "class_id", F.col("head.r").alias("r")), "classes")
        heads = names.select("r")

        # 1. Groups: confirmed links to the first class of each min-hash bucket.
        stars = _stars(sk.select("r", "n", "id", "bands").join(heads, "r", "left_semi")).where(f"100L * least(n, na) >= {percent} * greatest(n, na)").select("a", "b")
        stars = _linked(stars, sk, texts, words, percent, tmp)
        grouped = names.select("r", "n").join(components(stars).withColumnsRenamed({"id": "r", "component": "g"}), "r", "left").select("r", "n", F.coalesce("g", "r").alias("g"))
        sizes = grouped.groupBy("g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("members"))
        many = tmp.table(sizes.where("members > 1"), "groups")  # all others are lone: g is r
        grouped = tmp.table(grouped.join(many.select("g", "members"), "g", "left").select("r", "n", "g", F.coalesce("members", F.lit(1)).alias("members")), "grouped")

        # 2. Matrix: an entry for each group and token.
        firsts = sk.select("r", "prefix").join(grouped, "r").select("g", "members", "n", F.posexplode("prefix").alias("at", "token"))
        lone = firsts.where("members = 1").select("token", "g", F.col("n").alias("lo"), F.col("n").alias("hi"), "at")
        wide = firsts.where("members > 1").groupBy("token", "g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("at").alias("at"))
        met = tmp.table(_meetings(lone.union(wide), percent, tmp), "meetings")
        of = lambda c: many.select(F.col("g").alias(c), F.col("members").alias(f"m{c}"))
        met = met.join(of("a"), "a", "left").join(of("b"), "b", "left").fillna(1, ["ma", "mb"])
        alone = _linked(met.where("ma = 1 and mb = 1").select("a", "b"), sk, texts, words, percent, tmp)

        # 3. Bound: the smaller group's classes ask the larger group.
        swap = (F.col("ma") < F.col("mb")) | (F.col("ma") == F.col("mb")) & (F.col("a") < F.col("b"))
        asks = met.where("ma > 1 or mb > 1").select(F.when(swap, F.col("a")).otherwise(F.col("b")).alias("g"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("other"))
        asked = tmp.table(asks.join(grouped, "g").select("g", "r", "n", "other"), "asks")
        opened = many.join(asked.select(F.col("other").alias("g")).distinct(), "g", "left_semi")
        members = grouped.join(opened.select("g"), "g", "left_semi")
        members = tmp.table(among(sk.select("r", "bits"), "r", members.select("r")).dropDuplicates(["r"]).join(members, "r"), "members")
        columns = tmp.table(_unions(members).join(opened, "g").select(F.col("g").alias("a"), "least", "most", "bb"), "unions")
        queries = among(sk.select("r", F.col("n").alias("na"), F.col("bits").alias("ba")), "r", asked.select("r").distinct()).dropDuplicates(["r"])
        sized = _with_both(asked.select(F.col("other").alias("a"), F.col("r").alias("b")), columns, queries.withColumnRenamed("r", "b"))
        fit = _bounded(sized.select(F.col("b").alias("a"), F.col("a").alias("b"), "na", "ba", "least", "most", "bb"), percent, group=True)
        fit = tmp.table(fit.toDF("r", "other", "cap").join(grouped.select("r", "g"), "r"), "open")

        # 4. Open: packs of queries meet packs of members, and a query stops at the first link in a pack.
        members = members.join(fit.select(F.col("other").alias("g")).distinct(), "g", "left_semi")
        sets = tmp.table(_token_sets(among(texts, "r", fit.select("r").union(members.select("r"))).dropDuplicates(["r"]), words), "sets")
        pack = F.pmod(F.xxhash64("r"), F.ceil(F.col("members") / PACK))
        held = members.join(sets, "r").groupBy(F.col("g").alias("other"), pack.alias("pack")).agg(F.collect_list(F.struct(F.col("r").alias("id"), "n", "bits", "tokens")).alias("held"))
        dealt = fit.join(many.select(F.col("g").alias("other"), "members"), "other").withColumn("deal", F.pmod(F.xxhash64("r", F.lit(1)), F.lit(ASK_DEALT)))
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("r", F.lit(2)), F.ceil(F.count("*").over(Window.partitionBy("other", "deal")) / ASKS)))
        asks = dealt.join(queries, "r").join(sets, "r").groupBy("other", "members", "deal", "part").agg(F.collect_list(F.struct(F.col("r").alias("id"), F.col("na").alias("n"), "cap", F.col("ba").alias("bits"), "tokens")).alias("asks"))
        asks = asks.withColumn("pack", F.explode(F.sequence(F.lit(0), F.ceil(F.col("members") / PACK) - 1)))
        met = tmp.table(_opened(asks.join(held, ["other", "pack"]), percent).distinct(), "links")

        # Components of the groups, then of classes and rows.
        joined = components(_by_group(alone.union(met), grouped)).withColumnsRenamed({"id": "g", "component": "root"})
        degree = stars.union(alone).union(met).distinct().select(F.explode(F.array("a", "b")).alias("r")).groupBy("r").agg(F.count("*").alias("n_links"))
        facts = names.join(grouped.select("r", "g"), "r").join(joined, "g", "left").join(degree, "r", "left").withColumn("root", F.coalesce("root", "g"))
        least = facts.groupBy("root").agg(F.min("class_id").alias("component_id"))
        facts = facts.join(least, "root").select(*same, "class_id", "root", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
        facts = table(slots.select(*same, "deal").join(facts, same), "facts")
    facts = facts.withColumnsRenamed({c: f"k_{c}" for c in same} | {"deal": "k_deal"})
    equal = [F.col(c) == F.col(f"k_{c}") for c in same] + [F.pmod("r", F.lit(DEALT)) == F.col("k_deal")]
    out = sk.select("r", "id", "n", "h1", "h2").join(facts, equal, "left")
    return out.select(
        "r", "id", F.col("n").cast("long").alias("n"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("root", "r").alias("root"), F.coalesce("component_id", "id").alias("component_id"),
    )


def _by_group(links: DataFrame, grouped: DataFrame) -> DataFrame:
    """links between classes as links (a, b) between their groups."""
    of = grouped.select("r", "g")
    return links.join(of.toDF("a", "ga"), "a").join(of.toDF("b", "gb"), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: id, n_shingles, class_id, n_links, component_id.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; the set is the distinct shingles of `words` words, or the whole
    sequence where there are fewer. Two documents link when 100 * intersection >= percent * union. class_id is the
    smallest id with an equal set; n_links counts the links of its class to other classes that were confirmed (a link
    that joins no further classes need not be: of members of one group, or past the first from a class into a pack of members); component_id is the smallest id
    reachable by links. A document without words (null or blank text) has an empty set, links with nothing, and its own
    id in both. Rows with a null or repeated id take part with their own texts; a class or component without any id has
    null. Rows go by a 64-bit hash of id and text, shingles by 64-bit hashes. Other columns are ignored; an empty table gives
    no rows.
    """
    found = _classified(docs, id_col, text_col, words, percent)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "n_links", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component; all columns stay.

    The row with the smallest id stays, null last; of rows equal in id and text one stays. Rows without words are components of
    their own. Only rows that may go, by a filter of fixed size, are shuffled."""
    found = table(_classified(docs, id_col, text_col, words, percent).select("r", "id", "root"), "found")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "r")).alias("best"), F.count("*").alias("c")).where("c > 1").select("root", F.col("best.r").alias("best"))
    # The row that stays goes to each part of its component, so that no component meets in one task.
    parts = found.select("root", F.pmod("r", F.lit(DEALT)).alias("deal")).distinct().join(best, "root")
    doubtful = table(found.withColumn("deal", F.pmod("r", F.lit(DEALT))).join(parts, ["root", "deal"]).select("r", (F.col("r") == F.col("best")).alias("stays")).distinct(), "doubtful")
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    maybe = in_filter(docs.select(F.struct("*").alias("row"), key.alias("r")), "r", key_filter(doubtful, "r"))
    asked = maybe.where("__in").join(doubtful, "r", "left")
    stay = asked.where("stays").dropDuplicates(["r"]).union(asked.where("stays is null"))
    return maybe.where("not __in").select("row.*").union(stay.select("row.*"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                            '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                          ELSE list_distinct([array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.token = b.token AND a.doc_id <> b.doc_id
          WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(reach.b) AS component_id FROM s JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
