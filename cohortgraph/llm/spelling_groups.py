"""Spelling variants by composing a minimised acceptor of the vocabulary with a one-edit transducer and the acceptor again.

The vocabulary is range-partitioned in code-point order, so each task has the words under a few neighbouring initial
states. It builds their minimal acceptor and enumerates what the composition accepts: from a pair of equal states an
edit leads to a pair of different ones, whose common right language completes both words. As states are minimal, such a
pair is worked out once for all prefixes that lead to it. Only words whose shared prefix reaches beyond their range can
have near words elsewhere; a range's two neighbours tell how long such prefixes are, and there the edit is taken as an
arc to a key (place, rest of the word) on which ranges meet by a join. Very long words meet by hashes of all their one-letter
deletions and are compared in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortgraph.llm.shared import CRC_SQL, LOWER, UPPER, ascii_lower, table

#: Words that a range has, about.
RANGE_WORDS = 20_000
#: Code points up to which words go through acceptors.
LONG = 64
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
_NEAR = "word string, n long, n_near long, best_n long, best string"


class Acceptor:
    """The minimal acceptor of sorted, different words. arcs: for each state its letters and where they lead."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.least: list[int] = []  # lengths of the shortest and the longest word from a state
        self.most: list[int] = []
        held: dict[tuple, int] = {}
        path: list[tuple[str, dict[str, int], bool]] = [("", {}, False)]  # states of the last word that may still grow, by their letter

        def close(down_to: int) -> None:
            while len(path) > down_to:
                letter, arcs, final = path.pop()
                key = (final, *arcs.items())
                state = held.get(key)
                if state is None:
                    state = held[key] = len(self.arcs)
                    self.arcs.append(arcs)
                    self.final.append(final)
                    self.least.append(0 if final else 1 + min((self.least[t] for t in arcs.values()), default=0))
                    self.most.append(max((1 + self.most[t] for t in arcs.values()), default=0))
                if path:
                    path[-1][1][letter] = state
                else:
                    self.start = state

        before = ""
        for word in words:
            same = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                same += 1
            close(same + 1)
            path += [(c, {}, False) for c in word[same:]]
            path[-1] = (*path[-1][:2], True)
            before = word
        close(0)


def near_pairs(acceptor: Acceptor):
    """Each unordered pair of accepted words that differ by exactly one inserted, deleted or replaced letter, once."""
    arcs, final, least, most = acceptor.arcs, acceptor.final, acceptor.least, acceptor.most
    both: dict[tuple[int, int], list[str]] = {}
    edits: dict[int, list[tuple[str, str]]] = {}

    def common(a: int, b: int) -> list[str]:
        """What completes a word from both states."""
        if most[a] < least[b] or most[b] < least[a]:
            return []
        key = (a, b) if a < b else (b, a)
        found = both.get(key)
        if found is None:
            found = [""] if final[a] and final[b] else []
            other = arcs[b]
            for c, t in arcs[a].items():
                if c in other:
                    found += [c + s for s in common(t, other[c])]
            both[key] = found
        return found

    def edited(q: int) -> list[tuple[str, str]]:
        """Pairs of right words of q that differ by an edit at their first letter; of equal letters in a row the last is deleted."""
        found = edits.get(q)
        if found is None:
            found, own = [], list(arcs[q].items())
            for i, (a, t) in enumerate(own):
                found += [(a + s, b + s) for b, u in own[i + 1 :] for s in common(t, u)]
                if not (most[t] < least[q] or most[q] < least[t]):
                    if final[t] and final[q]:
                        found.append((a, ""))
                    for c, u in arcs[t].items():
                        if c != a and c in arcs[q]:
                            found += [(a + c + s, c + s) for s in common(u, arcs[q][c])]
            edits[q] = found
        return found

    stack = [("", acceptor.start)]
    while stack:
        prefix, q = stack.pop()
        for x, y in edited(q):
            yield prefix + x, prefix + y
        stack += [(prefix + c, t) for c, t in arcs[q].items()]


def _inside(batches):
    """Of a range's sorted words: each with the number of its near words in the range and the most frequent one."""
    words, counts, parts = [], [], []
    for b in batches:
        words += b.column(0).to_pylist()
        counts += b.column(1).to_pylist()
        parts += b.column(2).to_pylist()
    if not words:
        return
    at = {w: i for i, w in enumerate(words)}
    near, best = [0] * len(words), [-1] * len(words)
    for x, y in near_pairs(Acceptor(words)):
        i, j = at[x], at[y]
        for i, j in ((i, j), (j, i)):
            near[i] += 1
            k = best[i]
            if k < 0 or counts[j] > counts[k] or counts[j] == counts[k] and j < k:  # places are in code-point order
                best[i] = j
    for a in range(0, len(words), 10_000):
        z = slice(a, a + 10_000)
        top = best[z]
        columns = [pa.array(words[z], pa.string()), pa.array(counts[z], pa.int64()), pa.array(near[z], pa.int64()), pa.array([counts[k] if k >= 0 else None for k in top], pa.int64()), pa.array([words[k] if k >= 0 else None for k in top], pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(parts[z], pa.int32())], ["word", "n", "n_near", "best_n", "best", "part"])


def _shared(a: Column, b: Column) -> Column:
    """Letters that two words have in common from their start; -1 where b is null."""
    last = F.aggregate(F.sequence(F.lit(1), F.least(F.length(a), F.length(b))), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(k))
    return F.coalesce(F.when(b.isNotNull(), last), F.lit(-1))


def _across(held: DataFrame) -> DataFrame:
    """Near words in other ranges, of ranges' words (word, n, part), as rows word, n, n_near 1, best_n, best."""
    ranges, order = held.groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("last")), Window.orderBy("part")
    edges = ranges.select("part", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))  # one row a task
    reach = F.greatest(_shared(F.col("word"), F.col("before")), _shared(F.col("word"), F.col("after")))
    open_ = held.select("word", "n", "part").join(F.broadcast(edges), "part").withColumn("reach", F.least(reach, F.length("word") - 1)).where("reach >= 0")
    i = F.col("i")
    keyed = open_.select("word", "n", "part", F.explode(F.sequence(F.lit(0), "reach")).alias("i")).select(
        "word", "n", "part", "i", F.concat(F.substr("word", F.lit(1), i), F.substr("word", i + 2)).alias("rest"), ((i == 0) | (F.substr("word", i, F.lit(1)) != F.substr("word", i + 1, F.lit(1)))).alias("once"),
    )
    other = keyed.select("i", "rest", F.col("word").alias("best"), F.col("n").alias("best_n"), F.col("part").alias("p"))
    replaced = keyed.join(other, ["i", "rest"]).where("part != p").select("word", "n", "best_n", "best")
    whole = held.select(F.col("word").alias("rest"), F.col("n").alias("best_n"), F.col("part").alias("p"))
    longer = keyed.where("once").join(whole, "rest").where("part != p").select("word", "n", "best_n", F.col("rest").alias("best"))
    shorter = longer.select(F.col("best").alias("word"), F.col("best_n").alias("n"), F.col("n").alias("best_n"), F.col("word").alias("best"))
    return replaced.union(longer).union(shorter).select("word", "n", F.lit(1).cast("long").alias("n_near"), "best_n", "best")


def _deletions(batches):
    """For each word its id, length, and a 64-bit key of the word itself (at -1) and of the word without each of its letters."""
    base = np.uint64(0x9E3779B97F4A7C15)
    for b in batches:
        for i, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = (np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            n = len(x)
            with np.errstate(over="ignore"):
                power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base, np.uint64))), dtype=np.uint64)
                # Letter k weighs base ** k, one less once an earlier letter is gone; base is odd, so it has an inverse.
                less = np.uint64(pow(int(base), -1, 1 << 64))
                before = np.concatenate(([np.uint64(0)], np.cumsum(x * power[:n], dtype=np.uint64)))
                keys = before[:-1] + (before[-1] - before[1:]) * less
            all_ = np.concatenate((before[-1:], keys)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([i] * (n + 1), pa.string()), pa.array([n] * (n + 1), pa.int32()), pa.array(np.arange(-1, n), pa.int32()), pa.array(all_)], ["id", "len", "i", "k"])


def _long(vocabulary: DataFrame) -> DataFrame:
    """Near words where at least one is longer than LONG, as rows word, n, n_near 1, best_n, best."""
    words = table(vocabulary.where(F.length("word") >= LONG).select(F.sha2("word", 256).alias("id"), "word", "n"), "long-words")
    keys = table(words.select("id", "word").mapInArrow(_deletions, "id string, len int, i int, k long"), "deletions")
    other = keys.select(F.col("id").alias("id2"), F.col("len").alias("len2"), F.col("i").alias("i2"), "k")
    replaced = keys.where("i >= 0").join(other.where("i2 >= 0"), "k").where(f"i = i2 and len = len2 and id != id2 and len > {LONG}")
    longer = keys.where("i >= 0").join(other.where("i2 < 0"), "k").where(f"len = len2 + 1 and len > {LONG}").select("id", "id2")
    pairs = replaced.select("id", "id2").union(longer).union(longer.select("id2", "id")).distinct()
    back = words.select(F.col("id").alias("id2"), F.col("word").alias("best"), F.col("n").alias("best_n"))
    met = pairs.join(words, "id").join(back, "id2").where(F.levenshtein("word", "best", 1) == 1)
    return met.select("word", "n", F.lit(1).cast("long").alias("n_near"), "best_n", "best")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """vocabulary (word, n; words differ) with n_near, the number of words one edit away, and best, best_n, the most frequent of
    them (of equally frequent ones the first in code-point order; null if none)."""
    vocabulary = table(vocabulary.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    short = vocabulary.where(F.length("word") <= LONG)
    ranges = max(1, -(-short.count() // RANGE_WORDS))
    ranged = short.repartitionByRange(ranges, "word").sortWithinPartitions("word").withColumn("part", F.spark_partition_id())
    held = table(ranged.mapInArrow(_inside, f"{_NEAR}, part int"), "ranges")
    found = held.drop("part").union(_across(held))
    longer = vocabulary.where(F.length("word") > LONG)
    if not longer.isEmpty():
        found = found.union(_long(vocabulary)).union(longer.select("word", "n", F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("string")))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    sums = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return sums.select("word", "n", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def spelling_forms(vocabulary: DataFrame, times: int = 5) -> DataFrame:
    """One row for each word: word, n, n_near, form (its best near word if at least times as frequent, else null), form_n, root
    (the last of the word's form, that one's form, and so on; the word itself without a form)."""
    good = F.col("best_n") >= times * F.col("n")
    words = table(near_words(vocabulary).select("word", "n", "n_near", F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "forms")
    # Each step doubles the way; forms are times as frequent, so ways are as long as the logarithm of the largest count at most.
    jumps = words.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = table(jumps.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        jumps = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return words.join(jumps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6, min_count: int = 5, drop_every: int = 0) -> DataFrame:
    """(word, n): runs of Latin letters of all texts, A-Z lower-cased, of at least min_chars code points and min_count
    occurrences.

    With drop_every, misspellings are put in: where it divides the CRC-32 h of `<id>:<run>`, the run's code point
    h % length goes. A null text has no runs, a null id is an empty one; rows that repeat are counted each. Other columns are
    ignored."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_chars).select("i", ascii_lower(F.col("run")).alias("word"))
    if drop_every:
        h = F.crc32(F.concat_ws(":", "i", "word").cast("binary"))
        at = (h % F.length("word")).cast("int")
        runs = runs.select(F.when(h % drop_every == 0, F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))).otherwise(F.col("word")).alias("word")).where(F.length("word") >= min_chars)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


#: Near words by all one-letter deletions of the whole vocabulary: the same rows by another way.
SQL = f"""
WITH RECURSIVE x AS (SELECT coalesce(doc_id::VARCHAR, '') AS i, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS w FROM documents),
h AS (SELECT w, c, {CRC_SQL.format("i || ':' || w")} AS h FROM (SELECT i, w, count(*) AS c FROM x WHERE length(w) >= 6 GROUP BY ALL)),
o AS (SELECT CASE WHEN h % 199 = 0 THEN substring(w, 1, (h % length(w))::INT) || substring(w, (h % length(w))::INT + 2) ELSE w END AS w, c FROM h),
v AS MATERIALIZED (SELECT w AS word, CAST(sum(c) AS BIGINT) AS n FROM o WHERE length(w) >= 6 GROUP BY w HAVING sum(c) >= 5),
k AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i::INT) || substring(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM k a JOIN k b USING (i, rest) WHERE a.word <> b.word
      UNION SELECT k.word, v.word, v.n FROM k JOIN v ON v.word = k.rest UNION SELECT v.word, k.word, k.n FROM k JOIN v ON v.word = k.rest),
b AS (SELECT word, count(*) AS n_near, max(m) AS top FROM p GROUP BY word),
t AS (SELECT word, min(other) AS best FROM p JOIN b USING (word) WHERE m = top GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * n THEN best END AS form, CASE WHEN top >= 5 * n THEN top END AS form_n FROM v LEFT JOIN b USING (word) LEFT JOIN t USING (word)),
r(word, root) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL) USING (word)
"""
