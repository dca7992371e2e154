"""Quality classifier from weak labels.

Overlapping heuristic labellers each call a text good or bad or abstain. Expectation-maximisation estimates how often each
labeller is right from their agreement alone, on the counts of vote patterns over the whole corpus (at most 3 to the
number of labellers, whatever the corpus). The posterior of a text's pattern is its label for a hashed linear scorer, which
is fitted on every text: its features are written once, and each step of the optimiser sums the gradient over all of them.
The threshold is an exact order statistic of all scores.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgraph.llm.quality_rules import _repeated, _sums
from cohortgraph.llm.shared import table
from cohortgraph.llm.text_arrays import Words, mix, slices

#: Width of the hashed feature space; feature numbers are written in 16 bits.
FEATURES = 1 << 14
#: Steps of the scorer's optimiser, each a sum over all rows.
STEPS = 25
#: Weight of half the squared weights beside the mean loss of a text.
L2 = 1e-5
#: Rows whose features are unpacked at once.
ROWS = 1024
#: Of the texts whose weak label is good, the share that the threshold may reject.
MAY_REJECT = 0.001
#: Cells into which a range of scores is cut while an order statistic is sought.
CELLS = 4096
#: Texts that the prior on labellers' accuracies stands for, whatever the corpus.
PRIOR = 100.0
#: Common function words of the corpus's languages, lower case (fixed values).
FUNCTION_WORDS = (
    "the of and to in is that it for as with was on by are be this from or an at which you have not "
    "der die das und in zu den mit von für ist auf nicht ein eine sich auch dem des er es sie an als "
    "le la les de des du et en un une que qui dans pour par sur est avec plus au ce il ne pas se "
    "el los las del y que en un una por con para es se no al lo como más su"
).split()
LABELLERS = ("length", "symbols", "repetition", "capitals", "marks", "word_length", "function_words")

_CLASS = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 4 digit, 8 mark, 16 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 4, 16
_CLASS[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = 8
_STRONG = np.zeros(256, bool)
_STRONG[list(b"#*$%&|<>")] = True
_LOUD = np.zeros(256, bool)
_LOUD[list(b"!|?=~^")] = True


def _function_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(dict.fromkeys(FUNCTION_WORDS)).encode(), np.uint8)
    return np.unique(Words(data, np.array([0, len(data)]), fold=True).hashes)


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """0 abstain, 1 good, 2 bad."""
    return np.where(bad, 2, np.where(good, 1, 0))


def _votes(words: Words, function: np.ndarray) -> np.ndarray:
    """A row of votes for each text of a run, in the order of LABELLERS."""
    data, n = words.data, words.counts()
    some = np.maximum(n, 1)
    ink = np.maximum(_sums(((data & 0xC0) != 0x80) & ~words.space, words.offsets), 1)
    letters = np.maximum(_sums((_CLASS[data] & 19) > 0, words.offsets), 1)
    common = np.isin(Words(data, words.offsets, fold=True).hashes, function)
    symbols, loud = _sums(_STRONG[data], words.offsets) / ink, _sums(_LOUD[data], words.offsets) / some
    repeated, capitals = _repeated(words) / some, _sums(_CLASS[data] == 2, words.offsets) / letters
    mean, share = ink / some, _sums(common, words.first) / some
    long = n >= 20
    return np.stack(
        [
            _vote(n >= 20, n == 0), _vote(long & (symbols < 0.004), symbols > 0.03), _vote(long & (repeated < 0.02), long & (repeated > 0.3)),
            _vote(long & (capitals < 0.12), long & (capitals > 0.4)), _vote(long & (loud < 0.02), long & (loud > 0.25)),
            _vote(long & (mean > 3) & (mean < 9), (mean < 2) | (mean > 14)), _vote(long & (share > 0.12), (n >= 40) & (share < 0.04)),
        ],
        axis=1,
    )


def _features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashed feature numbers, values) of each text: words and word shapes by their share, vocabulary richness, length."""
    kinds = _CLASS[words.data]
    size = np.minimum(words.ends - words.starts, 255)
    shape = np.zeros(len(words.starts), np.uint64)
    if len(shape):
        for k in (1, 2, 4, 8, 16):
            shape = shape * np.uint64(2) + (np.add.reduceat((kinds & k) > 0, words.starts) > 0)
        shape = shape * np.uint64(64) + kinds[words.ends - 1].astype(np.uint64) * np.uint64(2) + (size > 12)
    named = np.stack([mix(words.hashes), mix(shape + np.uint64(0x5851F42D4C957F2D)), mix(shape * np.uint64(31) + np.uint64(0x14057B7EF767814F))]) % np.uint64(FEATURES)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        n = b - a
        if not n:
            yield np.zeros(1, np.int64), np.ones(1, np.float32)
            continue
        at, times = np.unique(named[:, a:b].astype(np.int64), return_counts=True)
        richness, length = int(8 * len(np.unique(words.hashes[a:b])) / n), min(int(np.log2(n)), 19)
        extra = np.array([32 + length, 64 + 20 * richness + length])
        yield np.concatenate((at, extra)), np.concatenate((np.sqrt(times / n), np.ones(2))).astype(np.float32)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation on vote patterns. (chance of good for each pattern, rates[labeller, class] of a bad call).

    Given its class, a text's labellers are taken to err independently; an abstention says nothing. The start is that one
    bad call makes a text bad. A prior of PRIOR texts says that labellers seldom call a good text bad."""
    bad, cast = patterns == 2, patterns > 0
    good = 1 / (1 + np.exp(4.0 * bad.sum(axis=1) - 2))
    rates = np.zeros((patterns.shape[1], 2))
    for _ in range(rounds):
        before = good
        for c, weight in enumerate((counts * (1 - good), counts * good)):
            rates[:, c] = (weight @ bad + PRIOR * (0.001 if c else 0.3)) / (weight @ cast + PRIOR)
        share = (counts @ good + 1) / (counts.sum() + 2)
        call = np.where(bad[:, :, None], np.log(rates), np.log1p(-rates)) * cast[:, :, None]
        score = call.sum(axis=1) + np.log([1 - share, share])
        good = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))
        if np.abs(good - before).max(initial=0) < 1e-9:
            break
    return good, rates


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int = STEPS, held: int = 10) -> np.ndarray:
    """Limited-memory BFGS: f gives loss and gradient. A step is halved until the loss falls enough; without one it ends."""
    loss, g = f(w)
    past: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=held)
    for _ in range(steps):
        d, back = -g, []
        for s, y in reversed(past):
            back.append((s @ d) / (s @ y))
            d = d - back[-1] * y
        d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.linalg.norm(g), 1e-12))
        for (s, y), b in zip(past, reversed(back)):
            d = d + (b - (y @ d) / (s @ y)) * s
        slope = g @ d
        for size in 0.5 ** np.arange(10):
            after, h = f(w + size * d)
            if after <= loss + 1e-4 * size * slope:
                break
        else:
            break
        fell, s, y = loss - after, size * d, h - g
        w, loss, g = w + s, after, h
        if s @ y > 1e-12 * (y @ y):
            past.append((s, y))
        if fell <= 1e-9 * max(abs(loss), 1e-9):
            break
    return w


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, first entry of each row, feature numbers, values) of a few rows at once; each row has an entry at least."""
    for begin in range(0, batch.num_rows, ROWS):
        code, at, value = (batch.column(n).slice(begin, ROWS) for n in ("code", "at", "value"))
        flat = []
        for x, kind in ((at, "<u2"), (value, "<f4")):
            x = x.cast(pa.large_binary())
            _, where, data = x.buffers()
            offsets = np.frombuffer(where, np.int64)[x.offset : x.offset + len(x) + 1]
            flat.append((offsets, np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind)))
        (offsets, numbers), (_, values) = flat
        yield code.to_numpy(), (offsets[:-1] - offsets[0]) // 2, numbers.astype(np.int64), values.astype(np.float64)


def _margins(w: np.ndarray, first: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    return np.add.reduceat(w[at] * value, first) + w[-1]


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def fit(described: DataFrame, posterior: np.ndarray, base: float, total: int, l2: float = L2) -> np.ndarray:
    """Weights of a logistic scorer on the soft labels of all rows (code, at, value); classes weigh alike, base is the share of
    good. The last weight is the intercept. A task gives one sum over its rows, and the driver gets their sum."""

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        def sums(batches):
            out = np.zeros(FEATURES + 2)
            for b in batches:
                for code, first, at, value in _blocks(b):
                    z, good = _margins(w, first, at, value), posterior[code] / base
                    bad, p = (1 - posterior[code]) / (1 - base), _chance(z)
                    r = bad * p - good * (1 - p)
                    out[:FEATURES] += np.bincount(at, value * np.repeat(r, np.diff(np.append(first, len(at)))), FEATURES)
                    out[-2] += r.sum()
                    out[-1] += (good * np.logaddexp(0, -z) + bad * np.logaddexp(0, z)).sum()
            yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], ["sums"])

        parts = described.select("code", "at", "value").mapInArrow(sums, "sums array<double>")
        found = parts.select(Summarizer.sum(array_to_vector("sums"))).first()[0].toArray() / total
        flat = np.append(w[:-1], 0)
        return float(found[-1] + l2 / 2 * (flat @ flat)), found[:-1] + l2 * flat

    return minimise(loss, np.zeros(FEATURES + 1)) if total else np.zeros(FEATURES + 1)


def order_statistic(values: DataFrame, column: str, k: int, lo: float = 0.0, hi: float = 1.0) -> float:
    """The k-th smallest (from 0) of a column of numbers from lo to hi. Ranges are cut into cells and counted until one value is left."""
    x = F.col(column)
    while True:
        inside = values.where(x.between(lo, hi))
        cell = F.least(F.floor((x - lo) * (CELLS / (hi - lo))), F.lit(CELLS - 1))
        seen = inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).orderBy("cell").collect()  # CELLS rows at most
        for r in seen:
            if k < r["n"]:
                break
            k -= r["n"]
        lo, hi = r["lo"], r["hi"]
        if lo == hi or k == 0 or k == r["n"] - 1:
            return lo if k == 0 or lo == hi else hi


def _code(votes: np.ndarray) -> np.ndarray:
    return (votes * 3 ** np.arange(votes.shape[1])).sum(axis=1)


def classify(docs: DataFrame, may_reject: float = MAY_REJECT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, votes, posterior, score, kept.

    votes has a letter for each labeller: g good, b bad, - abstains. posterior is the chance of good by the votes, score by
    the linear scorer, kept whether score reaches the threshold, at which at most may_reject of the texts with a
    good weak label (posterior over 0.9) fall. Where all labellers abstain nothing speaks against a text, and it is kept. A null or
    blank text has no words, which one labeller calls bad, and is scored by that alone. Null and repeated ids are scored like any other row; an empty table gives no rows; other columns are ignored.
    Each text is read once; counts, scorer and threshold are those of all rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    function = _function_hashes()

    def describe(batches):
        for b in batches:
            for lo, hi, data, offsets in slices(b.column(1)):
                words = Words(data, offsets, fold=False)
                made = [(i.astype("<u2").tobytes(), x.astype("<f4").tobytes()) for i, x in _features(words)]
                at, value = zip(*made)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(_code(_votes(words, function)), pa.int32()), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["id", "code", "at", "value"]
                )

    described = table(rows.mapInArrow(describe, "id long, code int, at binary, value binary"), "features")
    seen = described.groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect()  # 3 ** labellers rows at most
    codes, counts = np.array([r["code"] for r in seen], np.int64), np.array([r["n"] for r in seen], np.float64)
    votes = np.arange(3 ** len(LABELLERS))[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    chance, _ = estimate(votes[codes], counts)
    posterior = np.full(len(votes), 0.5)
    posterior[codes] = chance
    total = int(counts.sum())
    base = min(max(float(counts @ chance) / max(total, 1), 0.02), 0.98)
    w = fit(described, posterior, base, total)
    names = np.array(["".join(v) for v in np.array(["-", "g", "b"])[votes].tolist()])

    def score(batches):
        for b in batches:
            s = np.concatenate([_chance(_margins(w, first, at, value)) for _, first, at, value in _blocks(b)]) if b.num_rows else np.zeros(0)
            code = b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[code], pa.string()), pa.array(posterior[code], pa.float64()), pa.array(s, pa.float64())], [id_col, "votes", "posterior", "score"])

    scored = described.mapInArrow(score, f"`{id_col}` long, votes string, posterior double, score double")
    clean, n = scored.where(F.col("posterior") > 0.9), int(counts[chance > 0.9].sum())
    threshold = min(0.5, 0.9 * order_statistic(clean, "score", int(may_reject * n))) if n else 0.5
    return scored.withColumn("kept", (F.col("score") >= threshold) | (F.col("votes") == "-" * len(LABELLERS)))
