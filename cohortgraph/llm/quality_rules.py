"""Quality rules from tokeniser fertility.

Public vocabularies tell how well a text is made of the pieces that natural language is made of: characters per token by
two vocabularies, entropy of the tokens used, and the share of tokens that are bare bytes. Each language, or where it is not
known each script, has a band of accepted values, which is the wider the fewer tokens a text has, as means of few tokens
spread more. A text outside a band is rejected. Plain counts of words, symbols and
repetitions come with it and can reject a text on their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgraph.llm.text_arrays import ROWS, Words, mix, slices
from cohortgraph.llm.tokens import forget, tiktoken_ids, word_ids

#: Characters per token in which good texts of a language differ however long they are.
APART = 0.12


class Band(NamedTuple):
    """Accepted values of one vocabulary for a text of n tokens: characters per token from least - max(spread / sqrt(n),
    APART) to most, and entropy in bits from base + slope * log2(n)."""

    least: float
    spread: float
    most: float
    base: float
    slope: float


#: For each language code, then script, the most byte share and a band for each vocabulary (pieces, words). The languages' least
#: values are medians of labelled good documents of one table, the spreads about 1.4 times what holds them all there; scripts' bands are wide guesses.
BANDS: dict[str, tuple[float, Band, Band]] = {
    "en": (0.10, Band(2.22, 7.0, 6.5, 3.58, 0.220), Band(2.41, 8.6, 6.5, 3.17, 0.265)),
    "de": (0.12, Band(2.24, 5.2, 6.5, 3.87, 0.186), Band(2.21, 4.8, 6.5, 3.95, 0.178)),
    "fr": (0.15, Band(1.98, 6.2, 6.5, 4.38, 0.147), Band(2.01, 7.2, 6.5, 4.36, 0.122)),
    "es": (0.12, Band(1.94, 3.9, 6.5, 4.21, 0.182), Band(1.95, 4.0, 6.5, 3.97, 0.186)),
    "latin": (0.20, Band(1.45, 6.0, 7.0, 2.50, 0.200), Band(1.45, 6.0, 7.0, 2.50, 0.200)),
    "other": (0.95, Band(0.25, 1.0, 7.0, 1.50, 0.200), Band(0.10, 1.0, 7.0, 1.50, 0.200)),
}

#: Scripts, each with its ranges of code points and the least characters per token of a vocabulary for many languages, for texts
#: whose language has no band. The limits lie half way between paragraphs of one to twelve languages of the script and words of
#: random letters of it. What is in none of the ranges has no limit.
SCRIPTS: dict[str, tuple[list[tuple[int, int]], float]] = {
    "latin": ([(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)], 1.62),
    "greek": ([(0x370, 0x3FF), (0x1F00, 0x1FFF)], 1.36),
    "cyrillic": ([(0x400, 0x52F)], 1.55),
    "hebrew": ([(0x590, 0x5FF)], 1.31),
    "arabic": ([(0x600, 0x6FF), (0x750, 0x77F)], 1.33),
    "devanagari": ([(0x900, 0x97F)], 0.66),
    "thai": ([(0xE00, 0xE7F)], 1.04),
    "kana": ([(0x3040, 0x30FF)], 1.02),
    "han": ([(0x3400, 0x4DBF), (0x4E00, 0x9FFF)], 0.70),
    "hangul": ([(0x1100, 0x11FF), (0xAC00, 0xD7AF)], 1.12),
}
#: By this over the square root of its tokens a text may be below its script's limit: means of few tokens spread more.
SCRIPT_SPREAD = 0.5
#: Share of kana from which a text of Han characters is Japanese.
KANA_SHARE = 0.1

#: Words that a worker remembers for each vocabulary: two are held side by side, next to what earlier steps left there.
MEMO = 200_000
#: Bytes of text that are measured at once, for the same reason.
SLICE = 1 << 18

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = b" \t\n\x0b\x0c\r"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_RATES = ["chars_per_token", "byte_share", "token_entropy", "latin_share", "chars_per_word_token", "word_token_entropy", "chars_per_many_token"]


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of x between successive positions of first."""
    total = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    return np.diff(total[first])


def _duplicate_lines(data: bytes, offsets: list[int]) -> list[int]:
    out = []
    for a, b in zip(offsets, offsets[1:]):
        lines = data[a:b].split(b"\n")
        worded = [x for x in lines if x.strip(_BLANK)] if len(lines) > 1 else lines[:0]
        out.append(len(worded) - len(set(worded)))
    return out


def _repeated(words: Words, width: int = 8) -> np.ndarray:
    """For each text, its words that lie in a run of width words found twice or more in it."""
    h, first, at = words.windows(width, short=False)
    covered = np.zeros(len(words.starts) + 1, np.int64)
    if len(h):
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        key = h ^ mix(text.astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(h), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at = at[again]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + width, -1)
    return _sums(np.cumsum(covered)[:-1] > 0, words.first)


def _entropy(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bits of the distribution of each text's ids."""
    tokens = np.diff(first)
    text = np.repeat(np.arange(len(tokens)), tokens)
    key, times = np.unique(text.astype(np.int64) << 32 | ids, return_counts=True)
    each = np.bincount(key >> 32, times * np.log2(np.maximum(times, 1)), minlength=len(tokens))
    some = np.maximum(tokens, 1)
    return np.log2(some) - each / some


def measures(column: pa.Array, pieces: str, word_pieces: str) -> Iterator[dict[str, np.ndarray]]:
    """Counts and rates of runs of texts; pieces is a vocabulary with byte fallback, word_pieces one of words in lower case."""
    encoders = word_ids(pieces, "sentencepiece", MEMO), word_ids(word_pieces, memo=MEMO)
    for _, _, data, offsets in slices(column, SLICE):
        words = Words(data, offsets, fold=False)
        lead = (data & 0xC0) != 0x80
        latin = (data < 0x80) | (data >= 0xC3) & (data <= 0xC9)
        (ids, first, _), (others, begin, _) = (e.of(words) for e in encoders)
        n, tokens, word_tokens = words.counts(), np.diff(first), np.diff(begin)
        some, chars = np.maximum(tokens, 1), _sums(lead & ~words.space, offsets)
        yield {
            "n_words": n, "word_chars": chars, "n_symbols": _sums(_SYMBOL[data], offsets),
            "n_dup_lines": np.array(_duplicate_lines(data.tobytes(), offsets.tolist()), np.int64), "n_repeat_words": _repeated(words),
            "n_tokens": tokens, "chars_per_token": chars / some, "byte_share": _sums((ids >= 3) & (ids < 259), first) / some,
            "token_entropy": _entropy(ids, first), "latin_share": _sums(latin & lead & ~words.space, offsets) / np.maximum(chars, 1),
            "n_word_tokens": word_tokens, "chars_per_word_token": chars / np.maximum(word_tokens, 1), "word_token_entropy": _entropy(others, begin),
        }


_NAMES = list(SCRIPTS)
_RANGES = sorted((a, b, k) for k, name in enumerate(_NAMES) for a, b in SCRIPTS[name][0])
_EDGES = np.array([x for a, b, _ in _RANGES for x in (a, b + 1)])
_WHICH = np.array([-1, *(x for *_, k in _RANGES for x in (k, -1))])


def script_of(text: str) -> str:
    """The script of most of a text's letters; 'other' where most are of none that is listed."""
    found = np.bincount(_WHICH[np.searchsorted(_EDGES, np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), "right")] + 1, minlength=len(_NAMES) + 1)
    kana, han = (1 + _NAMES.index(x) for x in ("kana", "han"))
    if found[kana] >= KANA_SHARE * (found[kana] + found[han]):
        found[kana], found[han] = found[kana] + found[han], 0
    # Signs, digits and marks are of no script; a text mostly of letters that are not listed has few that are.
    k = int(found[1:].argmax())
    return _NAMES[k] if found[1 + k] * 4 > found.sum() else "other"


def script_fertility(text: str, many: str) -> tuple[str, float, float]:
    """(script, characters per token of the vocabulary file many, the least that the script's texts of so many tokens have)."""
    name, words = script_of(text), text.split()
    n = max(len(tiktoken_ids(many)(" ".join(words))), 1)
    least = SCRIPTS[name][1] - SCRIPT_SPREAD / n**0.5 if name in SCRIPTS else 0.0
    return name, sum(map(len, words)) / n, least


def _judge(pieces: str, word_pieces: str, many: str | None = None, bands: Mapping[str, tuple[float, Band, Band]] = BANDS, least_words: int = 20, most_repeated: int = 30):
    """A function from columns of texts and languages to measures, failed base rules and reasons ('' if kept)."""
    kinds = ("n_tokens", "chars_per_token", "token_entropy"), ("n_word_tokens", "chars_per_word_token", "word_token_entropy")

    def reasons(texts: pa.Array, langs: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        parts = list(measures(texts, pieces, word_pieces))
        m = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        names = np.where(m["latin_share"] >= 0.5, "latin", "other").tolist()
        langs = langs.to_pylist()
        names = [x if x in bands else s for x, s in zip(langs, names)]
        m["chars_per_many_token"] = np.full(len(names), np.nan)
        base = (m["n_words"] < least_words) | (100 * m["n_repeat_words"] > most_repeated * m["n_words"])
        dense, sparse, dull = (np.zeros(len(base), bool) for _ in range(3))
        known = np.array([not many or x in bands for x in langs], bool)
        for i in np.flatnonzero(~known & ~base).tolist():
            _, m["chars_per_many_token"][i], least = script_fertility(texts[i].as_py() or "", many)
            dense[i] = m["chars_per_many_token"][i] < least
        for k, (count, chars, entropy) in enumerate(kinds):
            least, spread, most, floor, slope = np.array([bands[x][1 + k] for x in names]).T
            n = np.maximum(m[count], 1)
            dense |= known & (m[chars] < least - np.maximum(spread / np.sqrt(n), APART))
            sparse |= m[chars] > most
            dull |= m[entropy] < np.minimum(floor + slope * np.log2(n), 0.8 * np.log2(n))
        bare = m["byte_share"] > np.array([bands[x][0] for x in names])
        return m, base, np.select([base, dense, sparse, bare, dull], ["base", "dense", "sparse", "bytes", "entropy"], "")

    return reasons


def quality(
    docs: DataFrame, pieces: str, word_pieces: str, many: str | None = None, bands: Mapping[str, tuple[float, Band, Band]] = BANDS, least_words: int = 20, most_repeated: int = 30,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
) -> DataFrame:
    """One row for each row of docs: id, the five counts, base_failed, rates, reason, kept.

    Words are `[^\\x20\\x09-\\x0D]+`. base_failed: fewer than least_words words, or more than most_repeated percent of the
    words lie in repeated runs of eight. Rates are judged by the band of the row's language, or without one (null, or not
    listed) of its script: latin where at least half of the word characters are, else other. There characters per token are
    judged by the vocabulary many, where it is given, and the limits of SCRIPTS. reason names the first
    failure: base, dense or sparse (characters per token), bytes, entropy; null if kept. A null or blank text
    has no words and fails. Repeated rows are judged alike; other columns are ignored.
    """

    reasons = _judge(pieces, word_pieces, many, bands, least_words, most_repeated)

    def judge(batches):
        for b in batches:
            if not b.num_rows:
                continue
            m, base, reason = reasons(b.column(1), b.column(2))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(m[k].astype(np.int64)) for k in _COUNTS), pa.array(base), *(pa.array(m[k].astype(np.float64), from_pandas=True) for k in _RATES), pa.array([x or None for x in reason.tolist()], pa.string()), pa.array(reason == "")],
                [id_col, *_COUNTS, "base_failed", *_RATES, "reason", "kept"],
            )

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), lang.alias("l"))
    counts, rates = ", ".join(f"{c} long" for c in _COUNTS), ", ".join(f"{c} double" for c in _RATES)
    return rows.mapInArrow(judge, f"`{id_col}` long, {counts}, base_failed boolean, {rates}, reason string, kept boolean")


def keep_good(docs: DataFrame, pieces: str, word_pieces: str, many: str | None = None, text_col: str = "text", lang_col: str | None = "lang", **rules) -> DataFrame:
    """docs without the rows that quality() rejects, each judged by its own text and language; all columns stay.

    A string column is judged where it stands in the row: a second copy of the texts would take as much memory again, in
    Spark and in the worker. Only columns of other types are cast beside it. Rows go back a few at a time, too."""
    reasons = _judge(pieces, word_pieces, many, **rules)
    names, kinds = docs.columns, dict(docs.dtypes)
    own = [c if c and kinds.get(c) == "string" and names.count(c) == 1 else None for c in (text_col, lang_col)]
    beside = [F.col(c).cast("string") if c else F.lit(None).cast("string") for c, held in zip((text_col, lang_col), own) if not held]

    def keep(batches):
        for b in batches:
            for begin in range(0, b.num_rows, ROWS):
                part = b.slice(begin, ROWS)
                row, cast = part.column(0).flatten(), iter(part.columns[1:])
                good = reasons(*(row[names.index(c)] if c else next(cast) for c in own))[2] == ""
                yield pa.RecordBatch.from_arrays(row, names=names).filter(pa.array(good))
        forget()

    return docs.select(F.struct("*").alias("row"), *(c.alias(f"c{k}") for k, c in enumerate(beside))).mapInArrow(keep, docs.schema)
