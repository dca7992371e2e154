"""Token ids of whole texts by public tokenizers.

ByteBpe takes a byte-level BPE file of the tokenizers library and runs its merges with tiktoken, which gives the same ids.
WordIds is for vocabularies that drop white space: no merge crosses it, so each different word is encoded once and then
found in a memo of bounded size, and a text's ids are gathered with numpy.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from cohortgraph.llm.text_arrays import Words, give_back, slices

#: Different words whose ids a Python worker remembers before it starts anew, about 60 bytes each; for each six of them it
#: remembers one letter run while it encodes words.
MEMO_WORDS = 2_000_000

#: Characters of white space in a row from which a text is handed to the tokenizers library.
LONG_BLANK = 50_000
_BLANKS = re.compile(r"\s+").finditer


def vocabulary(name: str) -> str:
    """Place of a vocabulary file of the public_tokenizers package; operators take any path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


class ByteBpe:
    """ids(text): equal to Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        back = {c: b for b, c in _byte_letters().items()}
        self.path = path
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in held["model"]["vocab"].items() if t not in self.special}
        self.encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    @cached_property
    def library(self) -> Callable[[str], list[int]]:
        from tokenizers import Tokenizer

        full = Tokenizer.from_file(self.path)
        return lambda text: full.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        """tiktoken's stack overflows on a very long run of white space, so the library takes texts that have one."""
        if len(text) >= LONG_BLANK and any(m.end() - m.start() >= LONG_BLANK for m in _BLANKS(text)):
            return np.array(self.library(text), np.uint32)
        if any(s in text for s in self.special):
            return np.array(self.encoding.encode(text, allowed_special="all"), np.uint32)
        return np.array(self.encoding.encode_ordinary(text), np.uint32)


def tokenizers_words(path: str, letters_held: int = MEMO_WORDS // 6) -> Callable[[list[str]], list[list[int]]]:
    """Encodes words with the tokenizers library. Plain Latin words go to the file's model directly, past the library's
    bookkeeping of offsets, which costs several times the merges themselves."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already; each thread would hold memory
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path)
    tokenize, letters = full.model.tokenize, str.maketrans(_byte_letters())
    plain = re.compile("^(?:([a-zß-öø-ÿ]{1,60})([.,;:!?]?)|.*)$", re.M).findall
    known: dict[str, list[int]] = {"": []}

    def encode(words: list[str]) -> list[list[int]]:
        # Letters that lower() brings into Latin-1 from outside are brought there by the vocabulary's normaliser too.
        found = plain("\n".join(words).lower()) if words else []
        heads = [a for a, _ in found]
        new = set(heads).difference(known)
        if len(known) + len(new) > letters_held:
            known.clear()
            known.update({"": []} | {x: [t.id for t in tokenize(x)] for x in ".,;:!?"})
            new = set(heads).difference(known)
        elif "." not in known:
            known.update((x, [t.id for t in tokenize(x)]) for x in ".,;:!?")
        for x in new:
            known[x] = [t.id for t in tokenize(x if x.isascii() else x.encode().decode("latin-1").translate(letters))]
        out = [known[a] + known[b] if b else known[a] for a, b in found]
        odd = [i for i, a in enumerate(heads) if not a]
        for i, e in zip(odd, full.encode_batch_fast([words[i] for i in odd], add_special_tokens=False)):
            out[i] = e.ids
        return out

    return encode


def sentencepiece_words(path: str) -> Callable[[list[str]], list[list[int]]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda words: model.encode(words, num_threads=1)


@lru_cache(maxsize=4)
def word_ids(path: str, kind: str = "tokenizers", memo: int = MEMO_WORDS) -> WordIds:
    return WordIds(sentencepiece_words(path) if kind == "sentencepiece" else tokenizers_words(path, memo // 6), memo)


@lru_cache(maxsize=2)
def tiktoken_ids(path: str) -> Callable[[str], list[int]]:
    """Encodes texts by a file of byte-level ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def forget() -> None:
    """Lets go of vocabularies and memos at the end of a task: workers live on, and later steps need the room."""
    byte_bpe.cache_clear()
    word_ids.cache_clear()
    tiktoken_ids.cache_clear()
    give_back()


class WordIds:
    """Ids of each word of a text in turn, for vocabularies whose ids don't depend on white space.

    Words are remembered by their 64-bit hashes."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], memo: int = MEMO_WORDS):
        self.encode, self.memo = encode, memo
        self.clear()

    def clear(self) -> None:
        self.flat, self.used, self.words = np.zeros(1 << 16, np.uint32), 0, 0
        self.begin, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.old, self.young = none, none  # sorted word hashes and their numbers; the young join the old in larger steps

    def _add(self, hashes: np.ndarray, new: list[bytes]) -> None:
        ids = self.encode([w.decode("utf-8", "replace") for w in new])
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        n, size = self.words, int(lengths.sum())
        while n + len(new) > len(self.begin):
            self.begin, self.length = np.concatenate((self.begin, self.begin)), np.concatenate((self.length, self.length))
        while self.used + size > len(self.flat):
            self.flat = np.concatenate((self.flat, self.flat))
        self.begin[n : n + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + len(new)] = lengths
        self.flat[self.used : self.used + size] = np.fromiter(chain.from_iterable(ids), np.uint32, size)
        self.used += size
        self.words += len(new)
        self.young = self._merged(self.young, (hashes, np.arange(n, n + len(new))))
        if 4 * len(self.young[0]) > len(self.old[0]):
            self.old, self.young = self._merged(self.old, self.young), (self.young[0][:0], self.young[1][:0])

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        hashes, numbers = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
        order = np.argsort(hashes, kind="stable")
        return hashes[order], numbers[order]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words with these hashes, -1 where they are not known."""
        out = np.full(len(hashes), -1, np.int64)
        for known, numbers in (self.old, self.young):
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                out[hit] = numbers[at[hit]]
        return out

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts one after another, first: index of each text's first id and the end, ids of each word)."""
        hashes, at, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        which = self._find(hashes)
        if self.words + (which < 0).sum() > self.memo:
            self.clear()
            which[:] = -1
        new = np.flatnonzero(which < 0)
        if len(new):
            data = words.data.tobytes()
            which[new] = np.arange(self.words, self.words + len(new))
            self._add(hashes[new], [data[a:b] for a, b in zip(words.starts[at[new]].tolist(), words.ends[at[new]].tolist())])
        which = which[back]
        lengths = self.length[which]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.begin[which] - (ends - lengths), lengths) + np.arange(total)]
        return ids, np.concatenate(([0], ends))[words.first], lengths

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for lo, hi, data, offsets in slices(column):
            ids, first, _ = self.of(Words(data, offsets, fold=False))
            for i in range(hi - lo):
                yield ids[first[i] : first[i + 1]]
