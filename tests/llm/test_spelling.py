"""Near words, forms and roots against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortgraph.llm import spelling_groups as sg
from cohortgraph.llm.queries import op11_spelling_groups

DIR = "/root/testdata/sf0.001"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute(counts, times=5):
    """Words are compared where they share their first or second half's letters, as two near words do."""
    words, by = sorted(counts), {}
    for w in words:
        for cut in {len(w) // 2, (len(w) + 1) // 2, (len(w) - 1) // 2}:
            by.setdefault((0, w[:cut]), []).append(w)
            by.setdefault((1, w[cut:]), []).append(w)
            by.setdefault((1, w[cut + 1 :]), []).append(w)
    found = {w: set() for w in words}
    for group in by.values():
        for a in group:
            found[a].update(b for b in group if near(a, b))
    best = {w: min(x, key=lambda b: (-counts[b], b)) for w, x in found.items() if x}
    form = {w: b for w, b in best.items() if counts[b] >= times * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), counts[w], len(found[w]), counts[form[w]] if w in form else None) for w in words)


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


@settings(max_examples=400, deadline=None)
@given(st.sets(st.text("abé", max_size=7), max_size=40))
def test_composition_gives_each_near_pair_once(words):
    pairs = Counter(frozenset(p) for p in sg.near_pairs(sg.Acceptor(sorted(words))))
    assert set(pairs.values()) <= {1}
    assert set(pairs) == {frozenset((a, b)) for a in words for b in words if near(a, b)}


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=40))
def test_acceptor_is_minimal_and_exact(words):
    a = sg.Acceptor(sorted(words))

    def language(q):
        return frozenset({""} if a.final[q] else ()) | {c + s for c, t in a.arcs[q].items() for s in language(t)}

    all_ = [language(q) for q in range(len(a.arcs))]
    assert all_[a.start] == words and len(set(all_)) == len(all_), "no two states have the same right language"
    assert all((min(map(len, x)), max(map(len, x))) == (a.least[q], a.most[q]) for q, x in enumerate(all_))


@pytest.mark.parametrize("size", [7, 60, 100_000])
def test_ranges_of_any_size_give_the_same(spark, monkeypatch, size):
    """Ranges of a few words cut every group; most near words are then in other ranges."""
    monkeypatch.setattr(sg, "RANGE_WORDS", size)
    rng = random.Random(1)
    words = {"".join(rng.choice("aabc") for _ in range(rng.randint(1, 7))) for _ in range(400)} | {"\U0001f600a", "￮a", "ab", "aab", "aaab", "b" * 64, "b" * 63 + "c", "b" * 62}
    counts = {w: int(5 ** rng.uniform(0, 6)) for w in words}
    assert got(sg.spelling_forms(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3))) == brute(counts)


def test_long_words(spark):
    base = "".join(random.Random(2).choice("abcdé") for _ in range(3000))
    words = [base, base[1:], base[:-1], base[:1500] + base[1501:], base[:700] + "x" + base[701:], base[:700] + "y" + base[701:], base + "z", "b" * 64, "b" * 65, "b" * 66, "b" * 64 + "c", "b" * 63 + "c", "a" * 20_000, "a" * 20_001, "a" * 9_999 + "b" + "a" * 10_000]
    counts = {w: 5 ** (k % 4) for k, w in enumerate(words)}
    assert got(sg.spelling_forms(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)


def words_of(rows, least=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    assert got(op11_spelling_groups(spark, DIR)) == brute(words_of(rows))


def test_hard_and_empty_tables(spark, hard_docs, no_docs):
    count = lambda docs: sg.word_counts(docs, min_count=1, drop_every=199)
    rows = [(r.doc_id, r.text) for r in hard_docs.collect()]
    assert {r.word: r.n for r in count(hard_docs).collect()} == words_of(rows, 1)
    assert got(sg.spelling_forms(count(hard_docs))) == brute(words_of(rows, 1))
    assert got(sg.spelling_forms(count(no_docs))) == []
