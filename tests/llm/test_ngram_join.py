import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from cohortgraph.llm import ngram_join


def brute(rows, words, percent):
    """{id: (set size, smallest id reachable)}"""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed, n_bases=6, copies=25):
    """Groups of near copies, from light edits to edits around the threshold, and unrelated texts of all lengths."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    passage = [word() for _ in range(60)]
    texts = []
    for b in range(n_bases):
        base = [word() for _ in range(rng.choice([6, 12, 20, 60, 150, 400]))] + (passage if b % 2 else [])
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                k = rng.randrange(len(t))
                t[k : k + rng.choice([0, 1, 1])] = [word()]
            texts.append(" ".join(t))
    texts += [" ".join([word() for _ in range(rng.choice([1, 2, 5, 9, 40]))]) for _ in range(30)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,words,percent", [(1, 4, 85), (2, 5, 80)])
def test_components_equal_brute_force(spark, seed, words, percent):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, words=words, percent=percent).collect()}
    assert got == brute(rows, words, percent)


def test_hard_texts(spark, hard_docs):
    got = ngram_join.jaccard_components(hard_docs).collect()
    assert len(got) == hard_docs.count()
    # Equal texts with equal ids are one row to brute force; a null id stands for no id.
    rows = [(r.doc_id, r.text) for r in hard_docs.collect() if r.doc_id is not None]
    want = brute(rows, 5, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert ngram_join.one_of_each(hard_docs).columns == hard_docs.columns


def test_empty(spark, no_docs):
    assert ngram_join.jaccard_components(no_docs).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 300), st.sampled_from([80, 85, 90]))
def test_linked_sets_meet(seed, n, percent):
    """What the join rests on: in any common order, the first token that two linked sets share is in the head of one that is no
    larger and in the prefix of the other, and enough of both sets comes after it."""
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    change = int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))
    b = np.unique(np.concatenate((a[change:], rng.integers(0, 2**63, int(rng.integers(0, change + 1))).astype(np.uint64))))
    both = np.intersect1d(a, b)
    if not len(both) or 100 * len(both) < percent * len(np.union1d(a, b)):
        return
    x, y = sorted((a, b), key=len)
    order = lambda s: s[np.argsort(s * np.uint64(0x9E3779B97F4A7C15))]
    i, j = (int(np.flatnonzero(np.isin(order(s), both))[0]) for s in (x, y))
    assert i < ngram_join.head_length(len(x), percent) and j < ngram_join.prefix_length(len(y), percent)
    assert (100 + percent) * min(len(x) - i, len(y) - j) >= percent * (len(x) + len(y))


def test_words_that_collide_under_polynomials(spark):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2**64 for every base."""
    x = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    y = x.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{x} one two three"), (2, f"{y} one two three"), (3, f"{x} one two three")]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_ranks_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, t) for i, t in near_copies(3)], "doc_id long, text string")
    one, many = (ngram_join.corpus_ranks(docs.repartition(k), "text", 4) for k in (1, 7))
    assert np.array_equal(one.words, many.words) and np.array_equal(one.shingles, many.shingles) and one.base == many.base


def test_one_of_each_keeps_whole_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    near = text + " tail"
    rows = [(5, near, "a"), (2, text, "b"), (None, near + " more", "c"), (2, text, "b"), (7, "quite another text of its own here", "d"), (7, text, "e"), (None, "left alone without any id or kin", "f"), (9, None, "g"), (9, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __in string")
    got = sorted(tuple(r) for r in ngram_join.one_of_each(docs).select("__in").collect())
    assert [x for (x,) in got] in (["b", "d", "f", "g"], ["b", "d", "f", "h"], ["b", "d", "f", "g", "h"])
    assert ngram_join.one_of_each(docs).columns == docs.columns
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


def test_large_group_is_opened(spark):
    """A hub that most of a large group links to only through some of its members."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        t = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6])):
            t[rng.randrange(len(t))] = f"x{i}y{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=85).collect()}
    assert got == brute(rows, 4, 85)
