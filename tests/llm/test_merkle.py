"""Manifests against a plain tree."""

import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from cohortgraph.llm import merkle_manifest as mm


def h(text):
    return sha256(text.encode()).hexdigest()


def run_up(nodes):
    """(root, sibling lists) of a run of nodes, level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, i in zip(ways, at):
            if i ^ 1 < len(nodes):
                way.append((i & 1, nodes[i ^ 1]))
            else:
                way.append((0, ""))
        at = [i // 2 for i in at]
        nodes = [h("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
    return nodes[0], ways


def leaf(r, more=0):
    chars = None if r.n_chars is None else r.n_chars + more
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r.doc_id, r.source, r.lang, chars, r.text)))


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.lang].append(r)
    langs, out = sorted(by, key=lambda x: (x is not None, (x or "").encode())), []
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees[lang] = run_up([leaf(r) for r in by[lang]])
    root, tops = run_up([trees[lang][0] for lang in langs])
    for lang, top in zip(langs, tops):
        for r, way in zip(by[lang], trees[lang][1]):
            way, node = way + top, leaf(r, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0)
            for left, other in way:
                node = h(other + node if left else node + other)
            out.append((r.doc_id, leaf(r), trees[lang][0], root, h("".join(x for _, x in way)), node, node == root))
    return sorted(out, key=repr)


def got(docs, **how):
    rows = mm.proofs(mm.manifest(docs, tamper=mm.tampered(), **how))
    return sorted(map(tuple, rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("height", range(9))
def test_layout_has_every_place_once_and_halves_lie_together(height):
    places = [mm.address(height, d, np.arange(1 << d)) for d in range(height + 1)]
    assert sorted(np.concatenate(places)) == list(range((2 << height) - 1))
    top = (height + 1) // 2
    if top:
        assert max(p.max() for p in places[:top]) == (1 << top) - 2, "the top half comes first"
        for first in range(1 << top):  # each bottom half is one stretch
            own = np.concatenate([p[(np.arange(len(p)) >> d) == first] for d, p in enumerate(places[top:])])
            assert sorted(own) == list(range(own.min(), own.min() + len(own)))


@pytest.mark.parametrize("leaves", [1, 2, 3, 5, 8, 13, 16])
def test_blocks_answer_from_their_bytes(leaves):
    held = [h(str(i)) for i in range(leaves)]
    height = (leaves - 1).bit_length()
    nodes, root = mm.build_block(held, height)
    want, ways = run_up(held)
    assert root == want == mm.node_at(nodes, height, 0, 0)
    for i, path in enumerate(mm.siblings(nodes, height, leaves)):
        assert [p[1:] for p in path] == [x for _, x in ways[i]] and mm.fold(mm.node_at(nodes, height, height, i), path) == root


@pytest.mark.parametrize("height", [8, 2])
def test_equal_to_a_plain_tree(spark, height):
    """Seven trees, the largest of 900 leaves: up to five levels of blocks, and two over the languages."""
    rows = [(i, f"text {i}", ("a", "b", None, "ä", "Z", "", "-")[i % 7] if i > 900 else "a", "s", i if i % 11 else None) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert got(docs, height=height) == brute(docs.collect())


def test_hard_and_empty_tables(spark, hard_docs, no_docs):
    assert got(hard_docs) == brute(hard_docs.collect())
    assert got(no_docs) == []
    one = hard_docs.limit(1)
    assert got(one) == brute(one.collect())


def test_one_row_many_times(spark):
    """A third of all rows are null ids with one text: their numbers come from parts that cut them anywhere."""
    rows = [(None, "same", "en", "s", 4)] * 700 + [(i, f"{i}", "en", "s", 4) for i in range(1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8)
    assert got(docs) == brute(docs.collect())
