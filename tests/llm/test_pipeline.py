"""The whole pipeline against a plain version of each stage, on the smallest tables."""

import hashlib
import re
from collections import defaultdict

import corpus_pipeline
from cohortgraph.llm import source_mixing
from cohortgraph.llm.shared import table
from test_ngram_join import brute as components
from test_quality_rules import WORD, verdict

DIR = "/root/testdata/sf0.001"


def distinct_texts(rows):
    """Of texts equal without white space the longest, then the smallest id."""
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub("[\\x20\\x09-\\x0D]", "", r.text or "")].append(r)
    return [min(g, key=lambda r: (-len(r.text or ""), r.doc_id)) for g in groups.values()]


def one_of_each(rows):
    root = components([(r.doc_id, r.text) for r in rows], 5, 80)
    return [r for r in rows if root[r.doc_id][1] == r.doc_id]


def topic(text):
    n = max(len(text), 1)
    share = lambda letters: sum(text.count(c) for c in letters) / n
    for name, letters, most in (("symbols", "#*$%&<>{}=", 0.02), ("tables", "|", 0.02), ("numbers", "0123456789", 0.05), ("capitals", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.3)):
        if share(letters) > most:
            return name
    return "prose"


def mixed(rows, share):
    cells = defaultdict(float)
    cell = {r.doc_id: (r.source or "?", r.lang or "?", topic(r.text or "")) for r in rows}
    for r in rows:
        cells[cell[r.doc_id]] += max(len(WORD.findall(r.text or "")), 1)
    goals = []
    for k in range(3):
        sums = defaultdict(float)
        for c, n in cells.items():
            sums[c[k]] += n
        tempered = {v: n**0.7 for v, n in sums.items()}
        whole = sum(tempered.values())
        named = {v: x for v, x in source_mixing.LANG_TARGETS.items() if v in sums} if k == 1 else {}
        part = sum(tempered[v] for v in named) / whole
        goals.append({v: named[v] / sum(named.values()) * part if v in named else tempered[v] / whole for v in sums})
    w = dict(cells)
    for _ in range(source_mixing.ROUNDS):
        for k, goal in enumerate(goals):
            sums = defaultdict(float)
            for c, x in w.items():
                sums[c[k]] += x
            w = {c: x * goal[c[k]] / sums[c[k]] for c, x in w.items()}
    whole = sum(w.values())
    w, budget = {c: x / whole for c, x in w.items()}, share * sum(cells.values())
    open_w, full = 1.0, 0.0
    for _ in range(source_mixing.CAP_ROUNDS):
        p = {c: max(budget - full, 0) * w[c] / (open_w * cells[c]) if open_w else 0.0 for c in cells}
        open_w, full = sum(w[c] for c in cells if p[c] < 1), sum(cells[c] for c in cells if p[c] >= 1)
    p = {c: round(min(max(budget - full, 0) * w[c] / (open_w * cells[c]), 1) if open_w else 0.0, 6) for c in cells}
    drawn = lambda i: int(hashlib.md5(f"1|{i}".encode()).hexdigest()[:12], 16) / (1 << 48)
    return [r for r in rows if drawn(r.doc_id) < p[cell[r.doc_id]]]


def test_every_stage_equals_its_plain_version(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = docs.collect()
    plain = [
        lambda rows: [r for r in rows if verdict(r.text, r.lang) is None], distinct_texts, one_of_each, lambda rows: mixed(rows, corpus_pipeline.MIXED_SHARE),
    ]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], plain):
        docs, rows = table(stage(spark, docs, DIR), "test"), want(rows)
        assert sorted(map(tuple, docs.collect()), key=repr) == sorted(map(tuple, rows), key=repr), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()
    from tokenizers import Tokenizer

    from cohortgraph.llm.tokens import vocabulary

    full = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert {r.doc_id for r in pieces} == {r.doc_id for r in rows}
    for r in rows:
        own = sorted((p for p in pieces if p.doc_id == r.doc_id), key=lambda p: p.piece)
        assert sum(p.length for p in own) == len(full.encode(r.text or "", add_special_tokens=False).ids) + 1
    filled = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert filled[p.sequence_id] == p.offset
        filled[p.sequence_id] += p.length
    assert max(filled.values()) <= 2048


def test_stages_take_hard_and_empty_tables(spark, hard_docs, no_docs):
    """Null ids and texts, repeats, blanks, clashing columns; and no rows at all."""
    for docs in (hard_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = table(stage(spark, docs, DIR), "test")
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
            assert out.count() <= docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count()
