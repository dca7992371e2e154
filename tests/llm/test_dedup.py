import hashlib
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa

from cohortgraph.llm import exact_dedup, line_dedup

SPACE = " \t\n\x0b\x0c\r"


def test_exact_groups(spark, hard_docs):
    extra = [(200 + i, t) for i, t in enumerate(["Two  words", "Twowords", "Two\twords ", "two words", "Two   words"])]
    docs = hard_docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    groups = defaultdict(list)
    for r in docs.collect():
        t = r.text or ""
        groups[t.translate({ord(c): None for c in SPACE})].append((-len(t), r.doc_id is None, r.doc_id or 0, r.doc_id))
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == docs.count()
    by = {k: (min(g)[3], len(g)) for k, g in groups.items()}
    want = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in by.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
        assert r.kept == (r.doc_id == r.keep_id)
    assert exact_dedup.drop_copies(hard_docs).columns == hard_docs.columns


def test_exact_groups_of_one_hot_text(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same text', concat('text ', id)) AS text")
    got = exact_dedup.exact_groups(docs)
    assert got.where("group_size = 1000 and keep_id = 0").count() == 1000
    assert got.where("kept").count() == 2001


def test_exact_groups_of_nothing(spark, no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))


def lines_brute(rows, min_docs):
    seen = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            seen[key(line)].add((i, t or ""))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(seen[key(x)]) < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def digest(docs, **how):
    got = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, **how), digest=True)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_lines_on_hard_texts(spark, hard_docs):
    rows = [(r.doc_id, r.text) for r in hard_docs.collect()]
    assert digest(hard_docs, min_docs=2) == lines_brute(rows, 2)


def test_lines_on_a_hot_line(spark):
    rows = [(i, f"Common LINE\nown {i}\n common line \nshared {i // 12}\n\nrare {i // 5}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert digest(docs) == lines_brute(rows, 10)


def test_a_line_written_out_early_is_counted_whole(monkeypatch):
    """One partition with lines 1, 2 (long, begins and ends inside it) and 3; line 2 is written out in parts."""
    monkeypatch.setattr(line_dedup, "_LONG", 10)
    for n, times in ((25, 1), (31, 1), (25, 3), (9, 2)):
        rows = [(1, 0, 7, 7, 0, 0)] + [(2, 0, d, d, d, p) for d in range(n) for p in range(times)] + [(3, 0, 8, 8, 0, 0)]
        names = ["h1", "h2", "id", "k1", "k2", "pos"]
        whole = pa.table({c: pa.array([r[k] for r in rows], pa.int32() if c == "pos" else pa.int64()) for k, c in enumerate(names)})
        found = [x for b in line_dedup._scan(10, False)(whole.to_batches(max_chunksize=6)) for x in b.to_pylist()]
        long = [x for x in found if x["h1"] == 2]
        met = {(x["k1"], x["k2"]) for x in long if x["edge"]}
        gone = {(x["k1"], x["pos"]) for x in long if not x["edge"] or len(met) >= 10}
        assert gone == ({(d, p) for d in range(n) for p in range(times)} if n >= 10 else set())


def test_first_occurrence_can_stay(spark):
    rows = [(i, f"x {i}\nsame\nsame") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    maps = line_dedup.keep_bitmaps(docs, min_docs=10, keep_first=True)
    got = {r.doc_id: r.kept_text for r in line_dedup.apply_bitmaps(docs, maps).collect()}
    assert got[0] == "x 0\nsame" and all(got[i] == f"x {i}" for i in range(1, 20))


def test_first_occurrence_of_a_line_written_out_early_can_stay(spark, monkeypatch):
    rows = [(i, f"x {i}\nsame\nsame") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    maps = line_dedup.keep_bitmaps(docs, min_docs=10, keep_first=True)
    got = {r.doc_id: r.kept_text for r in line_dedup.apply_bitmaps(docs, maps).collect()}
    assert got[0] == "x 0\nsame" and all(got[i] == f"x {i}" for i in range(1, 60))


def test_one_long_document_costs_what_many_short_ones_do():
    """Two million equal lines, of one document and spread over many."""
    n, names = 2_000_000, ["h1", "h2", "id", "k1", "k2", "pos"]
    took = []
    for docs in (n // 10, 1):
        d = np.arange(n) // (n // docs)
        whole = pa.table(dict(zip(names, [np.ones(n, np.int64), np.ones(n, np.int64), d, d, d, (np.arange(n) % (n // docs)).astype(np.int32)])))
        start, found = time.time(), 0
        for b in line_dedup._scan(10, False)(whole.to_batches(max_chunksize=10_000)):
            found += sum(b.column("edge").to_pylist()) if b.num_rows < 10 else b.num_rows
        took.append(time.time() - start)
        assert found == n
    assert took[1] < 2 * took[0] + 1


def test_lines_of_nothing(spark, no_docs):
    assert digest(no_docs) == []
