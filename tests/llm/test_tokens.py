import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortgraph.llm import packing, text_arrays, tokens, wavelet_shards
from cohortgraph.llm.queries import op3_best_fit_packing, op7_token_output
from cohortgraph.llm.shared import new_path
from cohortgraph.llm.tokens import byte_bpe, vocabulary, word_ids

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
HARD = st.lists(st.sampled_from(list("aZéÉİßẞſKσΣ'sdt.,!? \t\n\x1c\x85\xa0　1²½日\U0001f600́") + ["<|endoftext|>"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(HARD)
def test_ids_equal_the_library(text):
    assert byte_bpe(BYTE).ids(text).tolist() == LIBRARY[BYTE].encode(text, add_special_tokens=False).ids
    assert next(word_ids(WORD).texts(pa.array([text]))).tolist() == LIBRARY[WORD].encode(text, add_special_tokens=False).ids


LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=1500))
def test_wavelet_matrix(ids):
    x = np.array(ids, np.uint32)
    m = wavelet_shards.WaveletMatrix(wavelet_shards.WaveletMatrix.build(x, 9))
    assert m.all().tolist() == ids
    assert m.access(np.arange(len(ids))).tolist() == ids
    for token in [*ids[:3], 301, 5000]:
        assert m.select(token).tolist() == [k for k, v in enumerate(ids) if v == token]
        assert m.rank(token, len(ids) // 2)[0] == ids[: len(ids) // 2].count(token)


def check_files(rows, got):
    start, want = 0, []
    for i, t in rows:
        ids = np.array(LIBRARY[WORD].encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_planes_cost_less_than_parting_by_masks():
    """Making and undoing all planes takes less CPU than masks alone would for the same partings."""
    import time

    def cpu(f):
        times = []
        for _ in range(3):
            t = time.process_time()
            f()
            times.append(time.process_time() - t)
        return min(times)

    ids = np.random.default_rng(0).integers(0, 1 << 16, 1_000_000).astype(np.uint16)
    odd = ids & 1 != 0

    def masks():
        for _ in range(16):
            up = np.empty_like(ids)
            both = np.concatenate((ids[~odd], ids[odd]))
            up[~odd], up[odd] = both[: (~odd).sum()], both[(~odd).sum() :]

    wm = wavelet_shards.WaveletMatrix
    assert cpu(lambda: wm(wm.build(ids, 16)).all()) < cpu(masks)


def test_query_reads_its_files_back(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    check_files(sorted((r.doc_id, r.text) for r in docs.collect()), op7_token_output(spark, d).collect())


def test_shards_of_hard_texts(spark, hard_docs, no_docs):
    path = new_path(spark, "t")
    wavelet_shards.write_shards(hard_docs, path, WORD, shard_tokens=1000)
    shards = wavelet_shards.read_shards(spark, path)
    rows = sorted(((r.doc_id, r.text) for r in hard_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    got = wavelet_shards.documents_of(shards, digest=True)
    check_files(rows, got.collect())
    ids = [x for r in sorted(wavelet_shards.documents_of(shards).collect(), key=lambda r: r.start) for x in r.ids]
    assert sorted(r.position for r in wavelet_shards.token_positions(shards, 2).collect()) == [k for k, v in enumerate(ids) if v == 2]
    assert sum(r.n for r in wavelet_shards.token_counts(shards, 2).collect()) == ids.count(2)
    empty = new_path(spark, "t")
    wavelet_shards.write_shards(no_docs, empty, WORD)
    assert wavelet_shards.documents_of(wavelet_shards.read_shards(spark, empty), digest=True).count() == 0


def check_packed(rows, texts, limit=2048):
    by, seq, bad = {}, {}, []
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in texts:
        ids, at = np.array(LIBRARY[BYTE].encode(t or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            assert r.length == limit or k == 0
            at += r.length
        assert at == len(ids) and len(by[i]) == -(-len(ids) // limit)
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= limit
    return len(seq)


def test_packing_query(spark):
    d = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    rows = op3_best_fit_packing(spark, d).collect()
    total = sum(r.length for r in rows)
    assert check_packed(rows, texts) <= -(-total // 2048) + 1


def test_packing_hard_texts(spark, hard_docs, no_docs):
    unique = hard_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packed(packing.pack(unique, BYTE).collect(), [(r.doc_id, r.text) for r in unique.collect()])
    assert packing.pack(hard_docs, BYTE).where("piece = 0").count() == hard_docs.count()
    assert packing.pack(no_docs, BYTE).count() == 0


def fewest(items, limit):
    """Fewest bins, by trying."""
    best = len(items)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for b in {v: n for n, v in enumerate(bins)}.values():
            if bins[b] + items[k] <= limit:
                go(k + 1, [v + items[k] * (n == b) for n, v in enumerate(bins)])
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_the_optimum(items):
    items = sorted(items, reverse=True)
    counts = {s: items.count(s) for s in set(items)}
    plan = packing.Plan(counts, 20)
    plan.reduce()
    left = sorted((s for s, c in plan.left.items() for _ in range(c)), reverse=True)
    assert plan.sequences + (fewest(left, 20) if left else 0) == fewest(items, 20)
    full = packing.plan_of(counts, 20)
    placed = sorted(s for s, _, m, _, _ in full.runs for _ in range(m))
    assert placed == sorted(items)
    filled = {}
    for s, _, m, q, at in full.runs:
        for k in range(m):
            filled.setdefault(q + k, []).append((at, s))
    for parts in filled.values():
        end = 0
        for at, s in sorted(parts):
            assert at == end
            end += s
        assert end <= 20
    assert set(filled) == set(range(full.sequences))


def test_words_that_collide_under_polynomials_have_their_own_ids():
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2**64 for every base."""
    x = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    text = f"{x} {x.translate(str.maketrans('ab', 'ba'))} {x}"
    (got,) = word_ids(WORD).texts(pa.array([text]))
    assert got.tolist() == LIBRARY[WORD].encode(text, add_special_tokens=False).ids


def test_long_runs_of_white_space():
    """tiktoken's pattern overflows its stack on them; the library's ids count."""
    n = tokens.LONG_BLANK
    for text in ("a" + " " * (n - 1) + "b", "a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "\t" * n, "x " * 9 + "\n\t " * 300_000 + "<|endoftext|>"):
        assert byte_bpe(BYTE).ids(text).tolist() == LIBRARY[BYTE].encode(text, add_special_tokens=False).ids


def test_slices_copy_few_rows_and_give_memory_back(monkeypatch):
    calls, peak = [], []
    monkeypatch.setattr(text_arrays, "give_back", lambda: calls.append(1))
    column = pa.array(["some words of a text " * 20] * 10_000)
    before = pa.total_allocated_bytes()
    for lo, hi, data, offsets in text_arrays.slices(column):
        peak.append(pa.total_allocated_bytes() - before)
        assert offsets[-1] == len(data) == 420 * (hi - lo)
    assert len(calls) == 1 and max(peak) < column.nbytes / 5
