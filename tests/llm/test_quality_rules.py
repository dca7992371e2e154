import functools
import math
import random
import re
from collections import Counter

import pytest

from cohortgraph.llm import quality_rules
from cohortgraph.llm.queries import op2_quality_rules
from cohortgraph.llm.tokens import vocabulary
from paragraphs import PARAGRAPHS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES, WORDS, MANY = vocabulary("piece_bpe_32k.model"), vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_multi_50k.tiktoken")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(runs)
    covered = {k for i, r in enumerate(runs) if times[r] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def rows_of(df):
    return [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()]


def key(r):
    return (r[0] is None, r)


def test_counts_on_hard_texts(spark, hard_docs):
    got = rows_of(quality_rules.quality(hard_docs, PIECES, WORDS))
    want = [(r.doc_id, *brute(r.text)) for r in hard_docs.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    got = op2_quality_rules(spark, d)
    texts = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert sorted(rows_of(got)) == sorted((r.doc_id, *brute(r.text)) for r in texts)
    assert all(not r.kept for r in got.collect() if r.base_failed)


def test_rates_and_bands(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    prose = re.__doc__  # English
    odd = " ".join("ሀሁሂ" for _ in range(60))
    docs = spark.createDataFrame([(1, prose, "en"), (2, odd, None), (3, "the and " * 100, "xx")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.quality(docs, PIECES, WORDS, most_repeated=100).collect()}
    for i, t in ((1, prose), (2, odd)):
        ids = [x for w in t.split() for x in model.encode(w)]
        assert got[i].chars_per_token == pytest.approx(sum(map(len, t.split())) / len(ids))
        assert got[i].byte_share == pytest.approx(sum(model.is_byte(x) for x in ids) / len(ids))
    assert got[1].reason is None, got[1]
    assert got[3].reason == "entropy" and got[2].latin_share == 0


def test_bands_part_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    judged = op2_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").select("quality", "kept").collect()
    good, bad = [r.kept for r in judged if r.quality], [r.kept for r in judged if not r.quality]
    assert all(good) and sum(bad) <= 0.4 * len(bad)


@functools.lru_cache
def _encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    model, full = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(WORDS)
    return (lambda w: model.encode(w)), (lambda w: full.encode(w, add_special_tokens=False).ids), model.is_byte


def verdict(text, lang):
    """The first reason, or None: rates from the two libraries' own encoders, words one by one, and the bands written out."""
    *encoders, is_byte = _encoders()
    words = WORD.findall(text or "")
    chars, found = sum(map(len, words)), {"base"} if brute(text)[-1] else set()
    limits = quality_rules.BANDS[lang]
    for k, encode in enumerate(encoders):
        ids = [x for w in words for x in encode(w)]
        n, b = max(len(ids), 1), limits[1 + k]
        found |= {"dense"} if chars / n < b.least - max(b.spread / math.sqrt(n), quality_rules.APART) else set()
        found |= {"sparse"} if chars / n > b.most else set()
        found |= {"bytes"} if k == 0 and sum(map(is_byte, ids)) / n > limits[0] else set()
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
        found |= {"entropy"} if entropy < min(b.base + b.slope * math.log2(n), 0.8 * math.log2(n)) else set()
    return next((x for x in ("base", "dense", "sparse", "bytes", "entropy") if x in found), None)


def test_verdict_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.reason, r.kept) for r in op2_quality_rules(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        reason = verdict(r.text, r.lang)
        assert got[r.doc_id] == (reason, reason is None), r.doc_id


def test_words_that_collide_under_polynomials(spark):
    x = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    rows = [(1, " ".join([x, *"bcdefgh"] + [x.translate(str.maketrans("ab", "ba")), *"bcdefgh"]))]
    got = rows_of(quality_rules.quality(spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string"), PIECES, WORDS))
    assert got[0][5] == brute(rows[0][1])[4] == 0


def test_empty_and_filter(spark, no_docs, hard_docs):
    assert quality_rules.quality(no_docs, PIECES, WORDS, WORDS).count() == 0
    kept = quality_rules.keep_good(hard_docs, PIECES, WORDS)
    assert kept.columns == hard_docs.columns


#: Letters of which random words are made, by script; Han, kana and hangul have words of five to ten.
ALPHABETS = {
    "latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "hebrew": "אבגדהוזחטיכלמנסעפצקרשת", "arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "devanagari": "अआइईउऊएऐओऔकखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह", "thai": "กขคฆงจฉชซญดตถทธนบปผฝพฟภมยรลวสหอฮ", "han": [chr(c) for c in range(0x4E00, 0x9FA5)], "kana": [chr(c) for c in range(0x3041, 0x3097)], "hangul": [chr(c) for c in range(0xAC00, 0xD7A3)],
}


def test_texts_are_sent_once(spark):
    """A string column is judged inside the row, others are cast beside it; batches of several runs of rows lose none."""
    text = "the weather in the north was mild and the people of the town were glad to walk along the river in the evening light"
    rows = [(i, text if i % 3 else "too short", b"en") for i in range(5_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang binary").coalesce(1)
    for frame, sent in ((docs.withColumn("lang", docs.lang.cast("string")), 1), (docs, 2)):
        kept = quality_rules.keep_good(frame, PIECES, WORDS)
        assert kept._jdf.queryExecution().analyzed().children().head().output().size() == sent
        assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(5_000) if i % 3]


def test_random_letters_go_and_paragraphs_stay(spark):
    """Paragraphs of 22 languages, random words of ten scripts, with and without a language."""
    rng = random.Random(5)
    rows, noise = [], {}
    for k, text in PARAGRAPHS.items():
        step = len(text) // 21  # enough words for the base rule, where there are no spaces
        spaced = text if len(text.split()) >= 20 else " ".join(text[i : i + step] for i in range(0, len(text), step))
        rows += [(spaced, k), (spaced, None)]
    good = len(rows)
    for name, letters in ALPHABETS.items():
        for words in (100, 300, 2000):
            for lo, hi in ((2, 6), (4, 9)) if name not in ("han", "kana", "hangul") else ((5, 10),):
                text = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(lo, hi))) for _ in range(words))
                for lang in (None, "xx", "it"):
                    noise[len(rows)] = (name, words, lo)
                    rows.append((text, lang))
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.quality(docs, PIECES, WORDS, MANY).collect()}
    assert [(rows[i][1], rows[i][0][:20], got[i].reason, got[i].chars_per_many_token) for i in range(good) if not got[i].kept] == []
    assert [(noise[i], got[i].chars_per_many_token) for i in noise if got[i].kept] == []
    kept = {r.doc_id for r in quality_rules.keep_good(docs, PIECES, WORDS, MANY).collect()}
    assert kept == {i for i in got if got[i].kept}


def test_scripts():
    for text, name in (("Ab c 12", "latin"), ("漢字かな交じり", "kana"), ("漢字", "han"), ("ሀሁሂ abc ሀሁሂሃሄህሆ ሀሁሂሃ", "other"), ("", "other"), ("123 456 ,.", "other"), ("Слово word слово", "cyrillic")):
        assert quality_rules.script_of(text) == name, text
