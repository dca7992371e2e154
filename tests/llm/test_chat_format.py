"""Chats are read back as they were, with their parts, attachments and masks."""

import hashlib
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortgraph.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, body string, turns int"
HARD = [
    None, "", "plain", "<|end|>", "<|turn|>assistant<|says|>x<|end|>", r"<\|end|>", r"<\\|", "<", "<<|", "|>", "[INST]", r"[\/INST] \ [/INST]", "</s><s>", r"<\/s>", "<|part|>", "<|image:0|>", "a\n\nb", "$1 \\2",
    "\U0001f600é́", "[<SYS>", "<" * 50 + "|", "[[INST]", "text ending in <", "text ending in [", "x" * 100_000, "<|says|><|says|>",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: t[:3])
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss))
    return out


def test_hard_texts_and_roles_come_back(spark):
    rows = [(k % 4, k, role, text, "clash", 1) for k, (role, text) in enumerate((r, t) for r in ("user", "assistant", None, "<|says|>") for t in HARD)]
    rows += [(None, None, None, None, None, None), (None, 3, "assistant", "</s>", None, None), (9, None, "user", "first", None, None), (9, 0, "user", "second", None, None), (9, 0, "assistant", "tie", None, None)]
    formatted = cf.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(3)).persist()
    got = {r.conv_id: tuple(r)[1:5] for r in cf.chat_digest(formatted).collect()}
    assert got == brute(rows)
    for r in formatted.collect():  # control strings are the template's alone, and the mask covers every character
        assert r.formatted.count("<|") == r.formatted.count("|>", 0) - sum((t or "").count("|>") + (role or "").count("|>") for c, _, role, t, *_ in rows if c == r.conv_id)
        assert not any(x in r.formatted for x in ("</s>", "<s>", "[INST]", "[/INST]"))
        assert sum(x.chars for x in r.loss_mask) == len(r.formatted)
        at, loss = 0, []
        for x in r.loss_mask:
            if x.learn:
                loss.append(r.formatted[at : at + x.chars])
            at += x.chars
        texts = [t or "" for c, _, role, t, *_ in sorted((x for x in rows if x[0] == r.conv_id and x[2] == "assistant"), key=lambda x: x[1])]
        assert len(loss) == len(texts)


def test_equal_rows_stay(spark):
    rows = [(1, 0, "assistant", "same", None, None)] * 5 + [(1, None, "user", None, None, None)] * 2
    (r,) = cf.chat_digest(cf.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()
    assert tuple(r)[:5] == (1, *brute(rows)[1]) and r.n_turns == 7


def test_no_chats(spark):
    assert cf.chat_digest(cf.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0


P = ("kind", "text", "ref", "width", "height", "seconds", "pages")


def part(kind, **fields):
    return tuple({"kind": kind, **fields}.get(c) for c in P)


PARTS = [
    [part("text", text="see "), part("image", ref="s3://a.png", width=280, height=56), part("text", text="<|image:1|> and"), part("audio", ref="b.wav", seconds=2.5)],
    [part("document", ref="c.pdf", pages=3), part("image", ref="d.png", width=10_000, height=10_000), part("image", ref="e.png")],
    [part("text", text="only\n<|end|>"), part("text", text=None), part("text", text="third")],
    [], None, [part("audio"), part("document"), part("video", text="a kind that is not known is text", ref="x")],
]


def test_typed_parts_keep_order_references_and_tokens(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", parts) for k, parts in enumerate(PARTS)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{cf.PART}>")
    formatted = cf.format_chats(df, parts=F.col("content")).persist()
    (r,) = formatted.collect()
    files = [[(a.n, a.part.kind, a.part.ref, a.tokens) for a in turn] for turn in r.attachments]
    assert files == [
        [(1, "image", "s3://a.png", 20), (3, "audio", "b.wav", math.ceil(2.5 * cf.PER_SECOND))], [(0, "document", "c.pdf", 3 * cf.PER_PAGE), (1, "image", "d.png", cf.MOST_PATCHES), (2, "image", "e.png", 1)], [], [], [],
        [(0, "audio", None, cf.PER_SECOND), (1, "document", None, cf.PER_PAGE)],
    ]
    texts = sum(math.ceil(len(p[1]) / cf.CHARS_PER_TOKEN) for parts in PARTS for p in parts or [] if p[1])
    assert r.tokens == texts + sum(t for turn in files for *_, t in turn)
    assert r.formatted.startswith(r"<|turn|>assistant<|says|>see <|part|><|image:1|><|part|><\|image:1|> and<|part|><|audio:3|><|end|><|turn|>user<|says|><|document:0|><|part|>")
    (back,) = cf.read_chats(formatted).collect()
    want = [[tuple(p) if p[0] in cf.KINDS else part("text", text=p[1] or "") for p in parts or [part("text", text="")]] for parts in PARTS]
    assert [[tuple(p) for p in t.parts] for t in back.turns] == want
    assert [t.learn for t in back.turns] == [True, False] * 3


def test_a_mask_that_does_not_fit_is_told(spark):
    formatted = cf.format_chats(spark.createDataFrame([(1, 0, "assistant", "abc", None, None)], SCHEMA))
    worse = formatted.withColumn("loss_mask", F.transform("loss_mask", lambda x: F.struct((x["chars"] + 1).alias("chars"), x["learn"].alias("learn"))))
    assert cf.read_chats(worse).first().turns[0].learn is None


@pytest.mark.parametrize("text", [x for x in HARD if x])
def test_escaping_is_reversible(spark, text):
    (r,) = spark.createDataFrame([(text,)], "t string").select(cf.escaped(F.col("t")).alias("e"), cf.unescaped(cf.escaped(F.col("t"))).alias("u"), cf.unescaped(cf.escaped(cf.escaped(F.col("t")))).alias("twice")).collect()
    assert r.u == text and r.twice == r.e
