"""Alignment of two tokenizers against a plain count over whole texts."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemark.llm import queries as llm_queries
from lodemark.llm import token_alignment as ta
from lodemark.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, block long, part int, n long, pair long, a string, groups_sha256 string"
FILES = ta.read_tokenizers()
ENCODERS = ta.Encoders(*FILES)
TEXTS = [
    None, "", " ", "  ", "one", "one two  three   four", " lead", "trail ", "a\n b", "a \n b\t\tc", "don't we'll 'tis", "née 漢字漢字 😀 done", "▁ bar", "x▁ y", "<|endoftext|> is text <s> </s> <unk>",
    "aaaa" * 500, "ab" * 3000, "漢字仮名" * 40, "\xa0odd　blanks\x85\x1c end", "0123456789 " * 30, "é ﬁ Ａ", "a\0b", "\r\n\r\n  x", "one two  three   four", "{}();" * 50 + "\n" * 20 + " " * 37 + "z", "= =\n\n = ==  ===",
]


def tokens(text):
    """(ids, ends) of both tokenizers over the whole text, or None."""
    if not text:
        return None
    a = ENCODERS.a.encode(" " + text, add_special_tokens=False).ids
    b = ENCODERS.b.encode(text)
    out = []
    for ids, spelled in ((a, ENCODERS.a_bytes), (b, ENCODERS.b_bytes)):
        parts = [spelled[i] for i in ids]
        if b"".join(parts) != (" " + text).encode():
            return None
        out.append((ids, list(np.cumsum([len(p) for p in parts]))))
    return out


def groups(text):
    got = tokens(text)
    if got is None:
        return None
    (a, a_ends), (b, b_ends) = got
    out, i, j = [], 0, 0
    for cut in sorted(set(a_ends) & set(b_ends)):
        i2, j2 = a_ends.index(cut, i) + 1, b_ends.index(cut, j) + 1
        out.append((a[i:i2], b[j:j2]))
        i, j = i2, j2
    return out


def expected(rows):
    each = [(doc, groups(text)) for doc, text in rows]
    holders = collections.Counter()
    for _, found in each:
        holders.update({(x, y) for a, b in found or [] for x in a for y in b})
    most = collections.Counter()
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    out = []
    for doc, found in each:
        if found is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for a, b in found for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)
        out.append((doc, sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found), len(links), sum(holders[k] == most[k[0]] for k in links), sum(holders[k] for k in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def check(spark, rows, **sizes):
    frame = spark.createDataFrame([(i, t, 1, 2, 3, 4, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    key = lambda r: (r[0] is not None, r[0] or 0, r)
    assert sorted((tuple(r) for r in ta.align(frame, FILES, **sizes).collect()), key=key) == sorted(expected(rows), key=key)


def test_odd_texts_equal_plain_count(spark):
    check(spark, [*enumerate(TEXTS), (5, TEXTS[5]), (None, "null id here"), (None, "null id here")])


def test_small_slices_and_blocks_agree(spark):
    check(spark, list(enumerate(TEXTS)), slice_bytes=40, block_bytes=200)


@pytest.mark.parametrize("wide", [0, 3, ta.WIDE])
def test_wide_groups_count_the_same_links(monkeypatch, wide):
    rows = [t for t in TEXTS if groups(t)]
    monkeypatch.setattr(ta, "WIDE", wide)
    runs, lengths = ta._Runs(ENCODERS), [np.array([len(x) for x in y]) for y in (ENCODERS.a_bytes, ENCODERS.b_bytes)]
    for text in rows:
        laid = (" " + text).encode()
        starts = ta.run_starts(np.frombuffer(laid, np.uint8), np.array([0]))
        numbers = runs.number([laid[s:e] for s, e in zip(starts, [*starts[1:], len(laid)], strict=True)])
        got = ta.Aligned(np.array([len(laid)]), [runs.ids(k, numbers) for k in range(2)], lengths)
        links = collections.Counter((x, y) for a, b in groups(text) for x in a for y in b)
        doc, pair, times = got.pairs()
        assert {(int(p) // ta.SPAN, int(p) % ta.SPAN): int(t) for p, t in zip(pair, times, strict=True)} == links
        assert not doc.any() and got.counts()[3][0] == sum(links.values())


def test_runs_spell_what_whole_texts_do():
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "a", "the", "'s", "É", "\xa0", "▁", "漢", "9", "-", "\t", "Straße", " ", "\x1c", "😀", "ч", "!?"]
    runs = ta._Runs(ENCODERS)
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        laid = (" " + text).encode()
        starts = ta.run_starts(np.frombuffer(laid, np.uint8), np.array([0]))
        numbers = runs.number([laid[s:e] for s, e in zip(starts, [*starts[1:], len(laid)], strict=True)])
        whole = tokens(text)
        assert runs.good[numbers].all() == (whole is not None)
        if whole is not None:
            assert [runs.ids(k, numbers).tolist() for k in range(2)] == [ids for ids, _ in whole]


def test_runs_encoded_together_give_what_each_gives_alone(monkeypatch):
    rng = random.Random(6)
    parts = ["a", "the", "'s", "É", "\xa0", "▁", "漢", "9", "-", "\t", "Straße", "\x1c", "😀", "ч", "!?", "\n", " "]
    odd = [" " + "".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(500)]
    runs = [r.encode() for r in dict.fromkeys([f" w{k}" for k in range(640)] + odd)]
    alone = [tokens(r.decode()[1:]) if len(r) > 1 else None for r in runs]
    for step in (7, ta.STEP):
        monkeypatch.setattr(ta, "STEP", step)
        good, flat, sizes = ENCODERS.encode(runs)
        assert good.tolist() == [x is not None for x in alone]
        for k in range(2):
            ends = np.cumsum(sizes[k])
            assert [flat[k][e - n : e].tolist() for e, n in zip(ends, sizes[k], strict=True)] == [x[k][0] if x else [] for x in alone]
    handed = []

    class Told:
        def encode_batch_fast(self, texts, **how):
            handed.extend(texts)
            return own.encode_batch_fast(texts, **how)

    own = ENCODERS.a
    monkeypatch.setattr(ENCODERS, "a", Told())
    ENCODERS.encode(runs[:640])
    assert "".join(handed).encode() == b"".join(runs[:640]) and len(handed) <= 640 // ta.JOINED
    assert [x.tolist() for x in ENCODERS.encode([])[1]] == [[], []]


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    got = sorted(tuple(r) for r in llm_queries.op12_token_alignment(spark, SF).collect())
    assert got == sorted(expected(rows))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ta.align(empty).collect() == []
    assert ta.align(empty.withColumn("text", F.lit(None).cast("string"))).collect() == []
