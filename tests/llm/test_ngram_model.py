"""The n-gram model against counts in plain dictionaries."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from lodemark.llm import ngram_model as lm
from lodemark.llm import queries as llm_queries
from lodemark.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, block long, shard int, n long, hot string, level string, held string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "\n"]


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0


class Plain:
    """Modified Kneser-Ney of any order from dictionaries."""

    def __init__(self, texts, order):
        self.order, raw = order, collections.Counter()
        self.once = collections.Counter()
        for text in texts:
            line = ["\t"] * (order - 1) + tokens(text)
            self.once.update(line[order - 1 :])
            raw.update(tuple(line[i - order + 1 : i + 1]) for i in range(order - 1, len(line)))
        self.counts = {order: raw}
        for k in range(order - 1, 0, -1):
            longer = set(raw) if k == order - 1 else {g[-k - 1 :] for g in raw}
            self.counts[k] = collections.Counter(g[1:] for g in longer)
        self.discounts, self.sums = {}, {}
        for k, c in self.counts.items():
            n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if min(n) else 0
            self.discounts[k] = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0), i) for i in (1, 2, 3)] if min(n) else [0.5, 1, 1.5]
            self.sums[k] = collections.defaultdict(lambda: [0, 0, 0, 0])
            for g, v in c.items():
                s = self.sums[k][g[:-1]]
                s[0] += v
                s[min(v, 3)] += 1

    def p(self, gram):
        if not gram:
            return 1 / (len(self.once) + 1)
        k, below = len(gram), self.p(gram[1:])
        total, *kinds = self.sums[k].get(gram[:-1], [0, 0, 0, 0])
        if not total:
            return below
        d, c = self.discounts[k], self.counts[k].get(gram, 0)
        return (max(c - d[min(c, 3) - 1], 0) if c else 0) / total + sum(x * n for x, n in zip(d, kinds, strict=True)) / total * below

    def row(self, text):
        words = tokens(text)
        line = ["\t"] * (self.order - 1) + words
        score = sum(math.log10(self.p(tuple(line[i : i + self.order]))) for i in range(len(words)))
        n = sum(self.once.values())
        base = sum(math.log10((self.once[w] + 0.1) / (n + 0.1 * (len(self.once) + 1))) for w in words)
        return len(words), sum(self.once[w] > 0 for w in words), n, base, score


def check(spark, rows, order, **sizes):
    frame = spark.createDataFrame([(i, t, 1, 2, 3, "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)
    got = collections.Counter()
    plain = Plain([t for i, t in rows if not held(i)], order)
    for r in lm.perplexity(frame, order, **sizes).collect():
        text = next(t for i, t in rows if i == r["doc_id"])
        assert r["held_out"] == held(r["doc_id"])
        n, known, total, base, score = plain.row(text)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9) and r["score"] == pytest.approx(score, rel=1e-9, abs=1e-9)
        assert r["perplexity"] == pytest.approx(10 ** (-score / n))
        got[r["doc_id"]] += 1
    assert got == collections.Counter(i for i, _ in rows)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)] + ["The", "THE", "É", "é", "x\x85y", "\xa0"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    copies = [(n + i, rows[i][1]) for i in range(0, n, 4)]
    return [*rows, *copies, (1000, None), (1001, ""), (1002, " \t\n "), (1003, "long " * 5000), (1004, "x" * 9000), (None, "no id here"), (7, rows[7][1])]


@pytest.mark.parametrize("order, sizes", [(2, {"block_tokens": 300, "shard_tokens": 700, "hot": 0.02}), (2, {"hot": 0.5}), (3, {"block_tokens": 500, "shard_tokens": 400, "hot": 0.01}), (4, {})])
def test_scores_equal_plain_counts(spark, order, sizes):
    check(spark, corpus(order, 120), order, **sizes)


def test_few_rows(spark):
    check(spark, [(1, "a b a"), (2, None)], 2)
    check(spark, [(i, "never trained") for i in range(200) if held(i)], 2)
    assert lm.perplexity(spark.createDataFrame([], SCHEMA)).collect() == []


def test_probabilities_sum_to_one():
    plain = Plain([t for _, t in corpus(5, 40)], 3)
    for context in (("\t", "\t"), ("the", "w1"), ("w1", "w2"), ("never", "seen")):
        assert sum(plain.p((*context, w)) for w in plain.once) + plain.p((*context, "?")) == pytest.approx(1)


def test_numbers_survive_packing():
    x = np.array([0, 1, 255, 256, 2**39, 2**40 - 1], np.uint64)
    assert lm.unpacked(lm.packed(x, 5), 5).tolist() == x.tolist()


def test_query_beats_single_words(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    plain = Plain([t for i, t in rows if not held(i)], 2)
    got = llm_queries.op11_lm_scoring(spark, SF).collect()
    texts = dict(rows)
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        n, known, total, base, score = plain.row(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
