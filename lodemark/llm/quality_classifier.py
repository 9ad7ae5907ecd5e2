"""Quality classifier: a support vector machine over naive Bayes features.

A text becomes a set of hashed n-gram indicators: words and runs of signs, their pairs, and
a few banded shape indicators (length, repeated lines and words). Each is scaled by the
log-count ratio of its class, as naive Bayes has it, and the scaled vectors of unit length
train a linear hinge-loss model by dual coordinate descent. Margins become scores by a
logistic fit on rows that the model has not seen.

Fitting uses at most SAMPLE labelled rows of the training folds; every whole text is scored.

Defined results: a null or empty text has only shape indicators and is scored like any
other. Labels other than 0 and 1 are left out. Of training rows that share an id the first by their texts' md5
counts. Without labels of both classes all scores are the share of label 1 (0.5 without any).
Repeated rows get equal scores.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import fold, labelled_sample, one_each, small_batches

SAMPLE, BITS, THRESHOLD = 6000, 18, 0.3
#: Rows whose crc32 of the id leaves 0 by FOLDS are held out.
FOLDS = 5
REMEMBERED = 300_000
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


class _Ids(dict):
    def __missing__(self, token: str) -> int:
        n = zlib.crc32(token.encode()) & 0x7FFFFFFF
        if len(token) <= 64 and len(self) < REMEMBERED:
            self[token] = n
        return n


def features(text: str, ids: dict) -> np.ndarray:
    """The sorted distinct indicators of a whole text, below 2 ** BITS."""
    tokens = TOKEN.findall(text.lower())
    one = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    distinct = len(set(tokens))
    shape = [
        f"length {min(16, len(tokens).bit_length())}",
        f"lines {int(10 * (len(lines) - len(set(lines))) / max(1, len(lines)))}",
        f"distinct {int(10 * distinct / max(1, len(tokens)))} {len(tokens).bit_length() // 3}",
        f"width {min(20, len(tokens) // max(1, len(lines)) // 3)}",
    ]
    own = np.array([ids["\0" + s] for s in shape], np.int64)
    pairs = one[:-1] * 1_000_003 + one[1:] * 31 + 7
    both = np.concatenate([one * 2_654_435_761 >> 7, pairs ^ (pairs >> 19), own * 40_503 + 5])
    return np.unique(both & ((1 << BITS) - 1)).astype(np.int32)


def train(sets: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float, float, float, np.ndarray]:
    """Weights, bias, the logistic a and b, and the log-count ratios."""
    up, down = int((y == 1).sum()), int((y == 0).sum())
    if not up or not down:
        p = min(max(up / (up + down), 1e-3), 1 - 1e-3) if up + down else 0.5
        return np.zeros(1 << BITS), 0.0, 1.0, float(np.log(p / (1 - p))), np.zeros(1 << BITS)
    test = np.arange(len(y)) % 4 == 3
    if len(set(y[test])) < 2:
        test[:] = False
    counts = np.ones((2, 1 << BITS))
    for k, label in zip((s for s, t in zip(sets, test, strict=True) if not t), y[~test], strict=True):
        counts[int(label), k] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    rows = [_scaled(s, ratio) for s in sets]
    fit_rows = [r for r, t in zip(rows, test, strict=True) if not t]
    fit_y = np.where(y[~test] == 1, 1.0, -1.0)
    w = linear.fit(fit_rows, fit_y, 1 << BITS, np.where(fit_y > 0, 1.0, min(8.0, max(1.0, up / down))))
    checked = test if test.any() else ~test
    a, b = linear.calibrate(linear.scores([r for r, t in zip(rows, checked, strict=True) if t], w), y[checked])
    return w[:-1], float(w[-1]), a, b, ratio


def _scaled(indicators: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = ratio[indicators]
    return indicators, v / max(1e-9, float(np.sqrt(v @ v)))


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE):
    sample = labelled_sample(docs, labels, "quality", bound, keep=lambda i: fold(i, FOLDS) != 0)
    rows = one_each(docs.select("doc_id", "text"), sample).select("doc_id", "text", "label")

    def read(batches):
        ids = _Ids()
        for b in batches:
            sets = [features(t or "", ids).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sets, pa.list_(pa.int32()))], ["doc_id", "label", "k"])

    got = rows.mapInArrow(read, "doc_id bigint, label int, k array<int>").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    return train([np.asarray(k, np.int32) for k in got["k"]], got["label"].to_numpy())


def classify(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, bound))

    def score(batches):
        w, bias, a, b, ratio = model.value
        scaled, ids = ratio * w, _Ids()
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                k = features(text or "", ids)
                v = ratio[k]
                margin = float(scaled[k].sum()) / max(1e-9, float(np.sqrt(v @ v))) + bias
                out.append(1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30))))
            s = np.array(out, float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(score, SCHEMA)
