"""Language identification in two steps: the family first, then the language within it.

A text is a vector of hashed letter trigrams, of unit length. One linear support vector
machine for each family against the others chooses the family; within it, one machine for
each pair of its languages votes, and margins break ties. All are fitted by dual coordinate
descent on at most SAMPLE rows of the training folds; every whole text is scored.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing
could be learned. A language outside FAMILIES is a family of its own. Equal votes and
margins go to the alphabetically first language. Repeated rows get equal results. Of training
rows that share an id the first by language, then by its text's md5, counts.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import fold, md5_long, one_each, small_batches

SAMPLE, DIM = 2000, 4096
#: Rows whose crc32 of the id leaves HELD_OUT by FOLDS are held out.
FOLDS, HELD_OUT = 4, 2
# Language families.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
}
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"
#: Characters in one step, so that a very long text needs little memory.
STEP = 1 << 20


def family(lang: str) -> str:
    return next((k for k, v in FAMILIES.items() if lang in v), lang)


def vector(text: str) -> np.ndarray | None:
    """Trigram counts of the letters of a whole text, of unit length; None without a letter."""
    counts, tail, any_letter = np.zeros(DIM), " ", False
    for at in range(0, len(text), STEP):
        piece = text[at : at + STEP].lower()
        points = np.frombuffer((tail + piece + (" " if at + STEP >= len(text) else "")).encode("utf-32-le", "replace"), np.uint32)
        letters = _is_letter(points)
        any_letter = any_letter or bool(letters.any())
        points = np.where(letters, points, 32).astype(np.int64)
        points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
        if len(points) > 2:
            hashed = points[:-2] * 7_368_787 + points[1:-1] * 91_193 + points[2:] * 31
            counts += np.bincount((hashed ^ (hashed >> 13)) & (DIM - 1), minlength=DIM)
        tail = "".join(map(chr, points[-2:]))
    if not any_letter:
        return None
    counts = np.sqrt(counts)
    return counts / max(1e-12, float(np.linalg.norm(counts)))


_TABLE = np.zeros(0, bool)


def _is_letter(points: np.ndarray) -> np.ndarray:
    global _TABLE
    if not len(_TABLE):
        _TABLE = np.fromiter((chr(i).isalpha() for i in range(0x3000)), bool, 0x3000)
    out = _TABLE[np.minimum(points, 0x2FFF)]
    for i in np.flatnonzero(points >= 0x3000):
        out[i] = chr(points[i]).isalpha()
    return out


def train(vectors: np.ndarray, langs: list[str]):
    """{family: weights}, {(a, b): weights, positive for a}, {family: languages}."""
    rows = [(np.flatnonzero(v), v[np.flatnonzero(v)]) for v in vectors]
    families = np.array([family(x) for x in langs])
    members = {f: sorted({x for x in langs if family(x) == f}) for f in sorted(set(families))}
    cost = lambda y: np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y <= 0).sum())) * 10
    top, pairs = {}, {}
    if len(members) > 1:
        for f in members:
            y = np.where(families == f, 1.0, -1.0)
            top[f] = linear.fit(rows, y, DIM, cost(y))
    for own in members.values():
        for a, b in combinations(own, 2):
            chosen = [i for i, x in enumerate(langs) if x in (a, b)]
            y = np.array([1.0 if langs[i] == a else -1.0 for i in chosen])
            pairs[a, b] = linear.fit([rows[i] for i in chosen], y, DIM, cost(y))
    return top, pairs, members


def fit(docs: DataFrame, bound: int = SAMPLE):
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    ids = rows.select("doc_id").distinct().orderBy(md5_long(F.col("doc_id")), "doc_id").limit(bound)
    rows = one_each(rows.select("doc_id", "lang", "text"), ids, F.col("lang")).select("doc_id", "lang", "text")

    def read(batches):
        for b in batches:
            for i, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (v := vector(text or "")) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([lang]), pa.array([v.astype(np.float32).tobytes()], pa.binary())], ["doc_id", "lang", "v"])

    got = rows.mapInArrow(read, "doc_id bigint, lang string, v binary").toPandas().sort_values("doc_id", kind="stable")
    if not len(got):
        return {}, {}, {}
    return train(np.stack([np.frombuffer(v, np.float32) for v in got["v"]]).astype(float), list(got["lang"]))


def predict(v: np.ndarray | None, model) -> tuple[str, float]:
    top, pairs, members = model
    if v is None or not members:
        return "und", 0.0
    sure = lambda m: float(1 / (1 + np.exp(-np.clip(2 * m, -30, 30))))
    margins = {f: float(w[:-1] @ v) + w[-1] for f, w in top.items()} or dict.fromkeys(members, 30.0)
    best = min(margins, key=lambda f: (-margins[f], f))
    score, own = sure(margins[best]), members[best]
    votes = {x: [0, 0.0] for x in own}
    for a, b in combinations(own, 2):
        m = float(pairs[a, b][:-1] @ v) + pairs[a, b][-1]
        for x, s in ((a, m), (b, -m)):
            votes[x][0] += s > 0
            votes[x][1] += s
    lang = min(own, key=lambda x: (-votes[x][0], -votes[x][1], x))
    return lang, score * (sure(votes[lang][1] / (len(own) - 1)) if len(own) > 1 else 1.0)


def identify(docs: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, bound))

    def read(batches):
        for b in batches:
            found = [predict(vector(t) if t is not None else None, shared.value) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(read, SCHEMA)
