"""Personal data: fixed base patterns and a semi-Markov conditional random field.

The base patterns give e-mail addresses, IP addresses, cards and phones. The field adds
spans that no pattern fixes: phones without a country code (``tel``), IBANs (``iban``),
social security numbers (``ssn``) and spelled-out addresses (``mail``). It scores whole
segments of up to MAX_TOKENS tokens by features of the segment (shape, checksums, the word
before), and a dynamic program over segment ends chooses boundaries and types together.
Tokens of base spans are taken, so added spans never overlap them. Tokens far from a digit or
an at-sign cannot be in an entity, so the program runs over the islands around those, each in
time linear in its length. The weights are fitted on sentences generated from a fixed seed.

Defined results: a null text counts as empty; the digest is then that of an empty string.
Positions are code points, ends exclusive. Repeated rows repeat. In :func:`mask` a null text
stays null.
"""

from __future__ import annotations

import hashlib
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ["email", "ip", "card", "phone"]
ADDED = ["tel", "iban", "ssn", "mail"]
MAX_TOKENS = 9
#: Of equal scores the segmentation that covers more tokens wins.
TIE = 1e-9

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _emails(text: str):
    """The matches of the e-mail pattern, found from each at-sign so that no run is read twice."""
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            at = free = found.end()
        else:
            at += 1
            free = at


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all base spans, in order."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_TOKEN = re.compile(r"\S+")
_TRIGGER = re.compile(r"[0-9]|[\[(]at[\])]", re.I)
_EDGE = ".,;:!?\"'<>"
_SHAPES = {
    "shape ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "shape area": re.compile(r"\(0?[0-9]{2,4}\)[\x20-]?[0-9]{3}[\x20.-]?[0-9]{4}"),
    "shape local": re.compile(r"[2-9][0-9]{2}([.\x20-])[0-9]{3}\1[0-9]{4}"),
    "shape iban": re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?"),
    "shape mail": re.compile(r"[\w.+-]+ ?[\[(]at[\])] ?[\w-]+(?: ?(?:[\[(]dot[\])]|\.) ?[\w-]+)+", re.I),
}
_CUES = {
    "cue tel": re.compile(r"(?:tel|tél|phone|mobile|call|fax|telefon|teléfono|fon)\W*$", re.I),
    "cue iban": re.compile(r"(?:iban|account|konto|compte|cuenta)\W*$", re.I),
    "cue ssn": re.compile(r"(?:ssn|security)\W*$", re.I),
    "cue mail": re.compile(r"(?:e?-?mail|contact|write)\W*$", re.I),
}


def iban_valid(text: str) -> bool:
    packed = text.replace(" ", "").upper()
    if not 15 <= len(packed) <= 34 or not packed.isascii() or not packed.isalnum():
        return False
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def segment_features(span: str, before: str, tokens: int) -> list[str]:
    """Features of a whole candidate segment and of the token before it."""
    out = [f"tokens {min(tokens, 4)}", "any"]
    shapes = [k for k, p in _SHAPES.items() if p.fullmatch(span)]
    out += shapes or ["shapeless"]
    out += [k for k, p in _CUES.items() if p.search(before)]
    digits = sum(c.isdigit() for c in span)
    out.append(f"digits {min(digits, 17) // 3}")
    if "shape iban" in shapes:
        out.append("iban valid" if iban_valid(span) else "iban wrong")
    if any(c.isalpha() for c in span):
        out.append("letters")
    return out


class SemiMarkov:
    """Weights of (type, feature); leaving a token out scores 0."""

    def __init__(self):
        self.w: dict[tuple[str, str], float] = {}

    def segments(self, text: str, tokens: list[tuple[int, int]], taken) -> list[list]:
        """For each end: (start token, first and last place, features) of the segments there."""
        out: list[list] = [[] for _ in range(len(tokens) + 1)]
        for i in range(len(tokens)):
            for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
                if taken(*tokens[j - 1]):
                    break
                a, b = tokens[i][0], tokens[j - 1][1]
                while a < b and text[a] in _EDGE:
                    a += 1
                while b > a and text[b - 1] in _EDGE:
                    b -= 1
                span = text[a:b]
                if not _TRIGGER.search(span):
                    continue
                out[j].append((i, a, b, segment_features(span, text[max(0, a - 14) : a], j - i)))
        return out

    def score(self, kind: str, features: list[str]) -> float:
        w = self.w
        return sum(w.get((kind, f), 0.0) for f in features)

    def best(self, ends: list[list]) -> list[tuple[int, str, int]]:
        """Viterbi over segment ends: (start, kind, end) of the best labelled segmentation.

        All segments and types compete, as they do in training.
        """
        value, back = [0.0], [None]
        for j in range(1, len(ends)):
            v, b = value[j - 1], None
            for i, x, y, f in ends[j]:
                for kind in ADDED:
                    s = self.score(kind, f) + TIE * (j - i)
                    if value[i] + s > v:
                        v, b = value[i] + s, (i, x, kind, y)
            value.append(v)
            back.append(b)
        out, j = [], len(ends) - 1
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, x, kind, y = back[j]
                out.append((x, kind, y))
                j = i
        return out[::-1]

    def forward(self, ends: list[list]) -> list[float]:
        """For each token end, the log of the sum over all labelled segmentations up to it."""
        out = [0.0]
        for j in range(1, len(ends)):
            out.append(_add([out[j - 1], *(out[i] + self.score(kind, f) for i, _, _, f in ends[j] for kind in ADDED)]))
        return out

    def learn(self, examples: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 6, rate: float = 0.3, shrink: float = 2e-3):
        """Ascend the conditional log-likelihood, by forward and backward sums over segments."""
        ready = []
        for text, gold in examples:
            tokens = [m.span() for m in _TOKEN.finditer(text)]
            ends = self.segments(text, tokens, lambda a, b: False)
            chosen = {(i, j, k) for j, own in enumerate(ends) for i, a, b, _ in own for ga, gb, k in gold if (a, b) == (ga, gb)}
            ready.append((ends, chosen))
        for _ in range(epochs):
            for ends, chosen in ready:
                n = len(ends) - 1
                local = [[(i, k, f, self.score(k, f)) for i, _, _, f in own for k in ADDED] for own in ends]
                front, rear = self.forward(ends), [0.0] * (n + 1)
                sums: list[list[float]] = [[] for _ in range(n + 1)]
                for j in range(n, -1, -1):
                    rear[j] = _add([*sums[j], *([rear[j + 1]] if j < n else [])]) if j < n or sums[j] else 0.0
                    for i, _, _, s in local[j]:
                        sums[i].append(rear[j] + s)
                for j in range(1, n + 1):
                    for i, k, f, s in local[j]:
                        change = ((i, j, k) in chosen) - math.exp(min(0.0, front[i] + s + rear[j] - front[n]))
                        if abs(change) > 1e-4:
                            for x in f:
                                old = self.w.get((k, x), 0.0)
                                self.w[k, x] = old + rate * (change - shrink * old)
        return self


def _add(values: list[float]) -> float:
    most = max(values)
    return most + math.log(sum(math.exp(v - most) for v in values))


def _iban(rng: random.Random) -> str:
    country, account = rng.choice(["DE", "FR", "ES", "GB"]), "".join(rng.choice("0123456789") for _ in range(18))
    check = 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97
    packed = f"{country}{check:02d}{account}"
    return " ".join(packed[i : i + 4] for i in range(0, len(packed), 4)) if rng.random() < 0.6 else packed


def examples(count: int = 160, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Generated sentences with their entities; half hold look-alikes and no entity."""
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(["an", "the", "ion", "er", "le", "un", "ge", "sa", "mo"]) for _ in range(rng.randint(1, 3)))
    make = {
        "tel": lambda: rng.choice([f"({d(3)}) 555-{d(4)}", f"(0{d(2)}) {rng.randint(200, 999)}-{d(4)}", f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{d(4)}", f"{rng.randint(200, 999)}.{d(3)}.{d(4)}"]),
        "iban": lambda: _iban(rng),
        "ssn": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "mail": lambda: f"{word()}{rng.choice([' [at] ', '(at)', ' (at) '])}{word()}{rng.choice([' [dot] ', '.', ' (dot) '])}com",
    }
    cues = {"tel": ["call", "tel:", "phone"], "iban": ["IBAN", "account"], "ssn": ["SSN", "security"], "mail": ["contact", "mail:"]}
    fakes = [lambda: f"{d(4)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{d(2)}.{d(2)}.{d(4)}", lambda: d(rng.randint(1, 19)), lambda: f"{d(1)},{d(3)}.{d(2)}", lambda: f"v{d(1)}.{d(2)}.{d(1)}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([16, 32, 40]))), lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", lambda: f"({d(4)})", lambda: f"{d(2)}:{d(2)}", lambda: f"{d(3)}-{d(3)}"]
    out = []
    for n in range(count):
        parts, gold, at = [], [], 0
        for _ in range(rng.randint(1, 4)):
            parts.append(word())
        if n % 2:
            kind = ADDED[n // 2 % len(ADDED)]
            if rng.random() < 0.5:
                parts.append(rng.choice(cues[kind]))
            at = len(" ".join(parts)) + 1
            parts.append(span := make[kind]())
            gold.append((at, at + len(span), kind))
        else:
            parts.append(rng.choice(fakes)())
        parts += [word() for _ in range(rng.randint(0, 3))]
        out.append((" ".join(parts) + rng.choice(["", ".", ","]), gold))
    return out


def trained() -> SemiMarkov:
    return SemiMarkov().learn(examples())


def added_spans(text: str, base: list[tuple[int, int, int]], model: SemiMarkov) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the field's spans, none over a base span."""
    if not _TRIGGER.search(text):
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    near, last = [], -1
    for k, (a, b) in enumerate(tokens):
        if _TRIGGER.search(text, a, b):
            lo = max(0, k - MAX_TOKENS)
            if near and lo <= last:
                near[-1][1] = k + MAX_TOKENS + 1
            else:
                near.append([lo, k + MAX_TOKENS + 1])
            last = k + MAX_TOKENS + 1
    busy = [(s, e) for s, _, e in base]
    out, at = [], 0
    for lo, hi in near:
        own = tokens[lo:hi]
        while at < len(busy) and busy[at][1] <= own[0][0]:
            at += 1
        here = []
        for s, e in busy[at:]:
            if s >= own[-1][1]:
                break
            here.append((s, e))
        # Tokens of base spans cut the island; no segment runs over one.
        piece = []
        k = 0
        for a, b in [*own, (-1, -1)]:
            while k < len(here) and here[k][1] <= a:
                k += 1
            if a < 0 or any(s < b and a < e for s, e in here[k : k + 4]):
                if piece:
                    out += model.best(model.segments(text, piece, lambda a, b: False))
                piece = []
            else:
                piece.append((a, b))
    return out


def find(text: str, model: SemiMarkov) -> tuple[list[tuple[int, int, int]], list[tuple[int, str, int]]]:
    base = base_spans(text)
    return base, added_spans(text, base, model)


def listed(base, added=()) -> str:
    rank = {k: n for n, k in enumerate(KINDS + ADDED)}
    rows = sorted([(s, k, e) for s, k, e in base] + [(s, rank[k], e) for s, k, e in added])
    return ",".join(f"{(KINDS + ADDED)[k]}:{s}:{e}" for s, k, e in rows)


def detect(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """doc_id, counts, digest of the base spans and all spans of every whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())

    def read(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, added = find(text or "", shared.value)
                counts = [sum(k == n for _, k, _ in base) for n in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base, added)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(columns)]], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, SCHEMA)


def masked(text: str, model: SemiMarkov) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind."""
    base, added = find(text, model)
    spans = sorted([(s, e, KINDS[k]) for s, k, e in base] + [(s, e, k) for s, k, e in added])
    out, at, until = [], 0, -1
    for s, e, kind in spans:
        if s >= until:
            out += [text[at:s] if s > at else "", f"[{kind.upper()}]"]
        at = until = max(e, until)
    return "".join(out) + text[at:] if spans else text


def mask(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` masked and ``n_chars``, if there, brought up to date."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    schema, names = docs.schema, docs.columns
    at = names.index("text")

    def read(batches):
        for batch in batches:
            texts = [None if t is None else masked(t, shared.value) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at).with_nullable(True), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(read, schema)
    if "n_chars" not in names:
        return out
    changed = F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), F.lit(0)).cast(schema["n_chars"].dataType))
    return out.withColumn("n_chars", changed)
