"""Alignment of two tokenizers over the bytes of the same text.

A batch of texts, each after one blank, is laid out as one run of bytes with the documents' offsets. Both
vocabularies' token ends are counted over it by one ``bincount``; a byte at which both end cuts groups. Prefix sums
over tokens, groups and documents give each document's numbers; tokens of a group are linked, each with each.

How many documents hold a pair of ids linked is counted over the corpus: a block of texts states its distinct
pairs once, Spark sums them by pair, and the sums go back to the blocks that asked. What a block keeps is bounded
by BLOCK_BYTES, whatever its documents' number; links of a document are kept as numbers of its block's pairs.

Texts are encoded by the runs between cuts (a blank after a non-blank byte and before a letter, digit
or sign of a word), as neither tokenizer joins anything across such a place; tests hold the ids against whole texts.
For the same reason new runs are encoded some at a time, as one text, where such a cut lies between them.

Defined results: a text that is null or empty, or whose tokens do not spell a blank and the text, has no tokens:
zeros and an empty ``groups_sha256``. Special tokens' strings are plain text. Repeated rows are documents of their
own. Within one group, pairs beyond WIDE are counted by distinct ids and their numbers, never written out.
"""

from __future__ import annotations

import hashlib
import json
import os
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, small_batches, written

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text laid out at once (a longer text alone), and of a block.
SLICE_BYTES, BLOCK_BYTES = 2 << 20, 16 << 20
#: Runs remembered in a worker, and rows of pairs handed to Spark at once.
REMEMBERED, ROWS = 200_000, 1 << 16
#: New runs encoded as one text, and in one vectorised step.
JOINED, STEP = 32, 1 << 14
#: Pairs of one group from which on they are counted by distinct ids.
WIDE = 4096
#: A pair is a * SPAN + b; both ids are less.
SPAN = 1 << 20
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
BLOCKS = "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"
ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def read_tokenizers(a_path: str = A_FILE, b_path: str = B_FILE) -> tuple[bytes, bytes]:
    """Both files' content, read on the driver."""
    return Path(a_path).read_bytes(), Path(b_path).read_bytes()


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, the other way round."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoders:
    """Both tokenizers, and the bytes that each id spells."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; Spark deals the work
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a.decode()), SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocabulary = json.loads(a)["model"]["vocab"]
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token)
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.get_piece_size())]
        sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes)]
        self.spelled = [(np.frombuffer(b"".join(x), np.uint8), _before(n)[:-1], n) for x, n in zip((self.a_bytes, self.b_bytes), sizes, strict=True)]

    def encode(self, runs: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Which runs, that begin with the blank that B adds, are spelled by their tokens; for A and B, the ids of all
        that are, and how many each run has."""
        found = [self._encode(runs[at : at + STEP]) for at in range(0, len(runs), STEP)]
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return join([x[0] for x in found], bool), [join([x[1][k] for x in found], np.int32) for k in range(2)], [join([x[2][k] for x in found], np.int64) for k in range(2)]

    def _encode(self, runs: list[bytes], most: int = JOINED) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        laid = b"".join(runs)
        data, at = np.frombuffer(laid, np.uint8), _before(np.fromiter(map(len, runs), np.int64, len(runs)))
        # A run follows another in one text just if it would have been cut off there.
        padded, place = np.append(data, 0), np.arange(len(runs))
        first = ~((data[at[:-1] - 1] != 32) & (data[at[:-1]] == 32) & _WORD[padded[at[:-1] + 1]] & (np.diff(at) > 1))
        first[:1] = True
        text = np.flatnonzero((place - np.maximum.accumulate(np.where(first, place, 0))) % most == 0)
        bounds = at[np.append(text, len(runs))]
        texts = [laid[s:e].decode() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        ids = [[e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)]
        size = [np.fromiter(map(len, x), np.int64, len(x)) for x in ids]
        flat = [np.fromiter(chain.from_iterable(x), np.int32, int(n.sum())) for x, n in zip(ids, size, strict=True)]
        # Only where both spell a text byte by byte, and each run ends with a token of both, are its runs told apart.
        owner = [np.repeat(np.arange(len(texts)), n) for n in size]
        good = np.ones(len(texts), bool)
        for i, of, (_, _, lengths) in zip(flat, owner, self.spelled, strict=True):
            good &= np.bincount(of, lengths[i], len(texts)).astype(np.int64) == np.diff(bounds)
        for k, (letters, starts, lengths) in enumerate(self.spelled):
            own = flat[k][good[owner[k]]]
            of_byte = np.repeat(np.flatnonzero(good), np.diff(bounds)[good])
            wrong = letters[_ranges(starts[own], lengths[own])] != data[_ranges(bounds[:-1][good], np.diff(bounds)[good])]
            good[of_byte[wrong]] = False
        of_run, counts = np.searchsorted(text, place, side="right") - 1, []
        for k, (_, _, lengths) in enumerate(self.spelled):
            # Tokens of texts that are told apart, by the byte at which they end.
            own = owner[k][good[owner[k]]]
            here = np.cumsum(lengths[flat[k][good[owner[k]]]])
            gap = (bounds[:-1] - _before(np.where(good, np.diff(bounds), 0))[:-1])[own]
            ends = np.bincount(here + gap, minlength=len(data) + 1)
            good[of_run[(ends[at[1:]] == 0) & good[of_run]]] = False
            counts.append(np.diff(np.cumsum(ends)[at]))
        if good.all():
            return np.ones(len(runs), bool), flat, counts
        if most == 1:
            sizes = [np.where(good, n, 0) for n in size]
            return good, [x[good[of]] for x, of in zip(flat, owner, strict=True)], sizes
        # Texts that are not: their runs one by one.
        rest = np.flatnonzero(~good[of_run])
        ok, other, other_counts = self._encode([runs[i] for i in rest.tolist()], 1)
        every = np.ones(len(runs), bool)
        every[rest] = ok
        for k in range(2):
            own, counts[k][rest] = flat[k][good[owner[k]]], other_counts[k]
            of_token = np.repeat(place, counts[k])
            late = np.isin(of_token, rest)
            flat[k] = np.empty(len(of_token), np.int32)
            flat[k][late], flat[k][~late] = other[k], own
        return every, flat, counts


class _Runs:
    """Runs seen, numbered, with the ids of both tokenizers in two long arrays."""

    def __init__(self, encoders: Encoders):
        self.encoders = encoders
        self.clear()

    def clear(self):
        self.numbers: dict[bytes, int] = {}
        self.good = np.zeros(0, bool)
        self.flat = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.at = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def number(self, runs: list[bytes]) -> np.ndarray:
        new = list(dict.fromkeys(r for r in runs if r not in self.numbers))
        if new:
            good, flat, sizes = self.encoders.encode(new)
            self.numbers.update(zip(new, range(len(self.good), len(self.good) + len(new)), strict=True))
            self.good = np.concatenate([self.good, good])
            for k in range(2):
                self.flat[k] = np.concatenate([self.flat[k], flat[k]])
                self.at[k] = np.concatenate([self.at[k], self.at[k][-1] + np.cumsum(sizes[k])])
        return np.fromiter(map(self.numbers.__getitem__, runs), np.int64, len(runs))

    def ids(self, k: int, numbers: np.ndarray) -> np.ndarray:
        starts, sizes = self.at[k][numbers], self.at[k][numbers + 1] - self.at[k][numbers]
        return self.flat[k][_ranges(starts, sizes)]


def _before(sizes: np.ndarray) -> np.ndarray:
    """Sums of all sizes before each, and of all at the end."""
    return np.concatenate([[0], np.cumsum(sizes)])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one after the other."""
    before = _before(sizes)
    return np.repeat(starts - before[:-1], sizes) + np.arange(before[-1])


#: Bytes that begin a word after a blank: visible ASCII, and leads of letters up to U+07FF.
_WORD = np.isin(np.arange(256), [*range(0x21, 0x7F), *range(0xC3, 0xE0)])


def run_starts(laid: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Offsets at which runs begin: each document's, and blanks between a non-blank byte and a word."""
    blank = laid == 32
    cut = np.zeros(len(laid), bool)
    cut[1:-1] = blank[1:-1] & ~blank[:-2] & _WORD[laid[2:]]
    cut[doc_starts] = True
    return np.flatnonzero(cut)


class Aligned:
    """Tokens, cuts and links of the documents of one slice."""

    def __init__(self, doc_sizes: np.ndarray, ids: list[np.ndarray], lengths: list[np.ndarray]):
        self.ids, self.doc_ends = ids, np.cumsum(doc_sizes)
        ends = [np.cumsum(size[i]) for size, i in zip(lengths, ids, strict=True)]
        total = int(self.doc_ends[-1]) if len(doc_sizes) else 0
        both = np.bincount(np.concatenate(ends), minlength=total + 1) == 2
        cuts = np.cumsum(both)
        #: Group of each token, tokens of each group, and what lies before each group.
        self.group = [cuts[e - 1] for e in ends]
        n = int(cuts[-1])
        self.size = [np.bincount(g, minlength=n) for g in self.group]
        self.start = [_before(s) for s in self.size]
        self.links = _before(self.size[0] * self.size[1])
        self.doc_groups = np.concatenate([[0], cuts[self.doc_ends]])

    def counts(self) -> list[np.ndarray]:
        """Tokens of A and B, groups and links of each document."""
        at = self.doc_groups
        return [np.diff(self.start[0][at]), np.diff(self.start[1][at]), np.diff(at), np.diff(self.links[at])]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair of ids and number of links of it, once for each document and pair."""
        (a, b), (of_a, _), (n_a, n_b), (_, b_start) = self.ids, self.group, self.size, self.start
        group_doc = np.repeat(np.arange(len(self.doc_ends)), np.diff(self.doc_groups))
        wide = n_a * n_b > WIDE
        reach = np.where(wide, 0, n_b)[of_a]
        pair = np.repeat(a.astype(np.int64) * SPAN, reach) + b[_ranges(b_start[of_a], reach)]
        found = [_counted(np.repeat(group_doc[of_a], reach), pair, np.ones(len(pair), np.int64))]
        for g in np.flatnonzero(wide):
            (ua, ca), (ub, cb) = (np.unique(x[s[g] : s[g + 1]], return_counts=True) for x, s in zip(self.ids, self.start, strict=True))
            key = (ua.astype(np.int64)[:, None] * SPAN + ub).ravel()
            found.append((np.full(len(key), group_doc[g]), key, np.outer(ca, cb).ravel()))
        return found[0] if len(found) == 1 else _counted(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def digests(self, numerals: np.ndarray) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2`` for each document; ``numerals`` has ids followed by each of the three signs."""
        base = len(numerals) // 3
        line = np.empty(len(self.ids[0]) + len(self.ids[1]), np.int64)
        for k in range(2):
            g, place = self.group[k], np.arange(len(self.ids[k]))
            at = place + (self.start[1][g] if k == 0 else self.start[0][g + 1])
            line[at] = self.ids[k]
            line[at[self.start[k][1:] - 1]] += base * (k + 1)
        shown = numerals[line]
        at = (self.start[0] + self.start[1])[self.doc_groups]
        return [hashlib.sha256(b"".join(shown[s:e].tolist())[:-1]).hexdigest() for s, e in zip(at[:-1], at[1:], strict=True)]


def _counted(doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by document and pair, once each, with the sum of ``times``."""
    order = np.lexsort((pair, doc)) if len(doc) and int(doc.max()) >= 1 << 23 else np.argsort(doc << 40 | pair, kind="stable")
    doc, pair, times = doc[order], pair[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(pair) != 0)])) if len(doc) else np.zeros(0, np.int64)
    return doc[first], pair[first], np.add.reduceat(times, first) if len(first) else times


def _numerals(n: int) -> np.ndarray:
    out = np.empty(3 * n, object)
    out[:] = [b"%d%s" % (i, sign) for sign in (b",", b"|", b";") for i in range(n)]
    return out


class _Block:
    """Documents and links until they fill a block."""

    def __init__(self):
        self.rows, self.bytes, self.links = [], 0, []

    def add(self, ids: list, counts: list[np.ndarray], digests: list[str], links, good: np.ndarray, size: int):
        doc, pair, times = links
        at = np.searchsorted(doc, np.arange(len(counts[0]) + 1))
        self.links += [(pair[s:e], times[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]
        it = iter(range(len(counts[0])))
        for i, ok in zip(ids, good, strict=True):
            k = next(it) if ok else None
            self.rows.append((i, *((int(c[k]) for c in counts) if ok else (0, 0, 0, 0)), digests[k] if ok else "", ok))
        self.bytes += size

    def batches(self, block: int):
        """The block's own row (its pairs and their numbers of documents), then its documents' rows."""
        every = np.concatenate([p for p, _ in self.links]) if self.links else np.zeros(0, np.int64)
        pairs, place = np.unique(every, return_inverse=True)
        yield self._batch(block, [(None, None, None, None, None, None, pairs.astype("<i8").tobytes(), np.bincount(place, minlength=len(pairs)).astype("<i4").tobytes())])
        place, at, out, links = place.astype("<i4"), 0, [], iter(self.links)
        for *row, ok in self.rows:
            pair, times = next(links) if ok else ((), np.zeros(0, np.int64))
            mine = place[at : at + len(pair)]
            at += len(pair)
            out.append((*row, np.diff(mine, prepend=np.int32(0)).astype("<i4").tobytes(), times.astype("<i4").tobytes()))
            if len(out) == 256:
                yield self._batch(block, out)
                out = []
        if out:
            yield self._batch(block, out)

    @staticmethod
    def _batch(block: int, rows: list[tuple]) -> pa.RecordBatch:
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        types = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)


def _slices(batch: pa.RecordBatch, most: int):
    """Parts of a batch whose texts take ``most`` bytes, but for a single text."""
    sizes = np.array([0 if t is None else t for t in pa.compute.binary_length(batch.column(1)).to_pylist()], np.int64)
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
        yield batch.slice(at, n)
        at += n


def _align(batch: pa.RecordBatch, runs: _Runs, lengths: list[np.ndarray], numerals: np.ndarray, block: _Block):
    texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1)]
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    laid = b"".join(b" " + t for t in texts if t)
    some = np.flatnonzero(sizes)
    doc_starts = _before(sizes[some])[:-1]
    starts = run_starts(np.frombuffer(laid, np.uint8), doc_starts) if laid else np.zeros(0, np.int64)
    bounds = np.append(starts, len(laid))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(laid)]).dictionary_encode()
    numbers = runs.number(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    run_doc = np.searchsorted(doc_starts, starts, side="right") - 1
    good = np.ones(len(some), bool)
    good[run_doc[~runs.good[numbers]]] = False
    numbers = numbers[good[run_doc]]
    aligned = Aligned(sizes[some][good], [runs.ids(k, numbers) for k in range(2)], lengths)
    kept = np.zeros(len(texts), bool)
    kept[some[good]] = True
    block.add(batch.column(0).to_pylist(), aligned.counts(), aligned.digests(numerals), aligned.pairs(), kept.tolist(), len(laid))
    if len(runs.numbers) > REMEMBERED:
        runs.clear()


def blocks(docs: DataFrame, files: tuple[bytes, bytes], slice_bytes: int = SLICE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of documents and, with a null digest, of blocks: the distinct pairs of ids and their numbers of documents."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def read(batches):
        encoders = Encoders(*shared.value)
        runs, numerals = _Runs(encoders), _numerals(max(len(encoders.a_bytes), len(encoders.b_bytes)))
        lengths = [np.fromiter(map(len, x), np.int64, len(x)) for x in (encoders.a_bytes, encoders.b_bytes)]
        number, block = TaskContext.get().partitionId() << 24, _Block()
        for batch in batches:
            for part in _slices(batch, slice_bytes):
                _align(part, runs, lengths, numerals, block)
                if block.bytes >= block_bytes:
                    yield from block.batches(number)
                    number, block = number + 1, _Block()
                    give_back()
        if block.rows:
            yield from block.batches(number)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(read, BLOCKS)


def _exploded(batches):
    """block, place, pair and number of documents, from the rows of blocks."""
    for batch in batches:
        for block, pairs, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pairs, docs = np.frombuffer(pairs, "<i8"), np.frombuffer(docs, "<i4")
            for at in range(0, len(pairs), ROWS):
                part = pairs[at : at + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int64)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.array(part), pa.array(docs[at : at + ROWS].astype(np.int64))], ["block", "place", "pair", "docs"])


def pair_counts(rows: DataFrame) -> DataFrame:
    """block, place and pair, with the number of documents of the whole corpus that hold the pair linked."""
    own = rows.where(F.col("groups_sha256").isNull()).select("block", "pairs", "times")
    each = own.mapInArrow(_exploded, "block bigint, place int, pair bigint, docs bigint")
    return each.select("block", "place", "pair", F.sum("docs").over(Window.partitionBy("pair")).alias("n"))


def align(docs: DataFrame, files: tuple[bytes, bytes] | None = None, **sizes: int) -> DataFrame:
    """One row a document: tokens, groups, links, and how its links stand in the corpus. ``sizes`` go to ``blocks``."""
    rows = written(blocks(docs, files or read_tokenizers(), **sizes), "alignment")
    counted = written(pair_counts(rows), "pairs").withColumn("a", F.floor(F.col("pair") / SPAN).cast("int"))
    best = counted.groupBy("a").agg(F.max("n").alias("most"))  # at most one row for each id of A's vocabulary
    answers = counted.join(F.broadcast(best), "a").select("block", F.lit(0).alias("part"), "place", "n", (F.col("n") == F.col("most")).alias("best"))
    texts = rows.where(F.col("groups_sha256").isNotNull()).drop("block").columns
    both = answers.select("*", *(F.lit(None).cast(t).alias(n) for n, t in rows.dtypes if n in texts)).unionByName(
        rows.where(F.col("groups_sha256").isNotNull()).select("block", F.lit(1).alias("part"), *(F.lit(None).cast(t).alias(n) for n, t in (("place", "int"), ("n", "long"), ("best", "boolean"))), *texts)
    )
    both = both.repartition("block").sortWithinPartitions("block", "part", "place")

    def read(batches):
        now, parts, counts, most = None, [], None, None
        for batch in batches:
            columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            block, part = (columns[n].to_numpy(zero_copy_only=False) for n in ("block", "part"))
            edges = np.flatnonzero(np.concatenate([[True], (np.diff(block) != 0) | (np.diff(part) != 0), [True]]))
            out = []
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if block[s] != now:
                    now, parts, counts = block[s], [], None
                if part[s] == 0:
                    parts.append([columns[n].slice(s, e - s).to_numpy(zero_copy_only=False) for n in ("n", "best")])
                    continue
                if counts is None:
                    counts, most = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, bool))
                    counts, most = counts.astype(np.int64), most.astype(bool)
                own = [columns[n].slice(s, e - s).to_pylist() for n in ("doc_id", *COUNTS, "groups_sha256", "pairs", "times")]
                for *row, digest, pairs, times in zip(*own, strict=True):
                    place, times = np.cumsum(np.frombuffer(pairs, "<i4")), np.frombuffer(times, "<i4").astype(np.int64)
                    out.append((*row, int(times[most[place]].sum()), int((times * counts[place]).sum()), digest))
            if out:
                names = [f.split()[0] for f in ALIGNED.split(", ")]
                types = [pa.int64()] * 7 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return both.mapInArrow(read, ALIGNED)
