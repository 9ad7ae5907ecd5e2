"""An interpolated n-gram model with modified Kneser-Ney discounts, and texts scored by it.

Texts become blocks of at most BLOCK_TOKENS tokens: a vocabulary of 64-bit word hashes, and each document's tokens
as numbers of it. A block states each of its distinct n-grams once to the shard that the hash of its context
names; the shard adds up what all blocks state. The highest order counts occurrences, the lower ones distinct left
neighbours. A shard is stored in the shared folder as sorted arrays of hashes with counts, and of contexts with
their sums, in Arrow files. To score, blocks ask shards for their distinct n-grams; a task maps one shard's
files into memory, answers by binary search, and the answers go back to the blocks. No task holds more than a
block or a shard, and no rows but hashes and counts travel.

Words that take a thousandth of all tokens or more (at most a thousand), start and end are hot: what stands after or before one of
them is dealt by the whole n-gram's hash, and only the sums of hot words come to the driver.

An n-gram is known by its context's hash and 40 bits of its last word's, so two share a number about once in
2 ** 40 pairs within one context; words by 64 bits.

Defined results: a null text counts as empty and has one token, the end. Words are runs without blanks, A-Z in
lower case. Rows without id are trained on. Texts start with start marks, which are left neighbours but never
predicted. A level whose counts lack one of 1 to 4 takes the discounts 0.5, 1 and 1.5. Unknown words share one
place of the uniform distribution below the lowest order. Without training rows every token has probability 1.
Repeated rows are counted as often as they stand, and scored alike.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fold, give_back, scratch_path, shuffles_dropped, small_batches, written

#: Words of an n-gram. Three need about twice the disk and time of two.
ORDER = 2
#: Rows whose crc32 of the id leaves HELD_OUT by FOLDS are held out.
FOLDS, HELD_OUT = 10, 0
#: Tokens of a block, and on average of a shard. Rows between blocks and shards are their product.
BLOCK_TOKENS, SHARD_TOKENS = 2_000_000, 2_000_000
#: Share of the tokens from which on a word is hot.
HOT = 1 / 1000
#: Rows handed to a worker at once; those between blocks and shards take some 100 kB.
ROWS = 64
#: Bytes of a count of the whole corpus.
WIDE = 6
#: Entries that a shard gathers before it adds them up.
FOLD = 8_000_000
START, END = np.uint64(xxhash.xxh3_64_intdigest(b"\t")), np.uint64(xxhash.xxh3_64_intdigest(b"\n"))
LOW = np.uint64((1 << 40) - 1)
# Share added to each count, and the discounts of a level without counts of 1 to 4.
ADDED, DISCOUNTS = 0.1, (0.5, 1.0, 1.5)
BLOCK = "block bigint, ids array<bigint>, held binary, sizes binary, hashes binary, tokens binary, n bigint, hot array<struct<word:bigint,n:bigint>>"
STATED = "shard int, heads binary, members binary, words binary, counts binary, lefts binary, raw binary"
ANSWER = "block bigint, level int, shard int, counts binary, sums binary"
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two numbers, the first of which may be a hash itself."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def packed(x: np.ndarray, width: int) -> bytes:
    """Numbers as planes of bytes, the lowest first, which compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(b: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def rising(x: np.ndarray) -> bytes:
    """Sorted hashes as the steps between them, whose upper bytes are few."""
    return packed(np.diff(x, prepend=np.uint64(0)), 8)


def risen(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b, 8), dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class _Writer:
    """Documents' tokens until they fill a block."""

    def __init__(self, share: float):
        self.share = share
        self.words, self.rows, self.n = _Words(), [], 0

    def add(self, doc_id, held: bool, text: bytes):
        words = text.lower().split()
        self.rows.append((doc_id, held, np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))))
        self.n += len(words) + 1

    def batch(self, block: int) -> pa.RecordBatch:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        flat = np.concatenate([t for *_, t in self.rows])
        times = np.bincount(flat, minlength=len(hashes))
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        often = order[times[order] >= self.share * self.n]
        hot = [(int(h), int(n)) for h, n in zip(hashes[often].astype(np.int64), times[often], strict=True)]
        ids, held, tokens = zip(*self.rows, strict=True)
        columns = [[block], [list(ids)], [packed(np.array(held, np.uint8), 1)], [packed(np.array([len(t) for t in tokens]), 4)], [hashes[order].tobytes()], [packed(rank[flat], 3)], [self.n], [hot]]
        types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int64(), pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))]
        names = ["block", "ids", "held", "sizes", "hashes", "tokens", "n", "hot"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def blocks(docs: DataFrame, held, block_tokens: int = BLOCK_TOKENS, hot: float = HOT) -> DataFrame:
    """One row a block of documents; ``held`` is a condition on those that are not trained on."""
    small_batches(docs.sparkSession, ROWS)

    def read(batches):
        number, block = TaskContext.get().partitionId() << 24, _Writer(hot)
        for b in batches:
            for doc_id, out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                block.add(doc_id, out, text.as_buffer().to_pybytes() if text.is_valid else b"")
                if block.n >= block_tokens:
                    yield block.batch(number)
                    number, block = number + 1, _Writer(hot)
        if block.rows:
            yield block.batch(number)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(held, F.lit(False)), F.col("text").cast("string")).mapInArrow(read, BLOCK)


class Grams:
    """A block's sequence of word hashes and the hashes of all n-grams that end at each place."""

    def __init__(self, sizes, hashes, tokens, order: int, chosen: np.ndarray | None = None):
        sizes = unpacked(sizes, 4).astype(np.int64)
        words = np.append(np.frombuffer(hashes, np.uint64), END)
        tokens = unpacked(tokens, 3).astype(np.int64)
        if chosen is not None:
            tokens, sizes = tokens[np.repeat(chosen, sizes)], sizes[chosen]
        #: Number of each place's word in ``vocabulary``, and the documents' first places.
        self.vocabulary, self.sizes = words, sizes + 1
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.word = np.empty(int(self.starts[-1]), np.int32)
        ends = np.zeros(len(self.word), bool)
        ends[self.starts[1:] - 1] = True
        self.word[ends], self.word[~ends] = len(words) - 1, tokens
        del ends, tokens
        places = np.arange(len(self.word)) + np.repeat((np.arange(len(sizes)) + 1) * (order - 1), self.sizes)
        line = np.full(len(self.word) + len(sizes) * (order - 1), START)
        line[places] = words[self.word]
        self.places = places.astype(np.int32)
        del places
        self.hashes = [None, line]
        for _ in range(2, order + 1):
            self.hashes.append(np.concatenate([line[:1], mix(self.hashes[-1][:-1], line[1:] & LOW)]))

    def keys(self, level: int) -> np.ndarray:
        """Hash of the n-gram that ends at each place."""
        return self.hashes[level][self.places]

    def of(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, context and last word of the n-grams that end at some places."""
        places = self.places[at]
        context = self.hashes[level - 1][places - 1] if level > 1 else np.zeros(len(at), np.uint64)
        return self.hashes[level][places], context, self.hashes[1][places] & LOW


def _edges(*sorted_arrays: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before, with the first."""
    n = len(sorted_arrays[0])
    if not n:
        return np.zeros(0, np.int64)
    differs = np.zeros(n, bool)
    differs[0] = True
    for x in sorted_arrays:
        differs[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(differs)


def _sizes(edges: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(edges, n))


def asked(g: Grams, level: int, shards: int, hot: np.ndarray):
    """Distinct n-grams of a level in the order of shards: shard, context, key, last word, and each place's row."""
    if level == 1:
        key, row = g.vocabulary, g.word
        context, last = np.zeros(len(key), np.uint64), key
        shard = np.where(np.isin(key, hot), -1, shard_of(key, shards))
    else:
        key, first, row = np.unique(g.keys(level), return_index=True, return_inverse=True)
        _, context, last = g.of(level, first)
        shard = shard_of(np.where(np.isin(context, hot), key, context) if level == 2 else context, shards)
    order = np.lexsort((key, context, shard))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return shard[order], context[order], key[order], last[order], rank[row]


def stated(g: Grams, level: int, top: int, shards: int, hot: np.ndarray):
    """A block's rows for the shards: contexts (or words, at level 1), their words, and counts or left neighbours."""
    if not len(g.word):
        return
    if level == top:
        shard, context, key, last, row = asked(g, level, shards, hot)
        counts = np.bincount(row, minlength=len(key)).astype(np.uint64)
        for k, s, e in _parts(shard):
            heads = _edges(context[s:e])
            yield k, rising(context[s:e][heads]), packed(_sizes(heads, e - s), 4), packed(last[s:e], 5), packed(counts[s:e], 4), b"", b""
        return
    longer, first = np.unique(g.keys(level + 1), return_index=True)
    key, context, last = g.of(level, first)
    context = key if level == 1 else context
    if level == 1:
        shard = shard_of(np.where(np.isin(key, hot), longer, key), shards)
        raw = np.bincount(g.word, minlength=len(g.vocabulary))
        by = np.argsort(g.vocabulary, kind="stable")
    else:
        shard = shard_of(np.where(np.isin(context, hot), key, context) if level == 2 else context, shards)
    order = np.lexsort((longer, key, context, shard))
    shard, context, key, longer, last = shard[order], context[order], key[order], longer[order], last[order]
    # A hot word stands in several shards; its occurrences go to the first of them.
    seen = set()
    for k, s, e in _parts(shard):
        each = _edges(key[s:e])
        heads = _edges(context[s:e][each])
        times = b""
        if level == 1:
            words = key[s:e][each]
            n = raw[by[np.searchsorted(g.vocabulary[by], words)]]
            for at in np.flatnonzero(np.isin(words, hot)):
                if words[at] in seen:
                    n[at] = 0
                seen.add(words[at])
            times = packed(n, 4)
        yield k, rising(context[s:e][each][heads]), packed(_sizes(heads, len(each)), 4), packed(last[s:e][each], 5) if level > 1 else b"", packed(_sizes(each, e - s), 4), packed(longer[s:e] & LOW, 5), times


def _parts(shard: np.ndarray):
    edges = _edges(shard)
    for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(shard)], strict=True):
        if shard[s] >= 0:
            yield int(shard[s]), s, e


class Shard:
    """What blocks state of one shard, added up: key, context, count and, at level 1, occurrences."""

    def __init__(self, level: int, top: int):
        self.level, self.top = level, top
        self.gathered, self.n = [], 0

    def add(self, heads, members, words, counts, lefts, raw):
        heads, counts = risen(heads), unpacked(counts, 4)
        context = np.repeat(heads, unpacked(members, 4).astype(np.int64))
        key = context if self.level == 1 else mix(context, unpacked(words, 5))
        if self.level == self.top:
            self.gathered.append((key, context, counts))
        else:
            times = counts.astype(np.int64)
            occurs = np.zeros(int(times.sum()), np.uint64)
            if self.level == 1:
                occurs[np.cumsum(times) - times] = unpacked(raw, 4)
            self.gathered.append((np.repeat(key, times), np.repeat(context, times), occurs, unpacked(lefts, 5)))
        self.n += len(self.gathered[-1][0])
        if self.n > FOLD and len(self.gathered) > 1:
            self._fold()

    def _fold(self):
        key, context, number, *left = (np.concatenate(x) for x in zip(*self.gathered, strict=True))
        order = np.lexsort((*left, key))
        key, context, number, left = key[order], context[order], number[order], [x[order] for x in left]
        first = _edges(key, *left)
        self.gathered = [(key[first], context[first], np.add.reduceat(number, first) if len(first) else number, *(x[first] for x in left))]
        self.n = len(first)

    def result(self):
        """Sorted keys, their contexts, counts and occurrences."""
        self._fold()
        key, context, number, *_ = self.gathered[0]
        if self.level == self.top:
            return key, context, number, number
        each = _edges(key)
        return key[each], context[each], _sizes(each, len(key)).astype(np.uint64), np.add.reduceat(number, each) if len(each) else number


def context_sums(context: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Of each context, sorted: the sum of counts, and how many are 1, 2, and 3 or more."""
    order = np.argsort(context, kind="stable")
    context, counts = context[order], counts[order]
    first = _edges(context)
    total = lambda x: np.add.reduceat(x.astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64)
    return {"context": context[first], "total": total(counts), "one": total(counts == 1), "two": total(counts == 2), "more": total(counts >= 3)}


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def store(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays of one length as an Arrow file, written under a name of its own and then moved, so a repeated task does no harm."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    batch = pa.RecordBatch.from_pydict(arrays)
    with fs.open_output_stream(own) as out, pa.ipc.new_file(out, batch.schema) as file:
        file.write_batch(batch)
    fs.move(own, path)


def mapped(uri: str) -> dict[str, np.ndarray]:
    """A stored file's arrays, mapped into memory where the shared folder is a mounted one, else read."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    if fs.get_file_info(path).type == pa.fs.FileType.NotFound:
        return {}
    source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else pa.BufferReader(fs.open_input_stream(path).read_buffer())
    batch = pa.ipc.open_file(source).get_batch(0)
    return {n: batch.column(n).to_numpy() for n in batch.schema.names}


@dataclass
class Model:
    """Where the shards lie, and what of the model is small: discounts, totals, sums of hot words."""

    uri: str
    order: int
    shards: int
    hot: np.ndarray
    #: Discounts of counts 1, 2, and 3 or more; sums of the lowest order; sums of hot contexts; counts of hot words.
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    lowest: tuple[int, int, int, int] = (0, 0, 0, 0)
    hot_contexts: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)
    hot_words: dict[int, tuple[int, int]] = field(default_factory=dict)
    #: Tokens and distinct words trained on.
    tokens: int = 0
    words: int = 0

    def file(self, level: int, shard: int, kind: str) -> str:
        return f"{self.uri}/level-{level}/{kind}-{shard}.arrow"


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of counts 1 to 4, each between 0 and the count."""
    if min(n) <= 0:
        return DISCOUNTS
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))


def _sorted_by_shard(rows: DataFrame) -> DataFrame:
    return rows.repartition("shard").sortWithinPartitions("shard")


def _train_level(table: DataFrame, model: Model, level: int) -> None:
    top, shards, hot, order = model.order, model.shards, model.hot, model.order
    uses = model.hot if level <= 2 else np.zeros(0, np.uint64)

    def state(batches):
        for batch in batches:
            for held, sizes, hashes, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                g = Grams(sizes, hashes, tokens, order, unpacked(held, 1) == 0)
                for row in stated(g, level, top, shards, hot):
                    yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in row[1:])], [f.split()[0] for f in STATED.split(", ")])
                give_back()

    def finish(number, shard):
        key, context, counts, occurs = shard.result()
        whole = ~np.isin(key, uses) if level == 1 else np.ones(len(key), bool)
        arrays = {"key": key, "count": _narrow(counts)} | ({"occurs": _narrow(occurs)} if level == 1 else {})
        store(model.file(level, number, "grams"), arrays)
        out = [("seen", 0, *(int((counts[whole] == k).sum()) for k in (1, 2, 3, 4)))]
        if level == 1:
            out.append(("lowest", 0, int(counts[whole].sum()), *(int(x) for x in ((counts[whole] == 1).sum(), (counts[whole] == 2).sum(), (counts[whole] >= 3).sum()))))
            out.append(("tokens", 0, int(occurs[whole].sum()), int(whole.sum()), 0, 0))
            out += [("word", int(k), int(c), int(n), 0, 0) for k, c, n in zip(key[~whole].astype(np.int64), counts[~whole], occurs[~whole], strict=True)]
        else:
            sums = context_sums(context, counts)
            store(model.file(level, number, "contexts"), {n: x if n == "context" else _narrow(x) for n, x in sums.items()})
            if level == 2:
                out += [("context", *(int(v) for v in (sums["context"][i].astype(np.int64), *(sums[n][i] for n in ("total", "one", "two", "more"))))) for i in np.flatnonzero(np.isin(sums["context"], uses))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["kind", "id", "a", "b", "c", "d"])

    def add_up(batches):
        now = shard = None
        for batch in batches:
            for number, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != now:
                    if shard is not None:
                        yield finish(now, shard)
                    now, shard = number, Shard(level, top)
                shard.add(*row)
        if shard is not None:
            yield finish(now, shard)
        give_back()

    rows = _sorted_by_shard(table.select("held", "sizes", "hashes", "tokens").mapInArrow(state, STATED))
    found = rows.mapInArrow(add_up, "kind string, id bigint, a bigint, b bigint, c bigint, d bigint").groupBy("kind", "id").agg(*(F.sum(x).alias(x) for x in "abcd")).collect()
    sums = {(r["kind"], r["id"]): [r[x] for x in "abcd"] for r in found}
    seen = sums.get(("seen", 0), [0] * 4)
    if level == 1:
        lowest = sums.get(("lowest", 0), [0] * 4)
        model.tokens, model.words = sums.get(("tokens", 0), [0] * 4)[:2]
        for (kind, i), (count, occurs, *_) in sums.items():
            if kind == "word":
                model.hot_words[i] = count, occurs
                model.tokens, model.words = model.tokens + occurs, model.words + 1
                lowest = [lowest[0] + count, lowest[1] + (count == 1), lowest[2] + (count == 2), lowest[3] + (count >= 3)]
                seen = [n + (count == k) for k, n in enumerate(seen, 1)]
        model.lowest = tuple(lowest)
    else:
        model.hot_contexts |= {i: tuple(v) for (kind, i), v in sums.items() if kind == "context"}
    model.discounts[level] = discounts(seen)


def train(table: DataFrame, order: int = ORDER, shard_tokens: int = SHARD_TOKENS, hot: float = HOT) -> Model:
    """The model of the rows of ``blocks`` (written, as they are read once for each order) that are not held out."""
    if order < 2:
        raise ValueError("an order of two or more")
    spark: SparkSession = table.sparkSession
    total = table.agg(F.sum("n")).first()[0] or 0
    often = table.select(F.explode("hot").alias("h")).groupBy("h.word").agg(F.sum("h.n").alias("n")).where(F.col("n") >= hot * total)
    words = np.array([r["word"] for r in often.select("word").collect()], np.int64).astype(np.uint64)  # at most 1 / hot words
    model = Model(scratch_path(spark, "ngrams"), order, max(1, -(-total // shard_tokens)), np.unique(np.append(words, [START, END])))
    for level in range(1, order + 1):
        with shuffles_dropped(spark):
            _train_level(table, model, level)
    return model


def _found(keys: np.ndarray, wanted: np.ndarray):
    """Places of ``wanted`` in sorted ``keys``, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _picked(values: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
    return np.where(there, values[at], 0).astype(np.uint64) if len(values) else np.zeros(len(at), np.uint64)


def answers(table: DataFrame, model: Model) -> DataFrame:
    """For each block, order and shard: counts of the n-grams asked for and the sums of their contexts."""
    order, shards, hot = model.order, model.shards, model.hot

    def ask(batches):
        for batch in batches:
            for block, sizes, hashes, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                g = Grams(sizes, hashes, tokens, order)
                for level in range(1, order + 1):
                    shard, context, key, last, _ = asked(g, level, shards, hot)
                    for k, s, e in _parts(shard):
                        heads = _edges(context[s:e])
                        row = (rising(context[s:e][heads]), packed(_sizes(heads, e - s), 4), packed(last[s:e], 5)) if level > 1 else (b"", b"", rising(key[s:e]))
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level], pa.int32()), pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], ["shard", "level", "block", "heads", "members", "words"])
                give_back()

    def answer(batches):
        now, grams, contexts = None, {}, {}
        for batch in batches:
            for shard, level, block, heads, members, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (shard, level) != now:
                    now = shard, level
                    grams, contexts = mapped(model.file(level, shard, "grams")), mapped(model.file(level, shard, "contexts"))
                none = np.zeros(0, np.uint64)
                if level == 1:
                    at, there = _found(grams.get("key", none), risen(words))
                    counts, sums = packed(_picked(grams.get("count", none), at, there), WIDE), packed(_picked(grams.get("occurs", none), at, there), WIDE)
                else:
                    heads = risen(heads)
                    key = mix(np.repeat(heads, unpacked(members, 4).astype(np.int64)), unpacked(words, 5))
                    at, there = _found(grams.get("key", none), key)
                    counts = packed(_picked(grams.get("count", none), at, there), WIDE)
                    at, there = _found(contexts.get("context", none), heads)
                    sums = b"".join(packed(_picked(contexts.get(n, none), at, there), WIDE) for n in ("total", "one", "two", "more"))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([level], pa.int32()), pa.array([shard], pa.int32()), pa.array([counts], pa.binary()), pa.array([sums], pa.binary())], [f.split()[0] for f in ANSWER.split(", ")])
        give_back()

    rows = table.select("block", "sizes", "hashes", "tokens").mapInArrow(ask, "shard int, level int, block bigint, heads binary, members binary, words binary")
    return rows.repartition("shard").sortWithinPartitions("level", "shard").mapInArrow(answer, ANSWER)


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0)


def _probabilities(g: Grams, model: Model, given: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Each place's occurrences in training and its interpolated probability; ``given`` are the answers by order."""
    shard, _, key, _, row = asked(g, 1, model.shards, model.hot)
    counts, occurs = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    counts[shard >= 0], occurs[shard >= 0] = (x.astype(np.int64) for x in given[1])
    for at in np.flatnonzero(shard < 0):
        counts[at], occurs[at] = model.hot_words.get(int(key[at].astype(np.int64)), (0, 0))
    total, *kinds = model.lowest
    d = model.discounts[1]
    p = np.full(len(key), 1 / (model.words + 1))
    if total:
        p = (_discounted(counts, d) + p * sum(x * n for x, n in zip(d, kinds, strict=True))) / total
    p, occurs = p[row], occurs[row]
    for level in range(2, model.order + 1):
        shard, context, key, _, row = asked(g, level, model.shards, model.hot)
        counts, sums = given[level]
        heads = _edges(shard, context)
        sums = sums.reshape(4, -1).astype(np.float64)
        if level == 2:
            for at in np.flatnonzero(np.isin(context[heads], model.hot)):
                sums[:, at] = model.hot_contexts.get(int(context[heads[at]].astype(np.int64)), (0, 0, 0, 0))
        group = np.repeat(np.arange(len(heads)), _sizes(heads, len(key)))
        total, kinds = sums[0][group], sums[1:][:, group]
        d = model.discounts[level]
        known = total > 0
        kept = np.where(known, sum(x * n for x, n in zip(d, kinds, strict=True)) / np.maximum(total, 1), 1.0)
        own = np.where(known, _discounted(counts.astype(np.int64), d) / np.maximum(total, 1), 0.0)
        p = own[row] + kept[row] * p
    return occurs, p


def scores(table: DataFrame, model: Model, answered: DataFrame) -> DataFrame:
    """One row a document of the blocks, from the shards' answers."""
    blank = {"level": "int", "shard": "int", "counts": "binary", "sums": "binary"}
    own = ["ids", "held", "sizes", "hashes", "tokens"]
    types = dict(table.dtypes)
    both = table.select("block", F.lit(0).alias("part"), *own, *(F.lit(None).cast(t).alias(n) for n, t in blank.items())).unionByName(
        answered.select("block", F.lit(1).alias("part"), *(F.lit(None).cast(types[n]).alias(n) for n in own), *blank)
    )
    both = both.repartition("block").sortWithinPartitions("block", "part", "level", "shard")

    def finish(block, given):
        g = Grams(block.sizes, block.hashes, block.tokens, model.order)
        none = np.zeros(0, np.uint64)
        joined = {}
        for level in range(1, model.order + 1):
            parts = given.get(level, [])
            counts = np.concatenate([unpacked(c, WIDE) for c, _ in parts]) if parts else none
            sums = [np.concatenate([unpacked(s[k * len(s) // 4 : (k + 1) * len(s) // 4], WIDE) for k in range(4)]).reshape(4, -1) if level > 1 else unpacked(s, WIDE) for _, s in parts]
            joined[level] = counts, np.concatenate(sums, axis=-1) if sums else none
        occurs, p = _probabilities(g, model, joined)
        base = np.log10((occurs + ADDED) / (model.tokens + ADDED * (model.words + 1)))
        first = g.starts[:-1]
        n, known, base, score = g.sizes, np.add.reduceat(occurs > 0, first, dtype=np.int64), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)
        with np.errstate(over="ignore"):
            perplexity = 10 ** (-score / n)
        columns = [pa.array(block.ids, pa.int64()), pa.array(unpacked(block.held, 1) > 0), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(base), pa.array(score), pa.array(perplexity)]
        give_back()
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCORED.split(", ")])

    def read(batches):
        block, given = None, {}
        for batch in batches:
            names = batch.schema.names
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = dict(zip(names, row, strict=True))
                if r["part"] == 0:
                    if block is not None:
                        yield finish(block, given)
                    block, given = SimpleNamespace(**r), {}
                else:
                    given.setdefault(r["level"], []).append((r["counts"], r["sums"]))
        if block is not None:
            yield finish(block, given)

    return both.mapInArrow(read, SCORED)


def perplexity(docs: DataFrame, order: int = ORDER, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, hot: float = HOT) -> DataFrame:
    """Train on the rows of ``docs`` that are not held out, and score them all."""
    spark = docs.sparkSession
    table = written(blocks(docs, fold(F.col("doc_id"), FOLDS) == HELD_OUT, block_tokens, hot), "tokens")
    model = train(table, order, shard_tokens, hot)
    with shuffles_dropped(spark):
        answered = written(answers(table, model), "answers")
    discard(spark, [model.uri])
    return scores(table, model, answered)
