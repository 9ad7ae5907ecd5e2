"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into chunks that no piece of the vocabulary spans: before blanks, and between two
characters that stand side by side in no piece.
The distinct chunks of the corpus explode into their substrings of bounded length, an equi-join
with the piece table leaves the lattice's edges, edges are grouped by chunk, and a Spark
higher-order aggregate folds the best path over them (Viterbi).

One fold serves both kinds of model file. In a unigram model every step from one edge to the
next is allowed and the sum of scores decides. In a BPE model scores are merge priorities, and
a path is the model's own encoding just if no merge would cross the border of two neighbours
before either of them had grown over it. That can be told from the two edges and the edges that
cross the border, so steps that fail it are not allowed; one path is left to each position, the
reference algorithm's.

Texts meet the ids of their chunks by blocks: a block's texts become numbers of its distinct
tokens, packed; the chunks go out to the lattice with block and number, their ids come back to
the block. Nothing is collected, and no text is shuffled but as packed numbers.

Defined results: a null text counts as empty and has no ids. Repeated rows repeat, null ids
stay. Characters outside the vocabulary become their bytes' pieces, or the unknown piece in a
model without them. ``round_trip`` tells if decoding gives the text back; it fails only where
unknown pieces or the mark of a space stand in the text.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of text in a block, about; a longer text is a block of its own.
BLOCK = 1 << 25
#: Bytes of text that one vectorised step of the first pass takes together, unless one text has more.
SLICE = 1 << 21
#: A key has a block's number within its partition (18 bits), the partition (21) and a chunk's number (24).
CHUNK_BITS, PARTITION_BITS = 24, 21
#: Blocks that share one encoding of a chunk; a frequent chunk is encoded again beyond them.
SHARED_BITS = 12
#: Positions that one turn of the outer fold takes.
WINDOW = 64
#: Tokens that one vectorised step of the second pass takes together, unless one text has more.
STEP = 200_000
SPACE = "▁"
UNIGRAM, BPE = 1, 2
_NEVER = 1 << 30


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message; varints are ints, all else bytes."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    """pieces: (text, score) of each id; kinds: 1 normal, 2 unknown, 3 control, 6 byte."""

    pieces: list[tuple[str, float]]
    kinds: list[int]
    algorithm: int

    def __post_init__(self):
        self.ids = {p: i for i, ((p, _), k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (1, 4)}
        self.unknown = self.kinds.index(2) if 2 in self.kinds else 0
        self.bytes = {int(p[3:5], 16): i for i, ((p, _), k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        levels = {s: n for n, s in enumerate(sorted({self.pieces[i][1] for i in self.ids.values()}, reverse=True))}
        self.ranks = {p: levels[self.pieces[i][1]] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        inner = [p for p in self.ids if SPACE in p.lstrip(SPACE)]
        if inner:
            raise ValueError(f"pieces that span words are not supported: {inner[:3]}")
        pairs = {ord(a) << 32 | ord(b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        #: The pairs of characters that stand side by side in a piece, sorted.
        self.pairs = np.array(sorted(pairs) or [-1], np.int64)

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def raw(self, i: int) -> bytes:
        """The bytes that a piece stands for in a text."""
        if i in self.byte_of:
            return bytes([self.byte_of[i]])
        return b"" if self.kinds[i] == 3 else self.pieces[i][0].replace(SPACE, " ").encode()

    def merges(self, piece: str) -> tuple[int, list[int]] | None:
        """The border that a piece's last merge takes away, and for each inner border the rank of the merge that does.

        None if merging its characters does not end in the piece; such a piece is never used.
        """
        ends, gone = list(range(len(piece) + 1)), [0] * (len(piece) - 1)
        last = 0
        while len(ends) > 2:
            rank, k = min((self.ranks.get(piece[ends[k - 1] : ends[k + 1]], _NEVER), k) for k in range(1, len(ends) - 1))
            if rank == _NEVER:
                return None
            last = ends.pop(k)
            gone[last - 1] = rank
        return last, gone

    def table(self) -> list[tuple]:
        """(piece, id, score, rank, border, gone) of each piece that a path may use; border 0 stands for none."""
        if self.algorithm != BPE:
            return [(p, i, float(self.pieces[i][1]), 0, 0, []) for p, i in self.ids.items()]
        known = ((p, i, self.merges(p)) for p, i in self.ids.items())
        return [(p, i, 0.0, self.ranks[p], *m) for p, i, m in known if m is not None]


def read_model(path: str = MODEL) -> Model:
    """The model file, read on the driver; fields 1 (pieces) and 2 (trainer, with its type)."""
    pieces, kinds, algorithm = [], [], UNIGRAM
    for number, value in _fields(Path(path).read_bytes()):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0))
            kinds.append(own.get(3, 1))
        elif number == 2:
            algorithm = dict(_fields(value)).get(3, UNIGRAM)
    return Model(pieces, kinds, algorithm)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs between blanks of all texts, without the one blank before each, and how many each text has.

    Further blanks stay in front of their run, as marks.
    """
    texts = pc.binary_replace_slice(texts, 0, 0, " ")
    split = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "  ", " " + SPACE), SPACE + " ", SPACE * 2), " ")
    # What stands before the first blank is empty; an empty text leaves one more empty run.
    bounds = split.offsets.to_numpy()
    counts = np.diff(bounds) - 1
    keep = np.ones(bounds[-1] - bounds[0], bool)
    keep[bounds[:-1] - bounds[0]] = False
    none = pc.equal(pc.binary_length(texts), 1).to_numpy(zero_copy_only=False)
    keep[bounds[:-1][none] - bounds[0] + 1] = False
    counts[none] = 0
    return split.flatten().filter(pa.array(keep)), counts


def named(chunk):
    """A short key of a chunk: itself, or the digest of a long one, which no chunk equals."""
    return F.when(F.length(chunk) <= WINDOW, chunk).otherwise(F.concat(F.lit("\n"), F.sha2(chunk, 256)))


def lattice(words: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``words`` (chunk and other columns) with ``edges``, one row for each value of ``keys``.

    An edge is a substring that is a piece, or a character that is in none (id -1). The piece
    table has the vocabulary's rows, so it is broadcast; it is joined by the substring's digest
    and then the substring. A frame that is partitioned by its keys is not shuffled again; all
    that is no key goes with the edge of the first character only. A running number leads the
    keys, so that rows come in the order in which they are sorted for grouping.
    """
    spark = words.sparkSession
    table = model.table()
    worst = min((x[2] for x in table), default=0.0) - 10.0
    if len({xxhash.xxh64_intdigest(p[0].encode(), 42) for p in table}) < len(table):
        raise ValueError("two pieces share a digest")
    pieces = spark.createDataFrame(table, "piece string, id int, score double, m int, cut int, gone array<int>").withColumn("digest", F.xxhash64("piece"))
    more = [c for c in words.columns if c not in keys]
    rows = words.withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("w", F.expr(f"explode(sequence(0, (length(chunk) - 1) div {WINDOW}))"))
    rows = rows.withColumn("part", F.expr(f"substring(chunk, int(w * {WINDOW}) + 1, {WINDOW + model.longest})"))
    rows = rows.withColumn("k", F.expr(f"explode(sequence(0, least({WINDOW}, length(part)) - 1))"))
    rows = rows.withColumn("n", F.expr(f"explode(sequence(1, least({model.longest}, length(part) - k)))"))
    rows = rows.withColumn("sub", F.expr("substring(part, k + 1, n)")).withColumn("s", F.expr(f"int(w * {WINDOW}) + k"))
    rows = rows.withColumn("rider", F.when((F.col("s") == 0) & (F.col("n") == 1), F.struct(*more)))
    rows = rows.select("row", *keys, "s", "n", "sub", "rider")
    # Joined by digest, then compared: two join keys would be looked up by their bytes, five times as slow.
    rows = rows.join(F.broadcast(pieces), F.xxhash64("sub") == F.col("digest"), "left").where("n = 1 or sub = piece")
    rows = rows.withColumn("known", F.expr("coalesce(sub = piece, false)"))
    edge = "s + n as e, s, if(known, id, -1) as id, "
    if model.algorithm == BPE:
        edge = f"struct({edge}if(known, m, 0) as m, if(known and cut > 0, s + cut, -1) as c, if(known, gone, array()) as gone)"
    else:
        edge = f"struct({edge}if(known, score, {worst!r}D) as score)"
    rows = rows.groupBy("row", *keys).agg(F.sort_array(F.collect_list(F.expr(edge))).alias("edges"), F.first("rider", ignorenulls=True).alias("rider"))
    return rows.select(*keys, "rider.*", "edges")


def fold_best_path(edges: DataFrame, model: Model) -> DataFrame:
    """``edges`` with ``path``: the edges (s, e, id) of the best path of each chunk, in order.

    The fold goes over the edges in the order of their ends. Each position keeps its best edge;
    ties go to the later start, then the larger id. A step from edge b over border p to edge x
    is not allowed if a merge y that takes p away lies in both, and starts and ends at borders
    that b and x still have when its turn comes; of equal merges the left one is first. What y
    asks of b is asked when y is met, as b is known by then. Long chunks are folded in windows,
    of which only the last positions are carried on, so the time is linear in the chunk.
    """
    reach = model.longest
    split = "transform(starts, (a, j) -> slice(edges, a + 1, if(j + 1 < size(starts), starts[j + 1], size(edges)) - a))"
    rows = edges.withColumn("starts", F.expr(f"if(edges[size(edges) - 1].e <= {WINDOW}, array(0), filter(transform(edges, (x, i) -> if(i = 0 or (edges[i - 1].e - 1) div {WINDOW} <> (x.e - 1) div {WINDOW}, i, -1)), i -> i >= 0))"))
    if model.algorithm == BPE:
        # Exactly one edge to each position is allowed. Edges are kept by their places (``i`` is that of the next one),
        # as all that an accumulator holds is copied at each turn; ``at`` is the position of the first one kept.
        first, kind, met_kind, edge, real = "-1", "int", "int", "edges[{0}]".format, "x >= 0"
        last, state = "z.at + size(z.best) - 1", ", z.i as i, z.at as at"
        c = "edges[z.best[x.c - z.at]]"
        allowed = "not exists(z.live, y -> edges[y].c = x.s and edges[y].e <= x.e and (edges[y].e = x.e or x.gone[edges[y].e - x.s - 1] >= edges[y].m))"
        met = f"x.c > 0 and x.s >= {c}.s and (x.s = {c}.s or {c}.gone[x.s - {c}.s - 1] > x.m)"
        best = f"if({last} < x.e and {allowed}, array_append(z.best, z.i), z.best)"
        live = f"if({met}, array_append(z.live, z.i), z.live)"
        turn = f"struct({best} as best, {live} as live, z.i + 1 as i, z.at as at)"
        carried, begun = f", a.i as i, a.at + greatest(size(a.best) - {reach}, 0) as at", ", 0 as i, 0 as at"
        end = "a.at + size(a.best) - 1"
    else:
        first, kind, met_kind, edge, real = "struct(0D as score, 0 as s, -1 as id, 0 as e)", "struct<s:int,e:int,id:int>", "struct<e:int>", "{0}".format, "x.e > 0"
        last, state, carried, begun = "z.best[size(z.best) - 1]", "", "", ""
        new = "struct(z.best[x.s - z.best[0].e].score + x.score as score, x.s as s, x.id as id, x.e as e)"
        turn = f"struct(case when {last}.e < x.e then array_append(z.best, {new}) when {new} > {last} then array_append(slice(z.best, 1, size(z.best) - 1), {new}) else z.best end as best, z.live as live)"
        end = "a.best[size(a.best) - 1].e"
    none, step = "cast(array() as array<struct<s:int,e:int,id:int>>)", f"struct({edge('x')}.s as s, {edge('x')}.e as e, {edge('x')}.id as id)"
    logged = "slice(a.best, size(z.best) + 1, size(a.best))" if model.algorithm == BPE else f"transform(filter(a.best, x -> x.e > z.best[size(z.best) - 1].e), x -> {step})"
    begin = f"array({first}) as best, cast(array() as array<{met_kind}>) as live{begun}"
    inner = f"aggregate(reverse({{0}}), struct({{1}} as at, {none} as path), (y, x) -> if({real} and {edge('x')}.e = y.at, struct({edge('x')}.s as at, array_append(y.path, {step}) as path), y))"
    whole = f"transform(array(aggregate(edges, struct({begin}), (z, x) -> {turn}, z -> z.best)), b -> reverse({inner.format('b', 'length(chunk)')}.path))[0]"
    window = f"aggregate(own, struct(z.best as best, z.live as live{state}), (z, x) -> {turn})"
    kept = f"struct(slice(a.best, -least(size(a.best), {reach}), {reach}) as best, filter(a.live, y -> {edge('y')}.e > {end} - {reach}) as live{carried}, array_append(z.log, {logged}) as log)"
    log = f"aggregate({split}, struct({begin}, cast(array() as array<array<{kind}>>) as log), (z, own) -> transform(array({window}), a -> {kept})[0], z -> z.log)"
    back = f"aggregate(reverse({log}), struct(length(chunk) as at, cast(array() as array<array<struct<s:int,e:int,id:int>>>) as path), (z, v) -> transform(array({inner.format('v', 'z.at')}), y -> struct(y.at as at, array_append(z.path, y.path) as path))[0], z -> reverse(flatten(z.path)))"
    return rows.withColumn("path", F.expr(f"if(size(starts) = 1, {whole}, {back})")).drop("edges", "starts")


def encoded_chunks(words: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``words`` (each chunk once for its ``keys``) with ids, through the lattice and its fold."""
    rows = fold_best_path(lattice(words, model, keys), model)
    first = model.bytes.get(0)
    if first is None:
        spell = f"array({model.unknown})"
    else:  # the pieces of the 256 bytes stand in order
        spell = f"transform(sequence(0, octet_length(substring(chunk, y.s + 1, 1)) - 1), k -> {first} + cast(conv(substring(hex(encode(substring(chunk, y.s + 1, 1), 'UTF-8')), 2 * k + 1, 2), 16, 10) as int))"
    ids = F.expr(f"case when exists(path, y -> y.id < 0) then flatten(transform(path, y -> case when y.id < 0 then {spell} else array(y.id) end)) else path.id end")
    return rows.withColumn("ids", ids).drop("path")


def decode_ids(ids: list[int], model: Model) -> str:
    """The text of ids: bytes are joined, marks become spaces and the first goes."""
    text = b"".join(map(model.raw, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def decode(rows: DataFrame, model: Model, ids: str = "ids") -> DataFrame:
    """``rows`` with the text of their ids in ``decoded``; null ids give null."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    of = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else decode_ids(list(x), shared.value)), "string")
    return rows.withColumn("decoded", of(F.col(ids)))


@dataclass
class _Block:
    """A block's rows and the numbers of their tokens; all strings are Arrow's, outside Python's heap."""

    key: int
    ids: pa.Array
    sums: np.ndarray
    counts: np.ndarray
    seq: np.ndarray
    tokens: pa.Array


def _blocks(batches):
    """The blocks of a partition; numbers are given in the order in which tokens come."""
    n, size, held = 0, 0, []

    def block():
        ids, sums, counts, seqs, words = zip(*held, strict=True)
        # Each slice has its own numbers; the slices' words are numbered once more together.
        both = pa.concat_arrays(words).dictionary_encode()
        own, starts = both.indices.to_numpy().astype(np.uint32), np.cumsum([0, *map(len, words)])
        seq = np.concatenate([own[a:][x] for a, x in zip(starts, seqs, strict=False)])
        return _Block((n << PARTITION_BITS | partition) << CHUNK_BITS, pa.concat_arrays(ids), np.concatenate(sums), np.concatenate(counts), seq, both.dictionary)

    for batch in batches:
        if not batch.num_rows:
            continue
        partition = batch.column(2)[0].as_py()
        texts = pc.fill_null(batch.column(1), "")
        upto, at = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)), 0
        while at < batch.num_rows:
            before = int(upto[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + SLICE, "right")))
            some = texts.slice(at, end - at)
            words, counts = tokens(some)
            coded = words.dictionary_encode()
            sums = np.fromiter((xxhash.xxh64_intdigest(x.as_buffer()) for x in some), np.uint64, len(some))
            held.append((batch.column(0).slice(at, end - at), sums, counts.astype(np.uint32), coded.indices.to_numpy(), coded.dictionary))
            size += int(upto[end - 1]) - before
            if size >= BLOCK:
                yield block()
                n, size, held = n + 1, 0, []
            at = end
    if held:
        last, held = block(), []
        yield last


def _starts(data: pa.Buffer, bounds: np.ndarray, model: Model) -> np.ndarray:
    """Where the chunks of the tokens between ``bounds`` begin."""
    own = data.slice(int(bounds[0]), int(bounds[-1] - bounds[0]))
    chars = np.frombuffer(own.to_pybytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    pairs = chars[:-1] << 32 | chars[1:]
    cut = np.ones(len(chars), bool)
    cut[1:] = model.pairs[np.minimum(np.searchsorted(model.pairs, pairs), len(model.pairs) - 1)] != pairs
    opens = np.zeros(len(own), bool)
    opens[np.flatnonzero((np.frombuffer(own, np.uint8) & 0xC0) != 0x80)[cut]] = True
    opens[bounds[:-1] - bounds[0]] = True
    return (np.flatnonzero(opens) + bounds[0]).astype(np.int32)


def _chunked(words: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many chunks each token has, the numbers of all of them (from 1), and the distinct chunks.

    A token gets its blank's mark and is cut between characters that no piece holds side by side.
    """
    marked = pc.binary_replace_slice(words, 0, 0, SPACE)
    first, last = marked.offset, marked.offset + len(marked)
    bounds = np.frombuffer(marked.buffers()[1], np.int32)[first : last + 1]
    data = marked.buffers()[2].slice(int(bounds[0]), int(bounds[-1] - bounds[0]))
    bounds = bounds - bounds[0]
    starts = np.concatenate([*(_starts(data, bounds[k : k + STEP // 4 + 1], model) for k in range(0, len(words), STEP // 4)), bounds[-1:]])
    sizes = np.diff(np.searchsorted(starts, bounds))
    coded = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), data).dictionary_encode()
    return sizes.astype(np.uint32), coded.indices.to_numpy().astype(np.uint32) + np.uint32(1), coded.dictionary


def _packed(block: _Block, model: Model) -> bytes:
    """All that the second pass needs of a block but the ids of its chunks.

    Numbers are laid out byte by byte of equal weight, which packs them well.
    """
    sizes, flat, distinct = _chunked(block.tokens, model)
    head = struct.pack("<5Q", len(block.ids), len(sizes), len(flat), len(block.seq), len(distinct))
    out = zstandard.ZstdCompressor(level=3).compressobj()
    parts = [out.compress(head + pc.fill_null(block.ids, 0).to_numpy().tobytes() + pc.is_valid(block.ids).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes() + block.sums.tobytes())]
    for x in (block.counts, sizes, flat, block.seq):
        parts += [out.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4)[:, k]).tobytes()) for k in range(4)]
    return b"".join([*parts, out.flush()])


def _unpacked(data: bytes):
    data = memoryview(zstandard.ZstdDecompressor().decompressobj().decompress(data))
    n, t, f, q, chunks = struct.unpack_from("<5Q", data)
    at = 40

    def take(count: int, kind) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    ids, known, sums = take(n, np.int64), take(n, np.uint8), take(n, np.uint64)
    counts, sizes, flat, seq = (np.ascontiguousarray(take(4 * k, np.uint8).reshape(4, k).T).view(np.uint32).reshape(-1) for k in (n, t, f, q))
    return ids, known, sums, counts, sizes, flat, seq, chunks


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all runs, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and (not len(starts) or int(starts.max()) < 1 << 31) else np.int64
    return np.arange(total, dtype=kind) + np.repeat((starts - ends + sizes).astype(kind), sizes)


def _together(payload: bytes, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, model: Model):
    """The result rows of a block from its packed texts and the ids of its chunks, in the order of their keys."""
    docs, known, sums, counts, per_token, flat, seq, chunks = _unpacked(payload)
    if len(keys) != chunks or not (keys == np.arange(1, chunks + 1)).all():
        raise RuntimeError(f"{chunks} chunks went out and {len(keys)} came back: the input was not the same when it was read again")
    starts = np.cumsum(sizes) - sizes
    raw = [model.raw(i) for i in range(len(model.pieces))]
    raw_sizes = np.array([len(x) for x in raw], np.int64)
    raw_starts, letters = np.cumsum(raw_sizes) - raw_sizes, np.frombuffer(b"".join(raw), np.uint8)
    chunk_ends, found = np.concatenate([[0], np.cumsum(per_token, dtype=np.int64)]), []
    for a in range(0, len(per_token), STEP // 4):
        some = per_token[a : a + STEP // 4]
        own = flat[chunk_ends[a] : chunk_ends[a + len(some)]].astype(np.int64) - 1
        spelled = ids[_runs(starts[own], sizes[own])]
        n = np.bincount(np.repeat(np.arange(len(some)), some), sizes[own], len(some)).astype(np.int64)
        widths = np.bincount(np.repeat(np.arange(len(some)), n), raw_sizes[spelled], len(some)).astype(np.int64)
        found.append((spelled, n, letters[_runs(raw_starts[spelled], raw_sizes[spelled])], widths))
    none = np.zeros(0, np.int64)
    token_ids, token_sizes, token_letters, token_widths = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none, none)
    flat = found = None
    id_starts, letter_starts = np.cumsum(token_sizes) - token_sizes, np.cumsum(token_widths) - token_widths
    ends = np.cumsum(counts, dtype=np.int64)
    a = 0
    while a < len(docs):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP, "right")))
        own = seq[(ends[a - 1] if a else 0) : ends[b - 1]].astype(np.int64)
        out = token_ids[_runs(id_starts[own], token_sizes[own])]
        bounds = np.concatenate([[0], ends[a:b] - (ends[a - 1] if a else 0)])
        upto = np.concatenate([[0], np.cumsum(token_sizes[own])])[bounds]
        good = np.zeros(b - a, bool)
        for k in range(b - a):
            digest, first = xxhash.xxh64(), 1
            for at in range(bounds[k], bounds[k + 1], STEP):
                part = own[at : min(at + STEP, bounds[k + 1])]
                digest.update(token_letters[_runs(letter_starts[part], token_widths[part])][first:].tobytes())
                first = 0
            good[k] = digest.intdigest() == int(sums[a + k])
        lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(out, pa.int32()))
        doc_ids = pa.array(docs[a:b], pa.int64(), mask=known[a:b] == 0)
        yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(upto), pa.int64()), lists, pa.array(good)], ["doc_id", "n_pieces", "ids", "round_trip"])
        a = b


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_pieces, ids and round_trip of every row of ``docs``.

    ``docs`` is read twice and must give its rows in equal partitions each time, as stored tables
    do; if it does not, the second pass stops with an error.
    """
    small_batches(docs.sparkSession)
    # Counts given by hand are not merged again: a partition of words grows to many times its size as a lattice.
    least, parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()
    spread, dealt = max(least, 3 * parts), max(least, 2 * parts)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("partition"))
    told = docs.sparkSession.sparkContext.broadcast(model)

    def out_chunks(batches):
        for block in _blocks(batches):
            distinct = _chunked(block.tokens, told.value)[2]
            for at in range(0, len(distinct), 20_000):
                some = distinct.slice(at, 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at + 1, at + 1 + len(some)) + block.key), some], ["key", "chunk"])
        block = distinct = some = None
        give_back()

    def out_texts(batches):
        for block in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([block.key], pa.int64()), pa.array([_packed(block, told.value)], pa.binary())], ["key", "data"])
        block = None
        give_back()

    words = rows.mapInArrow(out_chunks, "key long, chunk string")
    long_ = F.when(F.length("chunk") > WINDOW, F.col("chunk")).alias("long")
    words = words.select(named(F.col("chunk")).alias("name"), F.shiftright("key", CHUNK_BITS + SHARED_BITS).alias("bucket"), long_, "key")
    # Dealt by a number that stands for name and bucket: edges are grouped by it and the row's, without the name in each.
    deal = F.xxhash64("name", "bucket")
    words = words.repartition(spread, deal).withColumn("deal", deal)
    words = words.groupBy("deal", "name", "bucket").agg(F.collect_list("key").alias("keys"), F.first("long", ignorenulls=True).alias("long"))
    words = words.select("deal", F.coalesce("long", "name").alias("chunk"), "keys")
    coded = encoded_chunks(words, model, ["deal"])
    width = 2 if len(model.pieces) <= 1 << 16 else 4
    data = F.unhex(F.array_join(F.transform("ids", lambda x: F.lpad(F.hex(x), 2 * width, "0")), ""))
    # Texts go first, while no lattice fills the executors' memory beside the workers.
    back = rows.mapInArrow(out_texts, "key long, data binary").unionByName(coded.select(F.explode("keys").alias("key"), data.alias("data")))
    back = back.repartition(dealt, F.shiftright("key", CHUNK_BITS)).sortWithinPartitions("key")

    def put_together(batches):
        payload, keys, ids, sizes = None, [], [], []

        def finish():
            join = lambda held, kind: np.concatenate(held) if held else np.zeros(0, kind)
            return _together(payload, join(keys, np.int64), join(ids, np.uint32), join(sizes, np.int32).astype(np.int64), told.value)

        for batch in batches:
            key, at = batch.column(0).to_numpy(), 0
            first = np.flatnonzero(key & ((1 << CHUNK_BITS) - 1) == 0)
            for end in [*first.tolist(), batch.num_rows]:
                if end > at:
                    spelled = batch.column(1).slice(at, end - at)
                    bounds = np.frombuffer(spelled.buffers()[1], np.int32)[spelled.offset : spelled.offset + end - at + 1]
                    letters = np.frombuffer(spelled.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
                    keys.append(key[at:end] & ((1 << CHUNK_BITS) - 1))
                    ids.append(letters.copy().view(f">u{width}").astype(np.uint32))
                    sizes.append(np.diff(bounds) // width)
                if end < batch.num_rows:
                    if payload is not None:
                        yield from finish()
                    payload, keys, ids, sizes = batch.column(1)[end].as_py(), [], [], []
                at = end + 1
        if payload is not None:
            yield from finish()
        payload, keys, ids, sizes = None, [], [], []
        give_back()

    return back.mapInArrow(put_together, "doc_id bigint, n_pieces bigint, ids array<int>, round_trip boolean")
