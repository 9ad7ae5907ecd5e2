"""Near-duplicate documents by BagMinHash over multisets of five-word shingles.

Each shingle runs Poisson processes over the dyadic intervals [0,1), [1,2), [2,4), ... of its
weight (its count in the text, so weights are discretised at whole numbers). A point of a
process has a time, a register and a path of fair bits that leads down the halves of the
interval to a level; it counts if the level is below the weight. A register keeps the
earliest time. Two texts agree in a register with a probability that is their weighted
Jaccard similarity. Processes stop once they are later than all registers of their text.

Registers are banded. Texts of equal multisets are one node; in each band's bucket all nodes
are compared to one centre, exactly, by the overlap of the multisets. Where nodes of a bucket
stay apart, every pair of them that is not in one component yet is compared, too, in the first
bucket that both share. Large buckets are dealt out as pairs of blocks, which give links only,
so no table of pairs is ever made. Components of the links are the classes.

Defined results: words are runs without blanks, in lower case; a text of one to four words
is one shingle; a text without words (or null) is in a class of its own for each row's
doc_id. The class id is the least doc_id of the class; kept is true for the document with
that id. Rows that share doc_id and text share a result. A null doc_id links like any other,
but gives a class no id: the class id is null, and kept true, where a class has null ids only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpointed, release, small_batches, written
from .graph import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
#: Shingles that one vectorised step takes together, unless one text alone has more.
STEP = 200_000
REMEMBERED = 300_000
#: Members of a block, about, of a bucket whose nodes stay apart; a group holds two blocks.
BLOCK = 512
_GOLD = 0x9E3779B97F4A7C15


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        n = xxhash.xxh64_intdigest(word)
        if len(word) <= 64 and len(self) < REMEMBERED:
            self[word] = n
        return n


def _stream(k: int) -> np.uint64:
    return np.uint64(k * _GOLD & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, hashes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a whole text and their counts."""
    words = text.lower().encode().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    a = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(a) - WORDS + 1)
    out = np.full(n, np.uint64(len(a) if len(a) < WORDS else WORDS))
    for k in range(min(WORDS, len(a))):
        out = mix(out * np.uint64(31) + a[k : k + n])
    return np.unique(out, return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """The earliest times, one row of ``registers`` for each multiset; all must have shingles."""
    times = np.full(len(sets) * registers, np.inf)
    doc, seed, low, weight = [], [], [], []
    for i, (h, n) in enumerate(sets):
        for j in range(int(n.max()).bit_length() + 1):
            start = 0 if j == 0 else 1 << (j - 1)
            has = n > start
            if not has.any():
                break
            doc.append(np.full(int(has.sum()), i))
            seed.append(mix(h[has] + _stream(j)))
            low.append(np.full(int(has.sum()), float(start)))
            weight.append(n[has].astype(float))
    doc, seed, low, weight = map(np.concatenate, (doc, seed, low, weight))
    width = np.maximum(low, 1.0)
    part, at, k = (weight - low) / width, np.zeros(len(doc)), 0
    while len(doc):
        k += 1
        one = mix(seed + _stream(k))
        at = at - np.log(((one >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / (registers * width)
        two = mix(one ^ np.uint64(_GOLD))
        inside = (two >> np.uint64(32)).astype(float) * 2.0**-32 < part
        np.minimum.at(times, doc[inside] * registers + (two[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64) % registers, at[inside])
        on = at < times.reshape(-1, registers).max(axis=1)[doc]
        doc, seed, width, part, at = doc[on], seed[on], width[on], part[on], at[on]
    return times.reshape(-1, registers)


def bands_of(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash for each band of each row of ``times``, of the band's number and times."""
    bits = np.ascontiguousarray(times).view(np.uint64).reshape(len(times), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_GOLD), bits.shape[:2]).copy()
    for k in range(rows):
        out = mix(out * np.uint64(31) + bits[:, :, k])
    return out.view(np.int64)


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets: sum of minima over sum of maxima."""
    (a, n), (b, m) = x, y
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / max(1, int(n.sum() + m.sum()) - both)


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key, node (digest of the multiset, null without words) and band hashes."""

    def read(batches):
        hashes = _Hashes()
        for batch in batches:
            ids, keys = batch.column(0), batch.column(2)
            nodes, found, seen, held, size = [None] * len(ids), [None] * len(ids), {}, [], 0

            def flush(held=held, nodes=nodes, found=found):
                if held:
                    for (i, _), b in zip(held, bands_of(signatures([s for _, s in held], bands * rows), bands, rows), strict=True):
                        found[i] = b.tolist()
                    held.clear()

            same = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = shingles(text or "", hashes)
                if not len(own[0]):
                    continue
                nodes[i] = node = hashlib.md5(own[0].tobytes() + own[1].tobytes()).hexdigest()
                if node in seen:
                    same.append((i, seen[node]))
                    continue
                seen[node] = i
                if size and size + len(own[0]) > STEP:
                    flush()
                    size = 0
                held.append((i, own))
                size += len(own[0])
            flush()
            for i, first in same:
                found[i] = found[first]
            yield pa.RecordBatch.from_arrays([ids, keys, pa.array(nodes, pa.string()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text_key", "node", "bands"])

    small_batches(docs.sparkSession)
    rows_ = docs.select(F.col("doc_id").cast("long"), "text", _text_key(F.col("text")).alias("text_key"))
    return rows_.mapInArrow(read, "doc_id bigint, text_key string, node string, bands array<bigint>")


def _text_key(text):
    return F.md5(F.coalesce(text, F.lit("")))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose multisets overlap to SIMILARITY; ``texts`` has node and text.

    Only the texts of pairs are shuffled: that of b once for each pair, that of a once for each
    share of BLOCK of its pairs, so a centre of very many is not copied for each of them.
    """
    # Only centres of many are in the table of shares, so no join brings a centre's pairs together.
    shares = checkpointed(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("shares")).where("shares > 1"))
    shares = F.broadcast(shares) if shares.count() <= BROADCAST_ROWS else shares
    dealt = pairs.join(shares, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("shares", F.lit(1))).alias("share"))
    dealt = checkpointed(dealt)
    ends = dealt.select("a", "share", F.col("b").alias("node")).unionByName(dealt.select("a", "share", F.col("a").alias("node")).distinct())
    ends = F.broadcast(ends) if dealt.count() <= BROADCAST_ROWS else ends
    rows = texts.join(ends, "node").select("a", "share", (F.col("node") != F.col("a")).alias("other"), "node", "text")
    rows = rows.repartition("a", "share").sortWithinPartitions("a", "share", "other")

    def check(batches):
        hashes, last, own = _Hashes(), None, None
        for batch in batches:
            a, b = [], []
            for centre, share, other, node, text in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                mine = shingles(text.as_py() or "", hashes)
                if not other:
                    last, own = (centre, share), mine
                elif last == (centre, share) and similarity(own, mine) >= SIMILARITY:
                    a.append(centre)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(check, "a long, b long")


def _linked(group: list[tuple]) -> list[tuple[int, int]]:
    """Links between members of a block pair; those inside a component so far are left out.

    A member is (bucket, i, j, id, block, part, bands, shingles). If i and j differ, only members
    of different blocks are compared; the rest are compared where i and j are equal.
    """
    buckets, i, j, ids, blocks, parts, bands, sets = zip(*group, strict=True)
    block, keys, size = np.array(blocks), np.array(bands), np.array([int(n.sum()) for _, n in sets])
    root, out = np.unique(parts, return_inverse=True)[1], []
    for x in range(len(group) - 1):
        rest = slice(x + 1, None)
        # The sum of minima is at most the smaller size, that of maxima at least the larger.
        fit = (root[rest] != root[x]) & (np.minimum(size[rest], size[x]) >= SIMILARITY * np.maximum(size[rest], size[x]))
        if i[0] != j[0]:
            fit &= block[rest] != block[x]
        at = x + 1 + np.flatnonzero(fit)
        for y in at[keys[x][(keys[at] == keys[x]).argmax(axis=1)] == buckets[0]]:
            if root[y] != root[x] and similarity(sets[x], sets[y]) >= SIMILARITY:
                out.append((ids[x], ids[y]))
                root[root == root[y]] = root[x]
    return out


def _compare(batches):
    hashes, group = _Hashes(), []

    def links():
        found = _linked(group) if group else []
        group.clear()
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and group[0][:3] != row[:3]:
                yield links()
            group.append((*row[:-1], shingles(row[-1] or "", hashes)))
    yield links()


def apart(buckets: DataFrame, found: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) among all pairs that share a bucket and are in different parts of ``found``.

    A large part of a bucket has blocks of its own, as its nodes need no comparison with each
    other; block pairs of a single part are left out.
    """
    rows = buckets.select("bucket", "id").join(found.select(F.col("a").alias("id"), F.col("b").alias("part")), "id", "left").withColumn("part", F.coalesce("part", "id"))
    sizes = rows.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    several = sizes.groupBy("bucket").agg(F.count("*").alias("parts")).where("parts > 1").select("bucket")
    sizes = sizes.join(several, "bucket").withColumn("own", F.when(F.col("n") >= BLOCK // 4, F.col("part")).otherwise(-1))
    blocks = sizes.groupBy("bucket", "own").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    dealt = sizes.select("bucket", "part", "own").join(blocks, ["bucket", "own"])
    turn = F.when(F.col("own") < 0, F.xxhash64("part")).otherwise(F.xxhash64("id"))
    rows = checkpointed(rows.join(dealt, ["bucket", "part"]).select("bucket", "id", "part", F.xxhash64("own", F.pmod(turn, F.col("blocks"))).alias("block")))
    held = checkpointed(rows.groupBy("bucket", "block").agg(F.min("part").alias("lo"), F.max("part").alias("hi")))
    x, y = held.alias("x"), held.alias("y")
    differ = F.least("x.lo", "y.lo") < F.greatest("x.hi", "y.hi")
    two = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.block") <= F.col("y.block")) & differ).select("x.bucket", F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    sides = two.select("bucket", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    sent = rows.join(sides, ["bucket", "block"])
    members = sent.join(nodes.select("id", "bands"), "id").join(texts.withColumnRenamed("node", "id"), "id")
    members = members.select("bucket", "i", "j", "id", "block", "part", "bands", "text").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")
    return members.mapInArrow(_compare, "a long, b long")


def distinct_nodes(sketch: DataFrame) -> DataFrame:
    """One row for each distinct multiset, whatever its copies, with a short number, id."""
    rows = sketch.where("node is not null").groupBy("node")
    rows = rows.agg(F.min("doc_id").alias("least"), F.min_by(F.struct("doc_id", "text_key", "bands"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("row"))
    rows = rows.select(F.monotonically_increasing_id().alias("id"), "node", "least", "row.*")
    return written(rows, "minhash-nodes")


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): ids of nodes with the least id of their component, for nodes that are linked."""
    spark = docs.sparkSession
    rows = nodes.select("id", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("centre")).where("n > 1")
    buckets = checkpointed(rows.join(shared.select("bucket", "centre"), "bucket"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key(F.col("text")).alias("text_key"))
    wanted = nodes.select("id", "doc_id", "text_key").join(buckets.select("id").distinct(), "id")
    # A node whose copies all have a null id is found by that.
    same = named["doc_id"].eqNullSafe(wanted["doc_id"]) & (named["text_key"] == wanted["text_key"])
    texts = named.join(wanted, same).select(F.col("id").alias("node"), "text").dropDuplicates(["node"])
    texts = written(texts, "minhash-texts")
    tried = checkpointed(buckets.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct())
    found = components(verified(tried, texts))
    release(spark)
    new = checkpointed(apart(buckets, found, nodes, texts))
    if not new.isEmpty():
        found = components(found.unionByName(new))
    return found


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, part (the class, by its least node's id) and class_id of each row."""
    sketch = written(sketches(docs), "minhash-sketches")
    nodes = distinct_nodes(sketch)
    found = links(docs, nodes).select(F.col("a").alias("id"), F.col("b").alias("part"))
    parts = nodes.select("id", "node", "least").join(found, "id", "left").withColumn("part", F.coalesce("part", "id"))
    least = parts.groupBy("part").agg(F.min("least").alias("class_id"))
    parts = checkpointed(parts.join(least, "part").select("node", "part", "class_id"))
    rows = sketch.select("doc_id", "text_key", "node").join(parts, "node", "left")
    return rows.select("doc_id", "text_key", "part", F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and kept of every row of ``docs``."""
    return classes(docs).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class of ``docs``, and all rows without words, all columns as they were.

    The row with the least doc_id stays, of several those with the least digest of the text.
    """
    rows = classes(docs).where("part is not null").groupBy("part", "doc_id", "text_key").agg(F.count("*").alias("n"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("~"))
    least = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "n")).alias("row")).select("row.*")
    stay = checkpointed(least.select(name.alias("_id"), F.col("text_key").alias("_key"), F.col("n").alias("_copies")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    empty = F.length(F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", "")) == 0
    named = docs.select(row, F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("~")).alias("_id"), _text_key(F.col("text")).alias("_key"), empty.alias("_empty"))
    kept = named.where("not _empty").join(stay, ["_id", "_key"])
    if not stay.where("_copies > 1").isEmpty():
        kept = kept.where("_copies = 1").unionByName(kept.where("_copies > 1").dropDuplicates(["_id", "_key"]))
    return kept.select("_row.*").unionByName(named.where("_empty").select("_row.*"))
