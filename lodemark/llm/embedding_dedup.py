"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Each of TABLES tables hashes the normalised vector by PROJECTIONS Gaussian projections, each
shifted at random and cut into cells of WIDTH. Vectors in one bucket of one table are compared
exactly. A pair that shares several buckets is counted in the first such table only, which
both vectors' own hashes tell, so no table of pairs is ever made. Large buckets are dealt out
as pairs of blocks; a block pair gives link counts and the local components, never its pairs.
Equal vectors are one node with a multiplicity.

At cosine 0.95 two vectors (0.316 apart) share a cell with probability 0.874 and a bucket of
20 cells with 0.068, so one of 80 tables holds the pair with probability 0.996; closer pairs
are nearer to 1. Unrelated vectors share a bucket with probability 5e-7.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing: n_links 0, component_id their own vec_id, kept. Vectors of different
lengths never link. Rows that share a vec_id are separate vectors. A vector with a null vec_id
links and is counted like any other but gives a component no id: the component_id is null, and
kept true, where all ids of a component are null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches, written
from .graph import components

COSINE, TABLES, PROJECTIONS, WIDTH, SEED = 0.95, 80, 20, 2.0, 11
#: Members of a block, about; a group holds two blocks at most.
BLOCK = 1024
NODES = "vec_id bigint, node string, dim int, vector binary, keys array<int>"


def hash_keys(unit: np.ndarray) -> np.ndarray:
    """The bucket (32 bits) of each unit vector (a row) in each table."""
    n, dim = unit.shape
    random = np.random.default_rng([SEED, dim])
    lines = random.standard_normal((dim, TABLES * PROJECTIONS))
    shifts = random.uniform(0, WIDTH, TABLES * PROJECTIONS)
    cells = np.floor((unit @ lines + shifts) / WIDTH).astype(np.int64).reshape(n, TABLES, PROJECTIONS)
    factors = random.integers(1, 1 << 62, PROJECTIONS) | 1
    mixed = (cells * factors).sum(axis=2)
    return ((mixed ^ (mixed >> 29)) * 0x3C79AC492BA7B653 >> 32).astype(np.int32)


def nodes(vectors: DataFrame) -> DataFrame:
    """vec_id, node (digest of a usable vector, else null), its doubles and its buckets."""

    def read(batches):
        for batch in batches:
            ids, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by: dict[int, list] = {}
            out = [(None, None, None, None)] * len(ids)
            for i, v in enumerate(raw):
                if v and None not in v:
                    by.setdefault(len(v), []).append(i)
            for dim, own in by.items():
                x = np.array([raw[i] for i in own], float)
                with np.errstate(over="ignore", invalid="ignore"):
                    size = np.sqrt((x * x).sum(axis=1))
                good = np.isfinite(x).all(axis=1) & (size > 0) & np.isfinite(size)
                x, size, own = x[good], size[good], np.array(own)[good]
                if not len(x):
                    continue
                for i, v, k in zip(own, x, hash_keys(x / size[:, None]), strict=True):
                    data = v.tobytes()
                    out[i] = (hashlib.md5(data).hexdigest(), dim, data, k)
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            types = (pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["vec_id", "node", "dim", "vector", "keys"])

    small_batches(vectors.sparkSession)
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(read, NODES)


def _local_roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the least row of its component."""
    root = np.arange(len(linked))
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root)))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(batches):
    for batch in batches:
        for t, i, j, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            members.sort(key=lambda m: m["node"])
            x = np.stack([np.frombuffer(m["vector"], float) for m in members])
            x = x / np.sqrt((x * x).sum(axis=1))[:, None]
            keys = np.array([m["keys"] for m in members], np.int32)
            linked = x @ x.T >= COSINE
            np.fill_diagonal(linked, False)
            if i != j:
                block = np.array([m["block"] for m in members])
                linked &= block[:, None] != block[None, :]
            a, b = np.nonzero(np.triu(linked))
            if len(a):
                first = (keys[a] == keys[b]).argmax(axis=1) == t
                linked[a[~first], b[~first]] = linked[b[~first], a[~first]] = False
            if not linked.any():
                continue
            n = linked @ np.array([m["n"] for m in members], np.int64)
            root = _local_roots(linked)
            on = np.flatnonzero(n)
            name = [m["node"] for m in members]
            yield pa.RecordBatch.from_arrays([pa.array([name[k] for k in on]), pa.array(n[on]), pa.array([name[root[k]] for k in on])], ["node", "n", "root"])


def linked_nodes(named: DataFrame) -> DataFrame:
    """(node, n, root) for each block pair with links: links counted there, local component."""
    # Copies of a vector are equal in all but their id, so any of them serves; they combine before the shuffle.
    distinct = named.where("node is not null").groupBy("node").agg(F.count("*").alias("n"), *[F.any_value(c).alias(c) for c in ("dim", "vector", "keys")])
    distinct = written(distinct, "vectors")
    keyed = distinct.select("node", "dim", F.col("keys")[0].alias("first"), F.posexplode("keys").alias("t", "key"))
    sizes = keyed.groupBy("dim", "t", "key").agg(F.count("*").alias("size"), F.min("first").alias("lo"), F.max("first").alias("hi"))
    # A bucket whose members all share the first table's bucket owns no pair.
    sizes = sizes.where("size > 1 and (t = 0 or lo <> hi)").select("dim", "t", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = keyed.join(sizes, ["dim", "t", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("node", "dim", "t", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = rows.join(distinct.select("node", "n", "vector", "keys"), "node")
    groups = rows.groupBy("dim", "t", "key", "i", "j").agg(F.collect_list(F.struct("node", "n", "vector", "keys", "block")).alias("members"))
    return groups.select("t", "i", "j", "members").mapInArrow(_compare, "node string, n bigint, root string")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``."""
    named = written(nodes(vectors), "nodes")
    found = checkpointed(linked_nodes(named))
    roots = components(found.select("node", "root")).select(F.col("a").alias("node"), F.col("b").alias("part"))
    counts = found.groupBy("node").agg(F.sum("n").alias("links"))
    own = named.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    own = own.join(counts, "node", "left").join(roots, "node", "left").withColumn("part", F.coalesce("part", "node"))
    parts = own.groupBy("part").agg(F.min("least").alias("component_id"))
    own = checkpointed(own.join(parts, "part").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    rows = named.select("vec_id", "node").join(own, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
