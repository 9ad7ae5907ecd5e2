"""Fixpoints over edge tables: reachability, cycles, propagated values.

Each step is a join on a node; lineage is cut by checkpoints in the shared folder that the
cluster names, so a lost executor costs one step's work and plans stay short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoint import checkpointed, stored
from ..functions.joined import by_key


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth): nodes reachable from the seeds along (src, dst), with the least depth."""
    found = checkpointed(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front, depth = found, 0
    while True:
        depth += 1
        step = edges.join(by_key(front), front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = checkpointed(step.join(by_key(found.select("node")), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return found
        found = checkpointed(found.unionByName(front))


#: Random numbers that a node passes on at once to all that it leads to.
MARKS = 4


def _within_cycles(edges: DataFrame) -> DataFrame:
    """``edges`` without most of those that no cycle holds.

    Each node has random numbers and takes over the greatest of the nodes that lead to it. Nodes of one cycle are led to by
    the same nodes, so an edge whose ends have taken over other numbers is in none. Both directions take turns
    until one drops nothing; no edge of a cycle is ever dropped.
    """
    ends, turn, n, before = ("src", "dst"), 0, edges.count(), None
    names = [f"m{k}" for k in range(MARKS)]
    while n and n != before:
        turn += 1
        a, b = ends
        nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).distinct()
        state = checkpointed(nodes.select("node", *[F.xxhash64("node", F.lit(turn * MARKS + k)).alias(m) for k, m in enumerate(names)]))
        front = state
        while not front.isEmpty():
            passed = edges.join(by_key(front.withColumnRenamed("node", a)), a).groupBy(F.col(b).alias("node")).agg(*[F.max(m).alias(f"new_{m}") for m in names])
            # A union, as the planner's guess of a join's size is a product, whose digits would double with each step.
            both = state.unionByName(passed, allowMissingColumns=True).groupBy("node").agg(*[F.max(c).alias(c) for m in names for c in (m, f"new_{m}")])
            rose = F.coalesce(sum((F.col(f"new_{m}") > F.col(m)).cast("int") for m in names) > 0, F.lit(False))
            now = checkpointed(both.select("node", *[F.greatest(m, f"new_{m}").alias(m) for m in names], rose.alias("rose")))
            state, front = now.select("node", *names), now.where("rose").select("node", *names)
        marked = state.select("node", F.struct(*names).alias("marks"))
        both = edges.join(by_key(marked.select(F.col("node").alias("src"), F.col("marks").alias("of_src"))), "src").join(by_key(marked.select(F.col("node").alias("dst"), F.col("marks").alias("of_dst"))), "dst")
        # As files, whose size is known; a checkpoint keeps the guess, which grew with each step.
        edges = stored(both.where("of_src = of_dst").select("src", "dst"), "edges")
        n, before, ends = edges.count(), n, (b, a)
    return edges


def cycles(edges: DataFrame) -> DataFrame:
    """(cycle, length): all simple cycles, each once, from its least node on.

    Edges that no cycle can hold are dropped first. Paths start at a node and only visit larger ones, so each cycle has
    one start; they grow until none is left.
    """
    edges = _within_cycles(checkpointed(edges.where("src is not null and dst is not null").select("src", "dst").distinct()))
    paths = edges.where("dst >= src").select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"))
    out, length = None, 1
    while True:
        closed = checkpointed(paths.where("last = first").select(F.slice("path", 1, length).alias("cycle"), F.lit(length).alias("length")))
        out = closed if out is None else out.unionByName(closed)
        open_ = paths.where("last <> first")
        step = open_.join(by_key(edges), open_["last"] == edges["src"]).where("dst >= first and (dst = first or not array_contains(path, dst))")
        paths = checkpointed(step.select("first", F.col("dst").alias("last"), F.concat("path", F.array("dst")).alias("path")))
        if paths.isEmpty():
            return out
        length += 1


def contamination(nodes: DataFrame, edges: DataFrame, decay: float = 0.7) -> DataFrame:
    """(node, value): the greater of a node's own value and ``decay`` times its dependencies'.

    ``edges`` leads from a node to what it depends on. A step passes on the values that the
    last one raised, until none is raised; a value falls with each step, so cycles end, too.
    """
    if not 0 <= decay < 1:
        raise ValueError("decay must be at least 0 and less than 1")
    state = checkpointed(nodes.select("node", F.greatest(F.col("own").cast("double"), F.lit(0.0)).alias("value")))
    front = state
    while True:
        up = edges.join(by_key(front.select(F.col("node").alias("dst"), "value")), "dst").groupBy(F.col("src").alias("node")).agg((F.max("value") * decay).alias("from_deps"))
        # A union, as the planner's guess of a join's size is a product, whose digits would double with each step.
        both = state.unionByName(up, allowMissingColumns=True).groupBy("node").agg(F.max("value").alias("value"), F.max("from_deps").alias("from_deps"))
        new = checkpointed(both.where("value is not null").select("node", "value", F.greatest("value", "from_deps").alias("new")))
        state = new.select("node", F.col("new").alias("value"))
        front = new.where("new > value").select("node", F.col("new").alias("value"))
        if front.isEmpty():
            return state


def dead_exports(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """Exported (module, name) pairs that nothing imports."""
    return exports.join(by_key(imports.select("module", "name")), ["module", "name"], "left_anti")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports joined to the first file that exists among their candidate paths.

    ``imports`` has (importer, target), ``files`` has path; candidates are tried in order.
    """
    endings = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"]
    options = F.array(*[F.struct(F.lit(n).alias("priority"), F.concat("target", F.lit(e)).alias("path")) for n, e in enumerate(endings)])
    rows = imports.withColumn("c", F.explode(options)).select("importer", "target", "c.*").join(files.select("path").distinct(), "path")
    return rows.groupBy("importer", "target").agg(F.min_by("path", "priority").alias("path"))
