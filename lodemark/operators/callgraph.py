"""Calls between functions of a whole program: reach from entry points, input over calls, findings in functions.

A function is a node ``path#name``; functions of one name in a file count as one. A callee is a function of the
same file by its last name, else what an import names. Reach and taint are fixpoints over these
edges (``iterate``), so they grow with the program and need no file or function to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoint import checkpointed
from ..functions.joined import by_key
from . import modules

#: Lines of one bucket in which findings and functions meet.
BUCKET = 64


def node(path: str, name: str) -> Column:
    return F.concat_ws("#", path, name)


def functions(facts: DataFrame) -> DataFrame:
    return facts.select("path", F.inline("functions"))


def callees(facts: DataFrame, used: DataFrame) -> DataFrame:
    """(path, callee, to_path, to): the function that a name called in a file means; calls out of the program are left out."""
    named = facts.select("path", F.inline("calls")).select("path", "callee", F.substring_index("callee", ".", -1).alias("last"), F.substring_index("callee", ".", 1).alias("first")).distinct()
    own = functions(facts).select(F.col("path").alias("to_path"), F.col("name").alias("to")).distinct()
    local = named.join(by_key(own), (F.col("path") == F.col("to_path")) & (F.col("last") == F.col("to"))).select("path", "callee", "to_path", "to")
    # Names without a function of their own file: a symbol that the file imports, or one of a module it imports whole.
    rest = named.join(by_key(local.select("path", "callee")), ["path", "callee"], "left_anti")
    symbols = modules.symbols(facts).select(F.col("path").alias("dependency"), F.col("name").alias("symbol"), "local")
    taken = used.select(F.col("path"), F.col("alias").alias("first"), "dependency", "name").distinct()
    rows = rest.join(by_key(taken), ["path", "first"])
    symbol = F.when(F.col("name") == "*", F.col("last")).when(F.col("callee") == F.col("first"), F.col("name"))
    rows = rows.withColumn("symbol", symbol).join(by_key(symbols), ["dependency", "symbol"])
    far = rows.join(by_key(own), (F.col("dependency") == F.col("to_path")) & (F.col("local") == F.col("to"))).select("path", "callee", "to_path", "to")
    return local.unionByName(far).distinct()


def edges(facts: DataFrame, means: DataFrame) -> DataFrame:
    """(path, caller, line, to_path, to) of each call within the program."""
    calls = facts.select("path", F.inline("calls")).select("path", "caller", "callee", "line")
    return calls.join(by_key(means), ["path", "callee"]).select("path", "caller", "line", "to_path", "to").distinct()


def reach(facts: DataFrame, calls: DataFrame) -> DataFrame:
    """(path, function, is_entry, depth): the least number of calls from an entry point, null if none leads there."""
    from . import iterate

    own = functions(facts).groupBy("path", F.col("name").alias("function")).agg(F.max("is_entry").alias("is_entry"))
    own = checkpointed(own.withColumn("node", node("path", "function")))
    steps = checkpointed(calls.select(node("path", "caller").alias("src"), node("to_path", "to").alias("dst")).distinct())
    found = iterate.reach(steps, own.where("is_entry").select("node"))
    return own.join(by_key(found), "node", "left").select("path", "function", "is_entry", "depth")


def _place(path: str, function: str, number: str) -> Column:
    return F.concat_ws("#", path, function, F.col(number).cast("string"))


class Taint:
    """Input that flows over calls: a node is a function's parameter, ``path#function#number``.

    An edge leads from a parameter to the one that it is passed on as; a node is reached from input by the least
    number of calls, and of equals from the first place.
    """

    def __init__(self, facts: DataFrame, means: DataFrame):
        self.flows = checkpointed(facts.select("path", F.inline("flows")))
        passed = self.flows.where("target like 'call:%'").withColumn("callee", F.substring("target", 6, 1 << 20)).join(by_key(means), ["path", "callee"])
        self.passed = checkpointed(passed.withColumn("node", _place("to_path", "to", "arg")))
        self.steps = checkpointed(self.passed.where("origin = 'param'").select(_place("path", "function", "param").alias("src"), F.col("node").alias("dst"), node("to_path", "to").alias("via")).distinct())
        self.sinks = self.flows.where("target not like 'call:%'")

    def reached(self) -> DataFrame:
        """(node, began, chain, hops): parameters that input reaches, where it began, and the functions on the way."""
        began = F.struct("path", "function", F.col("origin_line").alias("line"), F.col("origin").alias("source"))
        first = self.passed.where("origin <> 'param'").select("node", began.alias("began"), F.array(node("path", "function"), node("to_path", "to")).alias("chain"))
        found = checkpointed(first.groupBy("node").agg(F.min(F.struct("began", "chain")).alias("x")).select("node", "x.*", F.lit(1).alias("hops")))
        front, hops = found, 1
        while True:
            hops += 1
            step = front.join(by_key(self.steps), front["node"] == self.steps["src"]).select(F.col("dst").alias("node"), "began", F.concat("chain", F.array("via")).alias("chain"))
            step = step.groupBy("node").agg(F.min(F.struct("began", "chain")).alias("x")).select("node", "x.*", F.lit(hops).alias("hops"))
            front = checkpointed(step.join(by_key(found.select("node")), "node", "left_anti"))
            if front.isEmpty():
                return found
            found = checkpointed(found.unionByName(front))

    def paths(self) -> DataFrame:
        """(sink_path, sink_function, sink_line, sink, path, function, line, source, hops, chain): for each sink that
        input reaches, the source with the fewest calls between."""
        sinks = self.sinks.select(F.col("path").alias("sink_path"), F.col("function").alias("sink_function"), F.col("target_line").alias("sink_line"), F.col("target").alias("sink"), "path", "function", "origin", "origin_line", "param")
        keys = ["sink_path", "sink_function", "sink_line", "sink"]
        began = F.struct("path", "function", F.col("origin_line").alias("line"), F.col("origin").alias("source"))
        direct = sinks.where("origin <> 'param'").select(*keys, F.lit(0).alias("hops"), began.alias("began"), F.array(node("path", "function")).alias("chain"))
        far = sinks.where("origin = 'param'").withColumn("node", _place("path", "function", "param")).join(by_key(self.reached()), "node").select(*keys, "hops", "began", "chain")
        rows = direct.unionByName(far).groupBy(*keys).agg(F.min(F.struct("hops", "began", "chain")).alias("x"))
        return rows.select(*keys, "x.began.*", "x.hops", "x.chain")

    def functions(self) -> DataFrame:
        """(path, function): functions through which input flows to a sink, by any way."""
        from . import iterate

        ends = self.sinks.where("origin = 'param'").select(_place("path", "function", "param").alias("node"))
        back = checkpointed(self.steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct())
        to_sink = iterate.reach(back, ends).select("node")
        origins = self.passed.where("origin <> 'param'").join(by_key(to_sink), "node").select("path", "function")
        here = self.sinks.where("origin <> 'param'").select("path", "function")
        through = iterate.reach(self.steps, self.passed.where("origin <> 'param'").select("node")).join(by_key(to_sink), "node")
        named = through.select(F.substring_index("node", "#", -2).alias("tail"), "node").select(F.expr("substring(node, 1, length(node) - length(tail) - 1)").alias("path"), F.substring_index("tail", "#", 1).alias("function"))
        return origins.unionByName(here).unionByName(named).distinct()


def enclosing(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """``findings`` (path, line) with ``function``, the innermost one around the line, null outside of all.

    Both meet by (path, bucket of lines), so a file of many findings and functions has no pairs but those near each other.
    """
    spans = functions(facts).select(F.col("path").alias("p"), F.col("name").alias("function"), F.col("line").alias("from"), F.col("end_line").alias("to"))
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.expr(f"`from` div {BUCKET}"), F.expr(f"`to` div {BUCKET}"))))
    lines = findings.select("path", "line").distinct().withColumn("bucket", F.expr(f"line div {BUCKET}"))
    inside = lines.join(by_key(spans.withColumnRenamed("bucket", "b")), (F.col("path") == F.col("p")) & (F.col("bucket") == F.col("b")) & (F.col("from") <= F.col("line")) & (F.col("line") <= F.col("to")))
    inner = inside.groupBy("path", "line").agg(F.max_by("function", F.struct("from", -F.col("to"), "function")).alias("function"))
    return findings.join(by_key(inner), ["path", "line"], "left")


def classified(findings: DataFrame, facts: DataFrame, reached: DataFrame, tainted: DataFrame) -> DataFrame:
    """``findings`` with ``function`` and ``reach``: entry-point, tainted-path, reachable or unreachable.

    ``tainted`` are the functions through which input flows to a sink (``Taint.functions``). Code outside of all
    functions runs when its file is loaded and is reachable.
    """
    rows = enclosing(findings, facts)
    marked = tainted.withColumn("tainted", F.lit(True))
    rows = rows.join(by_key(reached), ["path", "function"], "left").join(by_key(marked), ["path", "function"], "left")
    reach = F.when(F.col("function").isNull(), "reachable").when(F.col("is_entry"), "entry-point").when(F.col("depth").isNull(), "unreachable").when(F.col("tainted"), "tainted-path").otherwise("reachable")
    return rows.withColumn("reach", reach).drop("is_entry", "depth", "tainted")
