"""Queries over a program of modules: one file for each document, its whole text as comments and then code.

The code of a file follows from the document's id: module k is imported by modules 2k + 1 and 2k + 2, some form
rings of five, some pass on a symbol; each has functions of all classes of reach. So SQL can
state what extraction, resolution and the graphs must find, by numbers alone.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..functions.batches import spread
from ..functions.checkpoint import stored
from ..functions.joined import by_key
from ..operators import callgraph, detectors, iterate, modules, source
from .business import DEFAULT_PROFILE, GUARDED, LIMITED, PROFILES, REACHED, base_score
from .registry import query

#: Numbers of a module: its id d, the module it builds on, its successor in a ring, the one it passes on; 1e12: none.
NUMBERS = {"a": "CASE WHEN d > 0 THEN floor((d - 1) / 2) ELSE 1e12 END", "r": "CASE WHEN floor(d / 5) % 7 = 0 THEN floor(d / 5) * 5 + (d + 1) % 5 ELSE 1e12 END", "c": "CASE WHEN d % 4 = 1 THEN floor(d / 3) ELSE 1e12 END"}
GUARDS = ["const one = 1;", "app.use(requireAuth);", "app.use(requireAuth, rateLimit);"]
#: The code of module d; {up} leads to the folder of all packages.
CODE = """import { f{a} as base } from "{up}p{a%10}/m{a}";
import * as ring from "{up}./p{r%10}/m{r}";
import ext, { e1 } from "outer-lib";
export { h{c} } from "{up}x/../p{c%10}/m{c}";
{guard}
export async function f{d}(db, req) {
  const id = req.params.id;
  helper{d}(id, 1);
  plain{d}(2);
  el.innerHTML = "" + id;
  return base(db, id);
}
function helper{d}(p, q) {
  el.innerHTML = p;
  carry{d}(p);
}
function plain{d}(n) {
  el.innerHTML = n;
  return deep{d}(n);
}
function deep{d}(n) { return ring.f{r}(n, n); }
function never{d}(n) {
  el.innerHTML = n;
}
export const h{d} = (x) => x + 1;
export default class M{d} extends Base {
  run(k) { if (k && k.ok) { return carry{d}; } return null; }
}
function carry{d}(v) { return sendOn{d}(v); }
function sendOn{d}(w) { return db.query(w); }"""


def _code():
    """The code as a column over d and the numbers."""
    parts, rest = [], CODE
    up = F.expr("CASE WHEN d % 10 = 3 THEN '../../' ELSE '../' END")
    values = {"up": up, "guard": F.element_at(F.array(*map(F.lit, GUARDS)), (F.col("d") % len(GUARDS) + 1).cast("int"))}
    values |= {n: F.col(n).cast("string") for n in ("d", "a", "r", "c")} | {f"{n}%10": (F.col(n) % 10).cast("string") for n in ("a", "r", "c")}
    while rest:
        at = min(((rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest), default=(len(rest), ""))
        parts.append(F.lit(rest[: at[0]]))
        if at[1]:
            parts.append(values[at[1]])
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*parts)


_PATH = "'src/p' || d % 10 || '/m' || d || CASE d % 10 WHEN 3 THEN '/index.ts' WHEN 4 THEN '.js' ELSE '.ts' END"


class Program:
    """The files of a program and their facts, which are worked out once; those of ``measure`` only if asked for."""

    def __init__(self, g, measure: bool = False):
        self.measure = measure
        docs = spread(g.table("documents").where("doc_id is not null"), "doc_id").select(F.col("doc_id").cast("long").alias("d"), F.coalesce("text", F.lit("")).alias("text"))
        docs = docs.select("d", "text", *(F.expr(f"cast({v} as long)").alias(n) for n, v in NUMBERS.items()))
        comment = F.concat(F.lit("// "), F.replace("text", F.lit("\n"), F.lit("\n// ")))
        self.files = docs.select("d", F.expr(_PATH).alias("path"), F.concat_ws("\n", comment, _code()).alias("content"), F.when(F.col("d") % 10 == 4, "javascript").otherwise("typescript").alias("lang"))

    @cached_property
    def facts(self):
        return stored(source.facts(self.files, measure=self.measure), "facts")

    @cached_property
    def resolved(self):
        return stored(modules.resolved(self.facts), "resolved")

    @cached_property
    def used(self):
        return modules.uses(self.facts, self.resolved)

    @cached_property
    def means(self):
        return stored(callgraph.callees(self.facts, self.used), "callees")

    @cached_property
    def edges(self):
        return iterate.checkpointed(modules.edges(self.resolved))


_PATH_OF = lambda k: _PATH.replace("d % 10", f"{k} % 10").replace("|| d ||", f"|| {k} ||").replace("CASE d", f"CASE {k}")
_MODULES = f"""m AS (SELECT d, {_PATH} AS path, len(string_split(text, chr(10)))::INT AS above, {', '.join(f'({v})::BIGINT AS {n}' for n, v in NUMBERS.items())} FROM (SELECT doc_id::BIGINT AS d, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL)),
    e AS (SELECT DISTINCT m.path AS src, t.path AS dst FROM m JOIN m t ON t.d = m.a OR t.d = m.r OR t.d = m.c)"""
# The join above is on one of three numbers; as a union it stays a hash join.
_MODULES = _MODULES.replace("SELECT DISTINCT m.path AS src, t.path AS dst FROM m JOIN m t ON t.d = m.a OR t.d = m.r OR t.d = m.c", " UNION ".join(f"SELECT m.path AS src, t.path AS dst FROM m JOIN m t ON t.d = m.{n}" for n in NUMBERS))
_UP = "CASE WHEN d % 10 = 3 THEN '../../' ELSE '../' END"


@query("module_imports", f"""WITH {_MODULES} SELECT path, {_UP} || 'p' || a % 10 || '/m' || a AS specifier, 'f' || a AS name, 'base' AS alias, 'name' AS kind, above + 1 AS line FROM m UNION ALL SELECT path, {_UP} || './p' || r % 10 || '/m' || r, '*', 'ring', 'module', above + 2 FROM m
    UNION ALL SELECT path, 'outer-lib', 'default', 'ext', 'default', above + 3 FROM m UNION ALL SELECT path, 'outer-lib', 'e1', 'e1', 'name', above + 3 FROM m UNION ALL SELECT path, {_UP} || 'x/../p' || c % 10 || '/m' || c, 'h' || c, 'h' || c, 're-export', above + 4 FROM m""")
def module_imports(g):
    """Each name that a file imports, where from, and as what."""
    return modules.imported(Program(g).facts)


@query("symbol_table", f"""WITH {_MODULES} SELECT path, name, kind, above + ln AS line FROM m, LATERAL (VALUES ('h' || c, 're-export', 4), ('f' || d, 'function', 6), ('h' || d, 'const', 25), ('default', 'default', 26)) v(name, kind, ln)""")
def symbol_table(g):
    """Each symbol that a file exports."""
    return modules.symbols(Program(g).facts).select("path", "name", "kind", "line")


@query("import_resolution", f"WITH {_MODULES} SELECT m.path AS importer, t.path FROM m JOIN m t ON t.d = m.a UNION SELECT m.path, t.path FROM m JOIN m t ON t.d = m.r UNION SELECT m.path, t.path FROM m JOIN m t ON t.d = m.c")
def import_resolution(g):
    """Imports without extension resolved to the first file that exists."""
    return Program(g).resolved.select(F.col("path").alias("importer"), F.col("dependency").alias("path")).distinct()


@query("symbol_uses", f"""WITH {_MODULES} SELECT m.path AS caller, t.path AS callee, 'f' || m.a AS symbol, m.above + 1 AS line FROM m JOIN m t ON t.d = m.a UNION ALL SELECT m.path, t.path, '*', m.above + 2 FROM m JOIN m t ON t.d = m.r UNION ALL SELECT m.path, t.path, 'h' || m.c, m.above + 4 FROM m JOIN m t ON t.d = m.c""")
def symbol_uses(g):
    """Each symbol that a file takes from another file of the program."""
    return Program(g).used.select(F.col("path").alias("caller"), F.col("dependency").alias("callee"), F.col("name").alias("symbol"), "line")


@query("dead_exports", f"WITH {_MODULES}, u AS (SELECT a AS d, 'f' || a AS name FROM m UNION SELECT c, 'h' || c FROM m) SELECT path, 'f' || m.d AS name, above + 6 AS line FROM m ANTI JOIN u ON u.d = m.d AND u.name = 'f' || m.d UNION ALL SELECT path, 'h' || m.d, above + 25 FROM m ANTI JOIN u ON u.d = m.d AND u.name = 'h' || m.d")
def dead_exports(g):
    """Exported symbols that no file imports by name."""
    p = Program(g)
    return modules.dead(p.facts, p.used)


@query("import_reach", f"WITH RECURSIVE {_MODULES}, r(path) AS (SELECT path FROM m WHERE d % 50 = 7 UNION SELECT src FROM e JOIN r ON dst = path) SELECT path FROM r")
def import_reach(g):
    """All files that import a tainted one, directly or through others, and these."""
    p = Program(g)
    back = iterate.checkpointed(p.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return iterate.reach(back, p.files.where("d % 50 = 7").select(F.col("path").alias("node"))).select(F.col("node").alias("path"))


@query("transitive_imports", f"WITH RECURSIVE {_MODULES}, r(path) AS (SELECT path FROM m WHERE d = 181 UNION SELECT dst FROM e JOIN r ON src = path) SELECT path FROM r")
def transitive_imports(g, start: int = 181):
    """All files that one file needs, itself included."""
    p = Program(g)
    return iterate.reach(p.edges, p.files.where(F.col("d") == start).select(F.col("path").alias("node"))).select(F.col("node").alias("path"))


@query("import_cycles", f"WITH RECURSIVE {_MODULES}, p(first, last, path, n) AS (SELECT src, dst, [src], 1 FROM e WHERE dst >= src UNION ALL SELECT first, dst, list_append(path, last), n + 1 FROM p JOIN e ON last = src WHERE last <> first AND dst >= first AND NOT list_contains(list_append(path, last), CASE WHEN dst = first THEN '' ELSE dst END)) SELECT array_to_string(path, '>') AS cycle, n AS length FROM p WHERE last = first")
def import_cycles(g):
    """All import cycles, of any length, each from its least path on."""
    return iterate.cycles(Program(g).edges).select(F.array_join("cycle", ">").alias("cycle"), "length")


@query("contamination", f"WITH RECURSIVE {_MODULES}, v(path, value) AS (SELECT path, CASE WHEN d % 50 = 7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM m UNION SELECT src, value * 0.7::DOUBLE FROM v JOIN e ON dst = path WHERE value > 1e-9 AND NOT EXISTS (SELECT 1 FROM m WHERE m.path = src AND m.d % 50 = 7)) SELECT path, round(max(value), 8) AS value FROM v GROUP BY 1")
def contamination(g):
    """Risk that files take over from what they import, dependencies first."""
    p = Program(g)
    nodes = p.files.select(F.col("path").alias("node"), F.when(F.col("d") % 50 == 7, 1.0).otherwise(0.0).alias("own"))
    return iterate.contamination(nodes, p.edges).select(F.col("node").alias("path"), F.round("value", 8).alias("value"))


#: (name, kind, first and last line, parameters, complexity, nesting, entry point, depth) of a module's functions.
FUNCTIONS = [("f", "function", 6, 12, ["db", "req"], 1, 0, True, 0), ("helper", "function", 13, 16, ["p", "q"], 1, 0, False, 1), ("plain", "function", 17, 20, ["n"], 1, 0, False, 1), ("deep", "function", 21, 21, ["n"], 1, 0, False, 2), ("never", "function", 22, 24, ["n"], 1, 0, False, None), ("h", "arrow", 25, 25, ["x"], 1, 0, True, 0), ("run", "method", 27, 27, ["k"], 3, 1, True, 0), ("carry", "function", 29, 29, ["v"], 1, 0, False, 2), ("sendOn", "function", 30, 30, ["w"], 1, 0, False, 3)]
_NAME = "CASE f.name WHEN 'run' THEN 'run' ELSE f.name || d END"
_TABLE = "(VALUES " + ", ".join(f"('{n}', '{k}', {s}, {e}, {p!r}, {c}, {x}, {en}, {'NULL' if dep is None else dep})" for n, k, s, e, p, c, x, en, dep in FUNCTIONS) + ") f(name, kind, line, end_line, params, complexity, nesting, is_entry, depth)"


@query("function_table", f"WITH {_MODULES} SELECT path, {_NAME} AS name, kind, above + f.line AS line, above + f.end_line AS end_line, params, complexity::INT AS complexity, nesting::INT AS nesting, is_entry FROM m, {_TABLE}")
def function_table(g):
    """Each function with its span, parameters, complexity and nesting."""
    return callgraph.functions(Program(g, measure=True).facts).select("path", "name", "kind", "line", "end_line", "params", "complexity", "nesting", "is_entry")


@query("class_table", f"WITH {_MODULES} SELECT path, 'M' || d AS name, above + 26 AS line, above + 28 AS end_line, TRUE AS is_exported, 'Base' AS base, ['run'] AS methods FROM m")
def class_table(g):
    return Program(g).facts.select("path", F.inline("classes"))


_CALLS = [("f", 8, "helper"), ("f", 9, "plain"), ("helper", 15, "carry"), ("plain", 19, "deep"), ("carry", 29, "sendOn")]


@query("call_edges", f"""WITH {_MODULES} SELECT path, f.caller || d AS caller, above + ln AS line, path AS to_path, f.callee || d AS "to" FROM m, (VALUES {', '.join(f"('{a}', {n}, '{b}')" for a, n, b in _CALLS)}) f(caller, ln, callee)
    UNION ALL SELECT m.path, 'f' || m.d, m.above + 11, t.path, 'f' || t.d FROM m JOIN m t ON t.d = m.a UNION ALL SELECT m.path, 'deep' || m.d, m.above + 21, t.path, 'f' || t.d FROM m JOIN m t ON t.d = m.r""")
def call_edges(g):
    """Calls between functions of the program, within a file and over imports."""
    p = Program(g)
    return callgraph.edges(p.facts, p.means)


@query("call_graph_reach", f"WITH {_MODULES} SELECT path, {_NAME} AS function, is_entry, depth::INT AS depth FROM m, {_TABLE}")
def call_graph_reach(g):
    """Functions of the program: whether they are entry points, and the least number of calls from one (null: none leads there)."""
    p = Program(g)
    return callgraph.reach(p.facts, callgraph.edges(p.facts, p.means))


@query("call_depth", f"WITH {_MODULES} SELECT path, 9::BIGINT AS functions, 3::BIGINT AS entries, 1::BIGINT AS unreached, 3::INT AS greatest_depth FROM m")
def call_depth(g):
    """Of each file: functions, entry points, those that nothing reaches, and the greatest depth."""
    return call_graph_reach(g).groupBy("path").agg(F.count("*").alias("functions"), F.count_if("is_entry").alias("entries"), F.count_if(F.col("depth").isNull()).alias("unreached"), F.max("depth").alias("greatest_depth"))


_SINKS = [("f", 10, "dom", 0, "f"), ("helper", 14, "dom", 1, "f>helper"), ("sendOn", 30, "sql", 3, "f>helper>carry>sendOn")]


@query("taint_over_calls", f"""WITH {_MODULES} SELECT path AS sink_path, f.name || d AS sink_function, above + ln AS sink_line, sink, path, 'f' || d AS "function", above + 7 AS line, 'user-input' AS source, hops, chain FROM m, (VALUES {', '.join(f"('{n}', {at}, '{s}', {h}, '{c}')" for n, at, s, h, c in _SINKS)}) f(name, ln, sink, hops, chain)""")
def taint_over_calls(g):
    """For each sink that input reaches, the nearest source and the functions on the way, numbers left out."""
    p = Program(g)
    chain = F.array_join(F.transform("chain", lambda x: F.regexp_replace(F.substring_index(x, "#", -1), r"\d+$", "")), ">")
    return callgraph.Taint(p.facts, p.means).paths().withColumn("chain", chain)


@query("cross_file_taint", f"WITH {_MODULES} SELECT m.path AS consumer, t.path AS source, CASE WHEN t.d = m.a THEN 'f' || t.d WHEN t.d = m.r THEN '*' ELSE 'h' || t.d END AS symbol, m.above + CASE WHEN t.d = m.a THEN 1 WHEN t.d = m.r THEN 2 ELSE 4 END AS line, 'dom' AS sink, t.above + 10 AS sink_line, round({source.CONFIDENCE}::DOUBLE, 8) AS confidence FROM e JOIN m ON m.path = src JOIN m t ON t.path = dst")
def cross_file_taint(g):
    """Importers of files with a path from input to a sink of their own: the nearest import and the path, at confidence 0.5 or more."""
    p = Program(g)
    return modules.cross_file_taint(p.facts, p.used).withColumn("confidence", F.round("confidence", 8))


_FOUND = [("f", 10, "entry-point"), ("helper", 14, "tainted-path"), ("plain", 18, "reachable"), ("never", 23, "unreachable")]
_REACHED = f"SELECT path, above + ln AS line, 'xss' AS id, f.name || d AS \"function\", reach FROM m, (VALUES {', '.join(f'''('{n}', {at}, '{r}')''' for n, at, r in _FOUND)}) f(name, ln, reach)"


def reached_findings(p):
    # Places and their functions both read the findings; the detectors run once.
    found = stored(detectors.findings(p.files).select("path", "line", "id"), "findings")
    return callgraph.classified(found, p.facts, callgraph.reach(p.facts, callgraph.edges(p.facts, p.means)), callgraph.Taint(p.facts, p.means).functions())


@query("finding_reach", f"WITH {_MODULES} {_REACHED}")
def finding_reach(g):
    """Each finding with the function around it and how that is reached."""
    return reached_findings(Program(g)).select("path", "line", "id", "function", "reach")


_BASES = ", ".join(f"('{k}', {base_score(v)}::DOUBLE)" for k, v in PROFILES.items())
_FACTOR = "CASE reach " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in REACHED.items()) + " END::DOUBLE"


@query("exploitability_context", f"""WITH {_MODULES}, b(id, base) AS (VALUES {_BASES}), s AS (SELECT path, line, id, "function", reach, base, base * {_FACTOR} * CASE WHEN d % 3 > 0 THEN 0.7::DOUBLE ELSE 1 END * CASE WHEN d % 3 = 2 THEN 0.85::DOUBLE ELSE 1 END AS adj FROM ({_REACHED.replace('SELECT path,', 'SELECT d, path,')}) JOIN b USING (id))
    SELECT path, line, id, "function", reach, base, floor(least(10, adj) * 10 + 0.5) / 10 AS score, CASE WHEN adj >= 8 THEN 'immediate' WHEN adj >= 6 THEN 'sprint' WHEN adj >= 4 THEN 'backlog' ELSE 'monitor' END AS urgency FROM s""")
def exploitability_context(g):
    """Score of each finding: its base by how the function around it is reached, less where lines near it guard or limit it.

    The twenty lines before a finding and the five after it count. Both sides meet by bucket of lines, so
    a file of many findings and guards has no pairs but those near each other.
    """
    p = Program(g)
    rows = near_guards(stored(reached_findings(p), "reached"), detectors.sieved(p.files, [GUARDED, LIMITED]))
    bases = g.spark.createDataFrame([(k, base_score(v)) for k, v in PROFILES.items()], "id string, base double")
    rows = rows.join(F.broadcast(bases), "id", "left").withColumn("base", F.coalesce("base", F.lit(base_score(DEFAULT_PROFILE))))
    factor = F.create_map(*[F.lit(x) for kv in REACHED.items() for x in kv])
    adj = F.col("base") * factor[F.col("reach")] * F.when(F.col("auth"), 0.70).otherwise(1.0) * F.when(F.col("slow"), 0.85).otherwise(1.0)
    urgency = F.when(adj >= 8, "immediate").when(adj >= 6, "sprint").when(adj >= 4, "backlog").otherwise("monitor")
    return rows.select("path", "line", "id", "function", "reach", "base", (F.floor(F.least(F.lit(10.0), adj) * 10 + 0.5) / 10).alias("score"), urgency.alias("urgency"))


def near_guards(findings, lines, before: int = 20, after: int = 5):
    """``findings`` with ``auth`` and ``slow``: whether a line from ``before`` - 1 above to ``after`` below guards or limits them."""
    width = before + after
    marks = lines.select(F.col("path").alias("p"), F.col("line").alias("at"), F.col("text").rlike(GUARDED).alias("guards"), F.col("text").rlike(LIMITED).alias("limits")).where("guards or limits")
    # A finding looks into the buckets that its window touches, two at most; a line lies in one.
    marks = marks.withColumn("bucket", F.expr(f"at div {width}"))
    places = findings.select("path", "line").distinct().withColumn("b", F.explode(F.sequence(F.expr(f"(line - {before} + 1) div {width}"), F.expr(f"(line + {after}) div {width}"))))
    inside = (F.col("path") == F.col("p")) & (F.col("b") == F.col("bucket")) & (F.col("at") > F.col("line") - before) & (F.col("at") <= F.col("line") + after)
    seen = places.join(by_key(marks), inside).groupBy("path", "line").agg(F.bool_or("guards").alias("auth"), F.bool_or("limits").alias("slow"))
    return findings.join(by_key(seen), ["path", "line"], "left").fillna(False, ["auth", "slow"])


_KINDS = list(PROFILES)
_WEAK = f"{_KINDS!r}[p_partkey % {len(_KINDS)} + 1]"


@query("exploitability", f"WITH b(id, base) AS (VALUES {_BASES}), r AS (SELECT p_partkey, {_WEAK} AS id, {list(REACHED)!r}[p_partkey % 4 + 1] AS reach, p_size FROM part) SELECT p_partkey, id, round(least(10.0, base * {_FACTOR} * CASE WHEN p_size % 2 = 0 THEN 0.7 ELSE 1 END::DOUBLE * CASE WHEN p_size % 3 = 0 THEN 0.85 ELSE 1 END::DOUBLE), 8) AS score FROM r JOIN b USING (id)")
def exploitability(g):
    """Score of a weakness of each kind by its vector's base, reach, authentication and rate limit."""
    of = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % n + 1).cast("int"))
    base = of([base_score(PROFILES[k]) for k in _KINDS], len(_KINDS))
    score = base * of(list(REACHED.values()), 4) * F.when(F.col("p_size") % 2 == 0, 0.7).otherwise(1.0) * F.when(F.col("p_size") % 3 == 0, 0.85).otherwise(1.0)
    return g.table("part").select("p_partkey", of(_KINDS, len(_KINDS)).alias("id"), F.round(F.least(F.lit(10.0), score), 8).alias("score"))
