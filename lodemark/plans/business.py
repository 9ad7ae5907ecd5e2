"""Business operators: overlays, evidence, readiness, exports, dependency reports, line and file markers."""

from __future__ import annotations

import re
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.batches import small_batches, spread
from ..functions.checkpoint import stored
from ..functions.scalars import half_up, hours_between, risk_rank
from ..operators import detectors, rollup, signed
from ..sources.governance import AS_OF
from . import registry
from .chains import chained, match_cves, verify_chain
from .code import _FILES, _quote, code_files, snippet_files
from .governance import repo_stats, top_files
from .registry import query
from .samples import SNIPPETS
from .scores import _FACTS, _NOW, FRAMEWORKS, _DOUBLE, now, org_facts
from .sources import tree_sql


@query("dominant_risk", "SELECT repo, risk, n, round(n / total::DOUBLE, 8) AS share, n / total::DOUBLE >= 0.6 AS dominates FROM (SELECT repo, risk, count(*) AS n, sum(count(*)) OVER (PARTITION BY repo) AS total, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, risk) AS k FROM scan_files GROUP BY 1, 2) WHERE k = 1")
def dominant_risk(g):
    """The most frequent risk of each repository's files (ties: first by name), and whether it holds 60 per cent."""
    rows = g.scan_files.groupBy("repo", "risk").agg(F.count("*").alias("n"))
    best = F.min_by(F.struct("risk", "n"), F.struct(-F.col("n"), "risk"))
    rows = rows.groupBy("repo").agg(best.alias("x"), F.sum("n").alias("total")).select("repo", "x.*", (F.col("x.n") / F.col("total")).alias("s"))
    return rows.select("repo", "risk", "n", F.round("s", 8).alias("share"), (F.col("s") >= 0.6).alias("dominates"))


_TOKEN = re.compile("[a-z0-9_]+")


@query("bigrams", "WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda x: x <> '') AS w FROM documents), b AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '|' || w[i + 1])) AS b FROM w) SELECT doc_id, count(*) AS bigrams, count(DISTINCT b) AS distinct_bigrams FROM b GROUP BY 1")
def bigrams(g):
    """Pairs of adjacent tokens in each text: all, and distinct ones."""
    rows = spread(g.table("documents"), "doc_id").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))

    def read(batches):
        for batch in batches:
            counts = []
            for text in batch.column(1).to_pylist():
                words = _TOKEN.findall(text)
                counts.append((max(0, len(words) - 1), len(set(pairwise(words)))))
            every, distinct = zip(*counts, strict=True) if counts else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(every, pa.int64()), pa.array(distinct, pa.int64())], ["doc_id", "bigrams", "distinct_bigrams"])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(read, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, bigrams long, distinct_bigrams long").where("bigrams > 0")


@query("attestation_overlay", """WITH f AS (SELECT t.repo, t.attested OR coalesce(v.status = 'resolved', false) AS ok FROM top_files t LEFT JOIN violations v ON t.scan_id = v.scan_id AND t.file_path = v.file_path WHERE t.risk IN ('CRITICAL', 'HIGH')),
    n AS (SELECT repo, count(*) FILTER (ok) / count(*)::DOUBLE AS rate FROM f GROUP BY 1) SELECT repo, round(greatest(attestation_rate, coalesce(rate, 0)), 8) AS attestation_rate FROM repo_stats LEFT JOIN n USING (repo)""")
def attestation_overlay(g):
    """Coverage with resolved violations counted as signed; never lower than it was."""
    resolved = g.violations.where("status = 'resolved'").select("scan_id", "file_path", F.lit(True).alias("resolved"))
    files = top_files(g).where(F.col("risk").isin("CRITICAL", "HIGH")).join(resolved, ["scan_id", "file_path"], "left")
    rates = files.groupBy("repo").agg((F.count_if(F.col("attested") | F.col("resolved").isNotNull()) / F.count("*")).alias("rate"))
    rows = repo_stats(g).join(rates, "repo", "left")
    return rows.select("repo", F.round(F.greatest("attestation_rate", F.coalesce("rate", F.lit(0.0))), 8).alias("attestation_rate"))


@query("compact_readiness", f"""WITH {_FACTS}, c AS (SELECT org_id, count(*) AS repos, count(*) FILTER (attestation_rate >= 0.8) AS good, avg(attestation_rate) AS att FROM repo_stats GROUP BY 1)
    SELECT org_id, least(100, floor(c.att * 50 + (1 - least(ai, 1)) * 25 + CASE WHEN blocked = 0 THEN 25 ELSE greatest(0, 25 - blocked * 5) END + 0.5))::BIGINT AS soc2, least(100, floor(c.att * 55 + good / repos::DOUBLE * 25 + CASE WHEN scans > 2 THEN 20 ELSE 10 END + 0.5))::BIGINT AS euai,
    least(100, floor(c.att * 60 + CASE WHEN blocked = 0 THEN 25 ELSE greatest(0, 25 - blocked * 8) END + CASE WHEN ai < 0.3 THEN 15 WHEN ai < 0.6 THEN 8 ELSE 0 END + 0.5))::BIGINT AS pcidss FROM facts JOIN c USING (org_id)""")
def compact_readiness(g):
    """Readiness for three frameworks from coverage, AI share, blocked and well-covered repositories."""
    good = repo_stats(g).groupBy("org_id").agg(F.count("*").alias("repos"), F.count_if(F.col("attestation_rate") >= 0.8).alias("good"))
    rows = org_facts(g).join(good, "org_id")
    att, ai, b = F.col("att"), F.col("ai"), F.col("blocked")
    less = lambda n: F.when(b == 0, 25).otherwise(F.greatest(F.lit(0), 25 - b * n))
    top = lambda x: F.least(F.lit(100), half_up(x)).cast("long")
    return rows.select(
        "org_id", top(att * 50 + (1 - F.least(ai, F.lit(1.0))) * 25 + less(5)).alias("soc2"), top(att * 55 + F.col("good") / F.col("repos") * 25 + F.when(F.col("scans") > 2, 20).otherwise(10)).alias("euai"),
        top(att * 60 + less(8) + F.when(ai < 0.3, 15).when(ai < 0.6, 8).otherwise(0)).alias("pcidss"),
    )


_EXCEPTIONS = "SELECT n_regionkey AS org_id, ['soc2', 'euai', 'pcidss', 'iso27001'][(s_suppkey % 4)::INT + 1] AS framework, count(*) AS open FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 = 0 GROUP BY 1, 2"


@query("readiness_with_exceptions", f"WITH {_FACTS}, s AS (SELECT org_id, att * 100 AS att, scans, files, blocked FROM facts), r AS (" + " UNION ALL ".join(f"SELECT org_id, '{k}' AS framework, floor(({e}) / {sum(w for w, _ in FRAMEWORKS[k])} * 100 + 0.5)::BIGINT AS base FROM s" for k, e in _DOUBLE.items()) + f"), x AS ({_EXCEPTIONS}) SELECT org_id, framework, coalesce(open, 0) AS open_exceptions, least(100, greatest(0, base - 3 * coalesce(open, 0)))::BIGINT AS readiness FROM r LEFT JOIN x USING (org_id, framework)")
def readiness_with_exceptions(g):
    """Framework readiness less three points for each open exception."""
    from .scores import framework_readiness

    names = F.array(*[F.lit(k) for k in FRAMEWORKS])
    open_ = g.table("supplier").where("s_suppkey % 5 = 0").join(g.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    open_ = open_.groupBy(F.col("n_regionkey").alias("org_id"), F.element_at(names, (F.col("s_suppkey") % 4 + 1).cast("int")).alias("framework")).agg(F.count("*").alias("open"))
    rows = framework_readiness(g).join(open_, ["org_id", "framework"], "left").withColumn("open_exceptions", F.coalesce("open", F.lit(0)))
    return rows.select("org_id", "framework", "open_exceptions", F.least(F.lit(100), F.greatest(F.lit(0), F.col("readiness") - 3 * F.col("open_exceptions"))).cast("long").alias("readiness"))


@query("evidence_strength", f"WITH {_FACTS} SELECT org_id, c AS control, floor(least(5, least(c, 3) / 3.0::DOUBLE * 3 + CASE WHEN scans > 10 THEN 1 ELSE 0 END + CASE WHEN c % 2 = 0 THEN 1 ELSE 0 END) + 0.5)::BIGINT AS strength FROM facts, (SELECT unnest(range(1, 6))::INT AS c)")
def evidence_strength(g):
    """0 to 5 for a control: automatic evidence items of three, enough scans, tested in the last ninety days."""
    rows = org_facts(g).select("org_id", "scans", F.explode(F.array(*[F.lit(c) for c in range(1, 6)])).alias("control"))
    tested = F.when(F.col("control") % 2 == 0, 1).otherwise(0)
    strength = F.least(F.col("control"), F.lit(3)) / 3 * 3 + F.when(F.col("scans") > 10, 1).otherwise(0) + tested
    return rows.select("org_id", "control", half_up(F.least(F.lit(5.0), strength)).cast("long").alias("strength"))


@query("soc2_controls", """WITH c AS (SELECT org_id, n_scans, coalesce(n_att, 0) AS n_att, coalesce(n_open, 0) AS n_open, coalesce(n_res, 0) AS n_res, coalesce(n_events, 0) AS n_events, coalesce(broken, 0) AS broken FROM (SELECT org_id, count(*) AS n_scans FROM scans GROUP BY 1) LEFT JOIN (SELECT org_id, count(*) AS n_att FROM attestations GROUP BY 1) USING (org_id)
      LEFT JOIN (SELECT org_id, count(*) FILTER (status IN ('open', 'in_review')) AS n_open, count(*) FILTER (status = 'resolved') AS n_res FROM violations GROUP BY 1) USING (org_id) LEFT JOIN (SELECT user_id % 5 AS org_id, count(*) AS n_events, count(*) FILTER (event_id % 9973 = 0 AND event_id > 0) AS broken FROM events GROUP BY 1) USING (org_id)),
    e AS (SELECT org_id, 'CC6.1' AS control, CASE WHEN n_att > 0 THEN 'pass' ELSE 'partial' END AS status, least(100, n_att / greatest(1, n_scans)::DOUBLE * 100) AS score FROM c
    UNION ALL SELECT org_id, 'CC6.2', CASE WHEN n_events > 0 THEN 'pass' ELSE 'fail' END, CASE WHEN n_events > 0 THEN 100 ELSE 0 END FROM c
    UNION ALL SELECT org_id, 'CC7.2', CASE WHEN n_scans > 0 THEN 'pass' ELSE 'fail' END, CASE WHEN n_scans > 10 THEN 100 WHEN n_scans > 0 THEN 80 ELSE 0 END FROM c
    UNION ALL SELECT org_id, 'CC8.1', CASE WHEN n_res > 0 AND n_open = 0 THEN 'pass' WHEN n_open > 5 THEN 'partial' ELSE 'pass' END, least(100, 100 - least(50, n_open * 5)) FROM c
    UNION ALL SELECT org_id, 'A1.2', CASE WHEN broken = 0 THEN 'pass' ELSE 'fail' END, CASE WHEN broken = 0 THEN 100 ELSE 0 END FROM c)
    SELECT org_id, control, status, round(score::DOUBLE, 6) AS score, floor(avg(score) OVER (PARTITION BY org_id) + 0.5)::BIGINT AS overall FROM e""")
def soc2_controls(g):
    """Five controls with status and score, and their mean; the last is the verdict on the audit chains, some entries of which were altered."""
    from .governance import evidence_counts

    linked = chained(g.table("events").select("user_id", "event_id", F.concat_ws("|", "event_type", "props").alias("payload")), "user_id", "event_id", "payload")
    altered = linked.withColumn("payload", F.when(F.expr("event_id % 9973 = 0 and event_id > 0"), F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    chains = verify_chain(altered, "user_id", "event_id", "payload")
    events = chains.groupBy((F.col("user_id") % 5).alias("org_id")).agg(F.sum("entries").alias("n_events"), F.count_if(~F.col("valid")).alias("broken"))
    c = evidence_counts(g).join(events, "org_id", "left").fillna(0)
    n, o, a = F.col("n_scans"), F.col("n_open"), F.col("n_att")
    control = lambda name, status, score: F.struct(F.lit(name).alias("control"), status.alias("status"), score.cast("double").alias("score"))
    every = F.array(
        control("CC6.1", F.when(a > 0, "pass").otherwise("partial"), F.least(F.lit(100.0), a / F.greatest(F.lit(1), n) * 100)),
        control("CC6.2", F.when(F.col("n_events") > 0, "pass").otherwise("fail"), F.when(F.col("n_events") > 0, 100).otherwise(0)),
        control("CC7.2", F.when(n > 0, "pass").otherwise("fail"), F.when(n > 10, 100).when(n > 0, 80).otherwise(0)),
        control("CC8.1", F.when((F.col("n_resolved") > 0) & (o == 0), "pass").when(o > 5, "partial").otherwise("pass"), F.least(F.lit(100), 100 - F.least(F.lit(50), o * 5))),
        control("A1.2", F.when(F.col("broken") == 0, "pass").otherwise("fail"), F.when(F.col("broken") == 0, 100).otherwise(0)),
    )
    mean = F.aggregate("x", F.lit(0.0), lambda s, y: s + y["score"]) / 5
    return c.select("org_id", every.alias("x")).select("org_id", half_up(mean).cast("long").alias("overall"), F.inline("x")).select("org_id", "control", "status", F.round("score", 6).alias("score"), "overall")


@query("admin_days", f"SELECT created_at::DATE AS day, count(*) AS total, count(*) FILTER (overall_risk = 'CRITICAL') AS critical FROM scans WHERE created_at >= {_NOW} - INTERVAL 7 DAY GROUP BY 1")
def admin_days(g):
    rows = g.scans_plain.where(F.col("created_at") >= now() - F.expr("interval 7 days"))
    return rows.groupBy(F.col("created_at").cast("date").alias("day")).agg(F.count("*").alias("total"), F.count_if(F.col("overall_risk") == "CRITICAL").alias("critical"))


@query("admin_top_orgs", f"SELECT org_id, count(*) AS scans FROM scans WHERE created_at >= {_NOW} - INTERVAL 30 DAY GROUP BY 1 ORDER BY scans DESC, org_id LIMIT 10")
def admin_top_orgs(g):
    """The ten most active organisations of the last thirty days (a top-k report)."""
    rows = g.scans_plain.where(F.col("created_at") >= now() - F.expr("interval 30 days"))
    return rows.groupBy("org_id").agg(F.count("*").alias("scans")).orderBy(F.desc("scans"), "org_id").limit(10)


@query("review_debt", f"WITH {_FACTS}, w AS (SELECT org_id, greatest(1, (epoch(max(created_at)) - epoch(min(created_at))) / 604800.0::DOUBLE) AS weeks, count(*) AS n FROM scans GROUP BY 1), o AS (SELECT org_id, count(*) FILTER (NOT attested) AS unsigned FROM top_files GROUP BY 1), v AS (SELECT org_id, count(*) FILTER (status = 'resolved') AS resolved FROM violations GROUP BY 1), x AS (SELECT org_id, unsigned, greatest(0, ceil(ceil(n / weeks) * ai * 2) - (resolved // 1000)) AS gap FROM facts JOIN w USING (org_id) JOIN o USING (org_id) JOIN v USING (org_id)) SELECT org_id, gap::BIGINT AS gap, (unsigned + gap * 2)::BIGINT AS debt_14d, CASE WHEN gap > 0 THEN ceil((unsigned + gap * 2) / 5.0) ELSE 0 END::BIGINT AS critical_estimate FROM x")
def review_debt(g):
    """Weekly review gap, the debt in a fortnight and the critical files expected among it."""
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    weeks = g.scans_plain.groupBy("org_id").agg(F.greatest(F.lit(1.0), (seconds(F.max("created_at")) - seconds(F.min("created_at"))) / 604800.0).alias("weeks"), F.count("*").alias("n"), F.avg("ai").alias("ai"))
    unsigned = top_files(g).groupBy("org_id").agg(F.count_if(~F.col("attested")).alias("unsigned"))
    resolved = g.violations.groupBy("org_id").agg(F.count_if(F.col("status") == "resolved").alias("resolved"))
    gap = F.greatest(F.lit(0), F.ceil(F.ceil(F.col("n") / F.col("weeks")) * F.col("ai") * 2) - F.floor(F.col("resolved") / 1000)).cast("long")
    rows = weeks.join(unsigned, "org_id").join(resolved, "org_id").withColumn("gap", gap).withColumn("debt_14d", F.col("unsigned") + F.col("gap") * 2)
    return rows.select("org_id", "gap", "debt_14d", F.when(F.col("gap") > 0, F.ceil(F.col("debt_14d") / 5)).otherwise(0).cast("long").alias("critical_estimate"))


@query("oldest_sla", f"SELECT org_id, risk, round({{0}} - oldest, 6) AS remaining_hours, {{0}} < oldest AS overdue FROM (SELECT org_id, risk, max(epoch({_NOW} - last_scan) / 3600.0::DOUBLE) AS oldest FROM (SELECT DISTINCT org_id, repo, risk FROM top_files WHERE NOT attested AND risk IN ('CRITICAL', 'HIGH')) JOIN (SELECT repo, last_scan FROM repo_stats) USING (repo) GROUP BY 1, 2)".replace("{0}", "CASE risk WHEN 'CRITICAL' THEN 24 ELSE 72 END"))
def oldest_sla(g):
    """Hours left for the repository scanned longest ago among those with unsigned files of a risk."""
    open_ = top_files(g).where(~F.col("attested") & F.col("risk").isin("CRITICAL", "HIGH")).select("org_id", "repo", "risk").distinct()
    rows = open_.join(repo_stats(g).select("repo", "last_scan"), "repo").groupBy("org_id", "risk").agg(hours_between(F.min("last_scan"), now()).alias("oldest"))
    limit = F.when(F.col("risk") == "CRITICAL", 24).otherwise(72)
    return rows.select("org_id", "risk", F.round(limit - F.col("oldest"), 6).alias("remaining_hours"), (limit < F.col("oldest")).alias("overdue"))


_ITEMS = "SELECT s_suppkey AS id, n_regionkey AS org_id, s_suppkey % 5 AS control, [25, 20, 20, 20, 15][(s_suppkey % 5)::INT + 1] AS weight, ['collected', 'pending', 'expired', 'collected', 'not-required', 'collected', 'pending'][(s_suppkey % 7)::INT + 1] AS status, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 30 END AS due FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def evidence_items(g):
    """Evidence items of controls, one for each supplier."""
    k = F.col("s_suppkey")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    rows = g.table("supplier").join(g.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    status = pick(["collected", "pending", "expired", "collected", "not-required", "collected", "pending"], 7)
    return rows.select(k.alias("id"), F.col("n_regionkey").alias("org_id"), (k % 5).alias("control"), pick([25, 20, 20, 20, 15], 5).alias("weight"), status.alias("status"), F.when(k % 3 != 0, k % 30).alias("due"))


@query("evidence_readiness", f"WITH i AS ({_ITEMS}), c AS (SELECT org_id, control, min(weight) AS weight, count(*) FILTER (status <> 'not-required') AS required, count(*) FILTER (status = 'collected') AS collected FROM i GROUP BY 1, 2) SELECT org_id, floor(sum(CASE WHEN required > 0 THEN collected / required::DOUBLE * weight ELSE weight END) / sum(weight) * 100 + 0.5)::BIGINT AS pct FROM c GROUP BY 1")
def evidence_readiness(g):
    """Weighted share of the required evidence that is collected; a control without required items counts in full."""
    c = evidence_items(g).groupBy("org_id", "control").agg(F.min("weight").alias("weight"), F.count_if(F.col("status") != "not-required").alias("required"), F.count_if(F.col("status") == "collected").alias("collected"))
    part = F.when(F.col("required") > 0, F.col("collected") / F.col("required") * F.col("weight")).otherwise(F.col("weight"))
    return c.groupBy("org_id").agg(half_up(F.sum(part) / F.sum("weight") * 100).cast("long").alias("pct"))


@query("evidence_gap_order", f"WITH i AS ({_ITEMS}) SELECT org_id, id, row_number() OVER (PARTITION BY org_id ORDER BY (status = 'expired')::INT DESC, (due IS NULL)::INT, due, weight DESC, id)::BIGINT AS place FROM i WHERE status IN ('pending', 'expired')")
def evidence_gap_order(g):
    """Missing evidence by urgency: expired first, then by due date, then by the control's weight."""
    order = Window.partitionBy("org_id").orderBy(F.desc(F.col("status") == "expired"), F.col("due").isNull(), "due", F.desc("weight"), "id")
    rows = evidence_items(g).where(F.col("status").isin("pending", "expired"))
    return rows.select("org_id", "id", F.row_number().over(order).cast("long").alias("place"))


@query("mixed_authorship", "SELECT scan_id, count(*) FILTER (ai > 0.65) AS high, count(*) FILTER (ai < 0.25) AS low, count(*) >= 4 AND count(*) FILTER (ai > 0.65) >= 2 AND count(*) FILTER (ai < 0.25) >= 2 AND count(*) FILTER (ai > 0.65 OR ai < 0.25) >= count(*) * 0.7 AS mixed, max(b) >= ceil(count(*) * 0.6) AND count(*) >= 3 AS one_brand FROM (SELECT *, count(*) OVER (PARTITION BY scan_id, brand) AS b FROM scan_files) GROUP BY 1")
def mixed_authorship(g):
    """Scans whose files are of two kinds, mostly machine and mostly human, and those where one model has 60 per cent."""
    of = F.count("*").over(Window.partitionBy("scan_id", "brand"))
    high, low, n = F.count_if(F.col("ai") > 0.65), F.count_if(F.col("ai") < 0.25), F.count("*")
    rows = g.scan_files.withColumn("b", of).groupBy("scan_id")
    return rows.agg(high.alias("high"), low.alias("low"), ((n >= 4) & (high >= 2) & (low >= 2) & (high + low >= n * 0.7)).alias("mixed"), ((F.max("b") >= F.ceil(n * 0.6)) & (n >= 3)).alias("one_brand"))


# Marks of machine-written lines; a line's share is 0.22 for each.
LINE_MARKS = [
    r"\bconst\s+(?:result|response|data)\s*=\s*await\s+", r"\b(?:validateInput|handleError|processData|sanitizeInput)\s*\(", r"\bif\s*\(\s*!(?:input|data|value|params|options|config|request|body)\s*\)", r"\breturn\s+\{\s*(?:success|data|error|result|message|status)\s*:",
    r"""\bthrow\s+new\s+(?:Error|[A-Z]\w*Error)\s*\(\s*["'`]""", r"^\s*//\s*[A-Z][a-z].{15,}[.!]?\s*$", r"\bconsole\.(?:log|error|warn)\s*\(\s*\{", r"\bconst\s+\{\s*\w+(?:\s*,\s*\w+)+\s*\}\s*=",
]
_MARKED = " + ".join(f"regexp_matches(line, {_quote(p)})::INT" for p in LINE_MARKS)
_LINES_OF = f"SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS n FROM ({_FILES})"


@query("line_attribution", f"SELECT path, n AS line, round(least(1, 0.22::DOUBLE * ({_MARKED})), 8) AS share FROM ({_LINES_OF}) WHERE length(trim(line, ' ')) >= 5 AND {_MARKED} > 0")
def line_attribution(g):
    """Lines with marks of machine authorship, and their share."""
    hits = sum((F.col("text").rlike(p).cast("int") for p in LINE_MARKS), F.lit(0))
    rows = detectors.lines_of(code_files(g)).where(F.length(F.trim("text")) >= 5).withColumn("hits", hits).where("hits > 0")
    return rows.select("path", "line", F.round(F.least(F.lit(1.0), F.col("hits") * 0.22), 8).alias("share"))


# Artefacts of agents (label, pattern), and marks of rushed code.
ARTIFACTS = [
    ("AI generator attribution comment", r"(?i)\bgenerated\s+by\s+(?:claude|chatgpt|gpt-?[34]|copilot|cursor|gemini)\b"), ("ai-generated marker", r"(?i)\bai[_-]?generated\b"), ("do-not-edit directive", r"(?i)\bdo\s+not\s+(?:edit|modify)\s+(?:this\s+)?(?:file|code)\s+manually\b"),
    ("auto-generated header", r"(?i)\bauto[_-]?generated\s+by\s+\w"), ("prompt-id artifact", r"""(?i)\bprompt[_-]?id\s*[:=]\s*["']?\w"""), ("session-id artifact", r"""(?i)\bsession[_-]?id\s*[:=]\s*["'][\w-]{20,}["']"""), ("@generated JSDoc tag", r"@generated\b"), ("@ai annotation", r"(?i)//\s*@ai\b"),
]
RUSHED = [r"(?i)\bTODO\s*:", r"(?i)\bHACK\s*:", r"(?i)\bFIXME\s*:", r"(?i)\btemporary\b", r"(?i)\bquick[_\s-]?fix\b", r"(?i)\bworkaround\b"]
_MARKS = ["// auto_generated by tool", "# TODO: this is a temporary workaround", "/* @generated, do not edit this file manually */", "quick fix; FIXME: x HACK: y", "// @ai generated by copilot, prompt_id: 7", ""]
_MARKED_FILES = f"SELECT doc_id, coalesce(text, '') || chr(10) || [{', '.join(map(_quote, _MARKS))}][(doc_id % {len(_MARKS)})::INT + 1] AS text FROM documents"


@query("provenance_markers", "SELECT doc_id, " + " + ".join(f"regexp_matches(text, {_quote(p)})::INT" for _, p in ARTIFACTS) + " AS artifacts, round(least(1, (" + " + ".join(f"len(regexp_extract_all(text, {_quote(p)}))" for p in RUSHED) + f") / greatest(10, len(string_split(text, chr(10))) / 20.0::DOUBLE)), 8) AS temporal_risk FROM ({_MARKED_FILES})")
def provenance_markers(g):
    """Artefacts of agents in whole files, and the density of marks of rushed code."""
    mark = F.element_at(F.array(*[F.lit(m) for m in _MARKS]), (F.col("doc_id") % len(_MARKS) + 1).cast("int"))
    rows = g.table("documents").select("doc_id", F.concat_ws("\n", F.coalesce("text", F.lit("")), mark).alias("text"))
    rushed = sum((F.regexp_count("text", F.lit(p)) for p in RUSHED), F.lit(0))
    artefacts = sum((F.col("text").rlike(p).cast("int") for _, p in ARTIFACTS), F.lit(0))
    return rows.select("doc_id", artefacts.alias("artifacts"), F.round(F.least(F.lit(1.0), rushed / F.greatest(F.lit(10.0), F.size(F.split("text", "\n")) / 20)), 8).alias("temporal_risk"))


# Vulnerability, its weakness and the effort of the usual fix.
FIXES = [
    ("sql-injection", "CWE-89", "low"), ("xss", "CWE-79", "low"), ("hardcoded-secret", "CWE-798", "low"), ("command-injection", "CWE-78", "low"), ("path-traversal", "CWE-22", "low"), ("eval-exec", "CWE-95", "medium"), ("weak-crypto", "CWE-327", "low"),
    ("ssrf", "CWE-918", "medium"), ("insecure-deserialization", "CWE-502", "medium"), ("prototype-pollution", "CWE-1321", "low"), ("open-redirect", "CWE-601", "low"), ("weak-cors", "CWE-942", "low"), ("backdoor-detection", "CWE-506", "high"), ("watermark-detection", None, "low"),
]
_FIX_ROWS = ", ".join(f"('{v}', {repr(c) if c else 'NULL'}, '{e}')" for v, c, e in FIXES)
_FOUND = ", ".join(f"({k}, '{i}')" for k, (_, found) in enumerate(SNIPPETS) for _, i in found)


@query("fix_suggestions", f"SELECT DISTINCT 'src/f' || doc_id || '.ts' AS path, id, cwe, effort FROM documents JOIN (VALUES {_FOUND}) e(k, id) ON doc_id % {len(SNIPPETS)} = k JOIN (VALUES {_FIX_ROWS}) f(id, cwe, effort) USING (id)")
def fix_suggestions(g):
    """The usual fix for each kind of finding of a file, once; the table of fixes is a fixed one."""
    files = snippet_files(g)
    found = detectors.findings(files).select("path", "id").distinct()
    return found.join(F.broadcast(g.spark.createDataFrame(FIXES, "id string, cwe string, effort string")), "id").select("path", "id", "cwe", "effort")


# Risks of code as such (severity, kind, pattern).
CODE_RISKS = [
    ("high", "eval-usage", r"\beval\s*\("), ("high", "new-function", r"new\s+Function\s*\("), ("high", "document-write", r"document\.write\s*\("), ("high", "prototype-pollution", r"__proto__\s*=|Object\.setPrototypeOf"), ("high", "unsafe-inner-html", r"dangerouslySetInnerHTML"), ("high", "command-exec", r"child_process|execSync\s*\(|spawn\s*\("),
    ("medium", "inner-html-write", r"innerHTML\s*=|outerHTML\s*="), ("medium", "weak-random", r"Math\.random\s*\(\)"), ("medium", "weak-hash", r"""(?i)(?:createHash|hash)\s*\(\s*['"](?:md5|sha1)['"]"""), ("medium", "bind-all-interfaces", r"0\.0\.0\.0"), ("medium", "security-todo", r"(?i)TODO.*(?:security|auth|crypto|vuln|fix)"), ("medium", "os-system-dynamic", r"""os\.system\s*\(\s*[^'"]"""),
    ("low", "debug-log", r"console\.(?:log|debug|info)\s*\("), ("low", "debugger-stmt", r"\bdebugger\b"), ("low", "suppressed-lint", r"//\s*@ts-ignore|//\s*eslint-disable"), ("low", "process-exit", r"process\.exit\s*\("),
]
# Risks with what must not follow; an oracle without look-ahead cuts the exceptions first.
LOOKING = [("medium", "dynamic-require", r"require\s*\(\s*(?!['\"`\s])[^)]+\)", r"require\s*\(\s*['\"`][^)]*\)", r"require\s*\(\s*[^)\s][^)]*\)")]
PLAIN_HTTP, LOCAL_HTTP = r"http://(?!localhost|127\.)", r"http://(?:localhost|127\.)"
_BARE, _COMMENT = r"^\s*(?:#|//).*$|//.*$", r"^\s*(?:#|//)"


@query("code_risks", f"WITH l AS MATERIALIZED (SELECT path, n, line, regexp_replace(line, {_quote(_BARE)}, '') AS bare FROM ({_LINES_OF})) " + " UNION ALL ".join([f"SELECT path, n AS line, '{k}' AS kind, '{s}' AS severity FROM l WHERE regexp_matches(bare, {_quote(p)})" for s, k, p in CODE_RISKS] + [f"SELECT path, n, '{k}', '{s}' FROM l WHERE regexp_matches(regexp_replace(bare, {_quote(cut)}, '', 'g'), {_quote(p)})" for s, k, _, cut, p in LOOKING] + [f"SELECT path, n, 'plaintext-http', 'medium' FROM l WHERE NOT regexp_matches(line, {_quote(_COMMENT)}) AND regexp_matches(regexp_replace(line, {_quote(LOCAL_HTTP)}, '', 'g'), 'http://')"]))
def code_risks(g):
    """Eighteen risky constructs by line, comments left out; an address is read before what follows its slashes is cut as one."""
    risks = [F.when(F.col("bare").rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"))) for s, k, p in [*CODE_RISKS, *(x[:3] for x in LOOKING)]]
    risks.append(F.when(~F.col("text").rlike(_COMMENT) & F.col("text").rlike(PLAIN_HTTP), F.struct(F.lit("plaintext-http").alias("kind"), F.lit("medium").alias("severity"))))
    rows = detectors.lines_of(code_files(g)).select("path", "line", "text", F.regexp_replace("text", _BARE, "").alias("bare"))
    return rows.select("path", "line", F.inline(F.array_compact(F.array(*risks))))


@query("manifest_files", "SELECT file_path FROM (SELECT 'app/' || doc_id || ['/requirements.txt', '/package.json', '/GO.MOD', '/package.json.bak', '/readme.md'][(doc_id % 5)::INT + 1] AS file_path FROM documents) WHERE file_path ILIKE '%requirements.txt' OR file_path ILIKE '%package.json' OR file_path ILIKE '%go.mod'")
def manifest_files(g):
    """Manifests by the end of their path, in any case."""
    ends = F.element_at(F.array(*[F.lit(x) for x in ("/requirements.txt", "/package.json", "/GO.MOD", "/package.json.bak", "/readme.md")]), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = g.table("documents").select(F.concat(F.lit("app/"), "doc_id", ends).alias("file_path"))
    low = F.lower("file_path")
    return rows.where(low.endswith("requirements.txt") | low.endswith("package.json") | low.endswith("go.mod"))


@query("graph_manifests", "SELECT p_partkey, 'pip' AS ecosystem, lower(replace(p_name, ' ', '-')) AS name, p_size || '.1' AS version FROM part UNION ALL SELECT p_partkey, 'npm', replace(p_name, ' ', '-'), p_size || '.0.1' FROM part UNION ALL SELECT p_partkey, 'go', split_part(p_name, ' ', 2), p_size || '.2.0' FROM part")
def graph_manifests(g):
    """The dependency graph's own parsers: first bound of a requirement, first of a range, last part of a module's path."""
    rows = g.table("part").select(
        "p_partkey",
        F.concat(F.lit("# list\n-r base.txt\n"), F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit(">="), "p_size", F.lit(".1,<99\nbad line here\n")).alias("pip"),
        F.concat(F.lit('{"devDependencies":{"'), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit('":"^'), "p_size", F.lit('.0.1 <99"}}')).alias("npm"),
        F.concat(F.lit("module m\nrequire (\n\tgithub.com/x/"), F.element_at(F.split("p_name", " "), 2), F.lit(" v"), "p_size", F.lit(".2.0\n)\n")).alias("go"),
    )
    line = lambda c: F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, "\t", " ")))
    named = lambda e, n, v: F.struct(F.lit(e).alias("ecosystem"), n.alias("name"), v.alias("version"))
    requirement = r"^([a-zA-Z0-9_-]+)([>=<!~^].*)?$"
    pip = F.transform(F.filter(line("pip"), lambda x: x.rlike(requirement) & ~x.rlike("^[#-]")), lambda x: named("pip", F.lower(F.regexp_extract(x, requirement, 1)), F.trim(F.split(F.regexp_replace(F.regexp_extract(x, requirement, 2), "[>=<!~^]", ""), ",")[0])))
    both = F.from_json("npm", "dependencies map<string,string>, devDependencies map<string,string>")
    entries = F.map_entries(F.map_concat(F.coalesce(both["dependencies"], F.create_map().cast("map<string,string>")), F.coalesce(both["devDependencies"], F.create_map().cast("map<string,string>"))))
    npm = F.transform(entries, lambda x: named("npm", x["key"], F.split(F.regexp_replace(x["value"], r"[\^~>=]", ""), " ")[0]))
    module = r"([a-zA-Z0-9./\-_]+)\s+v([0-9.]+)"
    go = F.transform(F.filter(line("go"), lambda x: (x.startswith("require") | x.contains("github.com") | x.contains("golang.org")) & x.rlike(module)), lambda x: named("go", F.element_at(F.split(F.regexp_extract(x, module, 1), "/"), -1), F.regexp_extract(x, module, 2)))
    return rows.select("p_partkey", F.inline(F.concat(pip, npm, go)))


# Packages with vulnerable versions from (or none) to the first fixed one, by severity; NEVER is fixed in none.
NEVER = "999999"
VULNERABLE = [
    ("lodash", None, "4.17.21", "HIGH"), ("lodash", None, "4.17.21", "HIGH"), ("lodash", None, "4.17.12", "CRITICAL"), ("axios", None, "1.6.0", "HIGH"), ("axios", None, "0.21.2", "HIGH"), ("express", None, "4.18.2", "HIGH"), ("node-fetch", None, "2.6.7", "HIGH"), ("moment", None, "2.29.2", "HIGH"), ("moment", None, "2.29.4", "HIGH"),
    ("minimist", None, "1.2.6", "CRITICAL"), ("minimist", None, "0.2.1", "MEDIUM"), ("json-schema", None, "0.4.0", "CRITICAL"), ("follow-redirects", None, "1.15.4", "MEDIUM"), ("semver", None, "7.5.2", "HIGH"), ("got", None, "11.8.5", "MEDIUM"), ("qs", None, "6.10.3", "HIGH"), ("parse-url", None, "8.1.0", "CRITICAL"), ("next", None, "14.1.1", "HIGH"), ("next", None, "14.2.10", "CRITICAL"),
    ("webpack", None, "5.76.0", "CRITICAL"), ("tar", None, "6.1.6", "HIGH"), ("node-serialize", None, NEVER, "CRITICAL"), ("colors", "1.4.1", "1.4.44", "HIGH"), ("ua-parser-js", None, "0.7.23", "HIGH"), ("ua-parser-js", "0.7.29", "0.7.30", "CRITICAL"), ("@xmldom/xmldom", None, "0.8.6", "CRITICAL"), ("decode-uri-component", None, "0.2.1", "HIGH"), ("fast-xml-parser", None, "4.1.2", "HIGH"),
]
# Mistyped names and what they stand for, well-known and deprecated packages.
TYPOS = {
    "require": "core", "loadsh": "lodash", "lodahs": "lodash", "lodaash": "lodash", "expres": "express", "expresss": "express", "reect": "react", "raect": "react", "reqest": "request", "requets": "request", "momment": "moment", "moement": "moment", "wepack": "webpack", "webpak": "webpack", "eslnt": "eslint", "eslimt": "eslint",
    "babbel": "babel", "babael": "babel", "jooi": "joi", "joio": "joi", "typscript": "typescript", "typescipt": "typescript", "nod-fetch": "node-fetch", "node-fecth": "node-fetch", "crossenv": "cross-env", "cross-evn": "cross-env", "nodemailer": "nodemailer", "node-mailer": "nodemailer", "event-emmiter": "eventemitter3", "eventemitter": "eventemitter3",
    "crypto-js2": "crypto-js", "cryptojs": "crypto-js", "socket-io": "socket.io", "socketio": "socket.io", "mongoose-db": "mongoose", "mongoosejs": "mongoose", "aws-sdk2": "aws-sdk", "awssdk": "aws-sdk",
}
NEAR = ["react", "lodash", "express", "axios", "moment", "webpack", "babel", "jest", "typescript", "eslint"]
WELL_KNOWN = "react react-dom next typescript webpack babel eslint jest vitest axios lodash express fastify koa hapi nestjs prisma mongoose moment dayjs date-fns zod yup joi class-validator tailwindcss postcss sass styled-components @emotion/react redux zustand mobx recoil jotai @tanstack/react-query react-router react-router-dom next-auth passport jsonwebtoken bcrypt socket.io ws ioredis bullmq nodemailer @aws-sdk/client-s3 dotenv cross-env rimraf husky lint-staged prettier commitlint ts-node tsx esbuild vite rollup parcel".split()
DEPRECATED = "request node-uuid circular-json optimist colors faker date-fns-tz node-serialize event-stream flatmap-stream".split()
_PACKAGES = ["lodash", "axios", "express", "moment", "minimist", "next", "colors", "ua-parser-js", "webpack", "node-serialize", "loadsh", "recat", "request", "left-hand", "semver", "jestt", "zod"]
_VALUES = ", ".join(f"('{n}', {repr(a) if a else 'NULL'}, '{b}', '{s}')" for n, a, b, s in VULNERABLE)
_KEY = "list_transform(string_split({0} || '.0.0', '.')[1:3], lambda x: x::INT)"
_PKG = f"SELECT p_partkey AS manifest, unnest(list_filter([{', '.join(map(_quote, _PACKAGES))}], lambda x, i: (i - 1) % 3 = p_partkey % 3)) AS name, (p_size % 9) || '.' || (p_size % 19) || '.' || (p_partkey % 23) AS version FROM part"
_REPORT = f"""WITH p AS ({_PKG}), v(name, low, high, severity) AS (VALUES {_VALUES}),
    m AS (SELECT manifest, p.name, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'HIGH') AS h, count(*) FILTER (severity = 'MEDIUM') AS m FROM p JOIN v ON p.name = v.name WHERE {_KEY.format('version')} < {_KEY.format('high')} AND (low IS NULL OR {_KEY.format('version')} >= {_KEY.format('low')}) GROUP BY 1, 2),
    t AS (SELECT DISTINCT name FROM p WHERE lower(name) IN ({', '.join(map(_quote, TYPOS))}) OR (SELECT bool_or(levenshtein(lower(p.name), n) = 1 AND p.name <> n) FROM (SELECT unnest([{', '.join(map(_quote, NEAR))}]) AS n))),
    r AS (SELECT p.manifest, p.name, coalesce(c, 0) AS c, coalesce(h, 0) AS h, coalesce(m, 0) AS m, t.name IS NOT NULL AS typo, p.name IN ({', '.join(map(_quote, DEPRECATED))}) AS old,
      greatest(0, least(1, CASE WHEN p.name IN ({', '.join(map(_quote, WELL_KNOWN))}) THEN 0.95 ELSE 0.70 END - CASE WHEN p.name IN ({', '.join(map(_quote, DEPRECATED))}) THEN 0.40 ELSE 0 END - coalesce(c, 0) * 0.20 - coalesce(h, 0) * 0.10))::DOUBLE AS reputation FROM p LEFT JOIN m USING (manifest, name) LEFT JOIN t ON p.name = t.name)"""


def dependency_risks(g):
    """Packages of generated manifests with their vulnerabilities by severity, and whether they are mistyped or deprecated."""
    names = F.array(*[F.lit(p) for p in _PACKAGES])
    every = F.filter(names, lambda x, i: i % 3 == F.col("p_partkey") % 3)
    rows = g.table("part").select(F.col("p_partkey").alias("manifest"), F.concat_ws(".", F.col("p_size") % 9, F.col("p_size") % 19, F.col("p_partkey") % 23).alias("version"), F.explode(every).alias("name"))
    ranges = g.spark.createDataFrame(VULNERABLE, "name string, low string, high string, severity string")
    n = lambda s: F.count_if(F.col("severity") == s)
    found = match_cves(rows, ranges).groupBy("manifest", "name").agg(n("CRITICAL").alias("c"), n("HIGH").alias("h"), n("MEDIUM").alias("m"))
    low = F.lower("name")
    typo = low.isin(*TYPOS) | F.exists(F.array(*[F.lit(x) for x in NEAR]), lambda x: (F.levenshtein(low, x) == 1) & (F.col("name") != x))
    rows = rows.join(found, ["manifest", "name"], "left").fillna(0, ["c", "h", "m"]).withColumn("typo", typo).withColumn("old", F.col("name").isin(*DEPRECATED))
    score = F.when(F.col("name").isin(*WELL_KNOWN), 0.95).otherwise(0.70) - F.when(F.col("old"), 0.40).otherwise(0.0) - F.col("c") * 0.20 - F.col("h") * 0.10
    return rows.withColumn("reputation", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


@query("risky_packages", f"{_REPORT} SELECT manifest, name, c + h + m AS vulnerabilities, typo AS is_typosquat, old AS is_deprecated, round(reputation, 8) AS reputation FROM r WHERE c + h + m > 0 OR typo OR old OR round(reputation, 9) < 0.30")
def risky_packages(g):
    rows = dependency_risks(g).withColumn("vulnerabilities", F.col("c") + F.col("h") + F.col("m"))
    rows = rows.where((F.col("vulnerabilities") > 0) | F.col("typo") | F.col("old") | (F.round("reputation", 9) < 0.30))
    return rows.select("manifest", "name", "vulnerabilities", F.col("typo").alias("is_typosquat"), F.col("old").alias("is_deprecated"), F.round("reputation", 8).alias("reputation"))


@query("dependency_report", f"{_REPORT} SELECT manifest, sum(c)::BIGINT AS critical, sum(h)::BIGINT AS high, sum(m)::BIGINT AS medium, round(greatest(0, 1 - sum(c) * 0.20::DOUBLE - sum(h) * 0.10::DOUBLE - sum(m) * 0.04::DOUBLE - count(*) FILTER (typo) / count(*)::DOUBLE * 0.5), 8) AS score FROM r GROUP BY 1")
def dependency_report(g):
    """Counts by severity and the overall score of each manifest."""
    rows = dependency_risks(g).groupBy("manifest").agg(F.sum("c").alias("critical"), F.sum("h").alias("high"), F.sum("m").alias("medium"), (F.count_if("typo") / F.count("*")).alias("typos"))
    score = 1 - F.col("critical") * 0.20 - F.col("high") * 0.10 - F.col("medium") * 0.04 - F.col("typos") * 0.5
    return rows.select("manifest", "critical", "high", "medium", F.round(F.greatest(F.lit(0.0), score), 8).alias("score"))


_HMAC_KEY = b"export-key"
_INNER, _OUTER = (bytes(b ^ p for b in _HMAC_KEY.ljust(64, b"\0")).hex() for p in (0x36, 0x5C))


def hmac_sha256(text):
    """HMAC-SHA256 of a text with the fixed key, from two digests."""
    inner = F.unhex(F.sha2(F.concat(F.unhex(F.lit(_INNER)), text.cast("binary")), 256))
    return F.sha2(F.concat(F.unhex(F.lit(_OUTER)), inner), 256)


@query("signed_rows", f"SELECT scan_id, file_path, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || (scan_id || ':' || file_path || ':' || risk)::BLOB))) AS signature FROM attestations WHERE risk = 'CRITICAL'")
def signed_rows(g):
    """The export's rows, each signed by HMAC-SHA256."""
    rows = g.attestations.where("risk = 'CRITICAL'")
    return rows.select("scan_id", "file_path", hmac_sha256(F.concat_ws(":", "scan_id", "file_path", "risk")).alias("signature"))


_ENTRY = """'{"id":' || event_id || ',"type":"' || event_type || '","ts":' || epoch_us(ts) || ',"desc":"' || event_type || ' ' || event_id || '","actor":' || user_id || ',"repo":null}'"""


@query("ui_chain", f"SELECT user_id, count(*) AS entries, list_reduce(list_prepend(repeat('0', 64), list({_ENTRY} ORDER BY ts, event_id)), lambda a, x: sha256(a || ':' || x)) AS head FROM events GROUP BY 1")
def ui_chain(g):
    """The viewer's chain: from 64 zeros on, each entry's hash covers the hash before it and the entry; the last is the head."""
    rows = g.table("events").select("user_id", F.struct("ts", "event_id").alias("at"), audit_entry().alias("entry"))
    linked = chained(rows, "user_id", "at", "entry", genesis="0" * 64, ordered=False)
    return linked.groupBy("user_id").agg(F.count("*").alias("entries"), F.max_by("entry_hash", "at").alias("head"))


def audit_entry():
    """An audit event as canonical JSON."""
    return F.concat(F.lit('{"id":'), "event_id", F.lit(',"type":"'), "event_type", F.lit('","ts":'), F.unix_micros(F.col("ts").cast("timestamp")), F.lit(',"desc":"'), "event_type", F.lit(" "), "event_id", F.lit('","actor":'), "user_id", F.lit(',"repo":null}'))


#: Rows of an export at most; a limit of the feature.
EXPORT_ROWS = 10_000
_SINCE = f"{_NOW} - INTERVAL 365 DAY"


def _since(rows, column: str = "created_at"):
    return rows.where(F.col(column) >= now() - F.expr("interval 365 days"))


@query("export_scans", f"SELECT id, repo, pr_number, overall_risk, ai, triggered_by, created_at FROM scans WHERE created_at >= {_SINCE} ORDER BY created_at DESC, id LIMIT {EXPORT_ROWS}")
def export_scans(g):
    return _since(g.scans_plain).orderBy(F.desc("created_at"), "id").limit(EXPORT_ROWS).select("id", "repo", "pr_number", "overall_risk", "ai", "triggered_by", "created_at")


@query("export_attestations", f"SELECT scan_id, file_path, risk, reviewer, sha256(scan_id || '::' || file_path || '::' || reviewer || '::' || risk) AS payload_hash, attested_at FROM attestations WHERE attested_at >= {_SINCE} ORDER BY attested_at DESC, scan_id, file_path LIMIT {EXPORT_ROWS}")
def export_attestations(g):
    rows = _since(g.attestations, "attested_at").orderBy(F.desc("attested_at"), "scan_id", "file_path").limit(EXPORT_ROWS)
    return rows.select("scan_id", "file_path", "risk", "reviewer", F.sha2(F.concat_ws("::", "scan_id", "file_path", "reviewer", "risk"), 256).alias("payload_hash"), "attested_at")


@query("export_aibom", f"SELECT repo, file_path, ai, risk, array_to_string(indicators, '; ') AS risk_indicators, scan_id, created_at AS scanned_at, has_r AS attested FROM scan_files WHERE created_at >= {_SINCE} ORDER BY ai DESC, scan_id, file_path LIMIT {EXPORT_ROWS}")
def export_aibom(g):
    """Files by AI share with their sign-off; whoever signed a file did so in the same scan."""
    rows = _since(g.scan_files).orderBy(F.desc("ai"), "scan_id", "file_path").limit(EXPORT_ROWS)
    return rows.select("repo", "file_path", "ai", "risk", F.array_join("indicators", "; ").alias("risk_indicators"), "scan_id", F.col("created_at").alias("scanned_at"), F.col("has_r").alias("attested"))


@query("export_audit", f"SELECT event_id, event_type, user_id AS actor, sha256(event_type || '|' || props) AS entry_hash, ts FROM events ORDER BY event_id DESC LIMIT {EXPORT_ROWS}")
def export_audit(g):
    rows = g.table("events").orderBy(F.desc("event_id")).limit(EXPORT_ROWS)
    return rows.select("event_id", "event_type", F.col("user_id").alias("actor"), F.sha2(F.concat_ws("|", "event_type", "props"), 256).alias("entry_hash"), "ts")


@query("export_secrets", f"SELECT doc_id, line, id, severity FROM (SELECT doc_id, (len(string_split(coalesce(text, ''), chr(10))) + n)::INT AS line, id, 'critical' AS severity FROM documents JOIN (VALUES " + ", ".join(f"({k}, {n}, '{i}')" for k, (_, found) in enumerate(SNIPPETS) for n, i in found if i.endswith("-secret")) + f") e(k, n, id) ON doc_id % {len(SNIPPETS)} = k) ORDER BY doc_id, line, id LIMIT {EXPORT_ROWS}")
def export_secrets(g):
    """Secrets found in whole files."""
    files = snippet_files(g)
    found = detectors.findings(files).where(F.col("id").endswith("-secret")).join(files.select("path", "doc_id"), "path")
    return found.select("doc_id", "line", "id", "severity").orderBy("doc_id", "line", "id").limit(EXPORT_ROWS)


_SEARCH = [
    ("scans", "SELECT id::VARCHAR AS id, repo AS title, pr_author AS subtitle, created_at FROM scans"),
    ("violations", "SELECT scan_id::VARCHAR || ':' || file_path AS id, file_path AS title, status AS subtitle, created_at FROM violations"),
    ("secrets", "SELECT s_suppkey::VARCHAR AS id, s_name AS title, 'ring ' || s_nationkey AS subtitle, TIMESTAMP '2000-01-01' AS created_at FROM supplier"),
    ("incidents", "SELECT p_partkey::VARCHAR AS id, p_name AS title, p_brand AS subtitle, TIMESTAMP '2000-01-02' AS created_at FROM part"),
    ("audit", "SELECT event_id::VARCHAR AS id, event_type AS title, user_id::VARCHAR AS subtitle, ts AS created_at FROM events"),
]


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def _search_sql(text: str, limit: int = 50) -> str:
    like = "'%" + _escaped(text).replace("'", "''") + "%' ESCAPE '\\'"
    low = _quote(text.lower())
    score = f"(CASE WHEN starts_with(lower(title), {low}) THEN 100 ELSE 0 END + CASE WHEN contains(lower(title), {low}) THEN 50 ELSE 0 END + CASE WHEN contains(lower(subtitle), {low}) THEN 20 ELSE 0 END + CASE WHEN regexp_matches(lower(title), '\\b{text.lower()}\\b') THEN 30 ELSE 0 END)"
    parts = " UNION ALL ".join(f"(SELECT '{k}' AS kind, id, title, {score} AS score, created_at FROM ({s}) WHERE title ILIKE {like} OR subtitle ILIKE {like} ORDER BY created_at DESC, id LIMIT {limit // 5})" for k, s in _SEARCH)
    return f"SELECT kind, id, title, score FROM ({parts}) ORDER BY score DESC, created_at DESC, kind, id LIMIT {limit}"


@query("search_all", _search_sql("ring"))
def search_all(g, text: str = "ring", limit: int = 50):
    """Five typed searches by pattern, each with its share of the limit (newest first), ranked together (a top-k report)."""
    from .governance import search_rank

    day = lambda d: F.lit(d).cast("timestamp_ntz")
    named = lambda rows, i, t, s, at: rows.select(i.cast("string").alias("id"), t.alias("title"), s.cast("string").alias("subtitle"), at.alias("created_at"))
    c = F.col
    branches = {
        "scans": named(g.scans_plain, c("id"), c("repo"), c("pr_author"), c("created_at")),
        "violations": named(g.violations, F.concat_ws(":", "scan_id", "file_path"), c("file_path"), c("status"), c("created_at")),
        "secrets": named(g.table("supplier"), c("s_suppkey"), c("s_name"), F.concat(F.lit("ring "), "s_nationkey"), day("2000-01-01")),
        "incidents": named(g.table("part"), c("p_partkey"), c("p_name"), c("p_brand"), day("2000-01-02")),
        "audit": named(g.table("events"), c("event_id"), c("event_type"), c("user_id"), c("ts").cast("timestamp_ntz")),
    }
    like = F.lit(f"%{_escaped(text)}%")
    out = None
    for kind, rows in branches.items():
        rows = rows.where(F.ilike("title", like, F.lit("\\")) | F.ilike("subtitle", like, F.lit("\\"))).orderBy(F.desc("created_at"), "id").limit(limit // 5)
        rows = rows.select(F.lit(kind).alias("kind"), "id", "title", search_rank(c("title"), c("subtitle"), text).alias("score"), "created_at")
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy(F.desc("score"), F.desc("created_at"), "kind", "id").limit(limit).drop("created_at")


@query("notification_news", f"""WITH n AS (SELECT repo, count(*) AS total, count(*) FILTER (created_at >= {_NOW} - INTERVAL 7 DAY AND overall_risk IN ('CRITICAL', 'HIGH')) AS news, max_by(overall_risk, (created_at, id)) AS latest, min(created_at) AS first FROM scans GROUP BY 1)
    SELECT repo, news AS new_risky, first >= {_NOW} - INTERVAL 7 DAY AS is_new, latest IN ('CRITICAL', 'HIGH') AS alarming FROM n""")
def notification_news(g):
    """What a week brought to each repository: risky scans, whether it is new, and its latest risk."""
    week = now() - F.expr("interval 7 days")
    risky = risk_rank(F.col("overall_risk")) >= 3
    rows = g.scans_plain.groupBy("repo").agg(F.count_if((F.col("created_at") >= week) & risky).alias("new_risky"), (F.min("created_at") >= week).alias("is_new"), F.max_by("overall_risk", F.struct("created_at", "id")).alias("latest"))
    return rows.select("repo", "new_risky", "is_new", F.col("latest").isin("CRITICAL", "HIGH").alias("alarming"))


_HELD = f"greatest(0, epoch(TIMESTAMP '{AS_OF}' - created_at) / 86400.0::DOUBLE - 30)"


@query("risk_summary", f"WITH r AS (SELECT org_id, CASE risk WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 16 WHEN 'MEDIUM' THEN 9 ELSE 4 END AS inherent, CASE risk WHEN 'CRITICAL' THEN 15 WHEN 'HIGH' THEN 12 WHEN 'MEDIUM' THEN 6 ELSE 2 END AS residual, {_HELD} AS late FROM current_violations) SELECT org_id, count(*) AS open_risks, count(*) FILTER (late > 0) AS overdue, count(*) FILTER (inherent >= 20) AS critical, round(avg(inherent), 6) AS avg_inherent, round(avg(residual), 6) AS avg_residual FROM r GROUP BY 1")
def risk_summary(g):
    """Open and overdue risks, and the means of inherent and residual scores."""
    from .governance import current_violations

    by = lambda a, b, c, d: F.when(F.col("risk") == "CRITICAL", a).when(F.col("risk") == "HIGH", b).when(F.col("risk") == "MEDIUM", c).otherwise(d)
    rows = g.violations.select("scan_id", "file_path", "created_at").withColumnRenamed("created_at", "at")
    rows = current_violations(g).join(rows, ["scan_id", "file_path"])
    late = hours_between(F.col("at"), now()) / 24 - 30
    return rows.groupBy("org_id").agg(F.count("*").alias("open_risks"), F.count_if(late > 0).alias("overdue"), F.count_if(by(25, 16, 9, 4) >= 20).alias("critical"), F.round(F.avg(by(25, 16, 9, 4)), 6).alias("avg_inherent"), F.round(F.avg(by(15, 12, 6, 2)), 6).alias("avg_residual"))


# Weights of a vector's parts; vectors of findings (attack complexity, privileges, interaction, scope changed, C, I, A).
AC, PR, UI = {"L": 0.77, "H": 0.44}, {"N": 0.85, "L": 0.62}, {"N": 0.85, "R": 0.62}
PROFILES = {
    "sql-injection": ("L", "N", "N", True, 0.56, 0.56, 0.56), "xss": ("L", "N", "R", True, 0.56, 0.56, 0), "command-injection": ("L", "N", "N", True, 0.56, 0.56, 0.56), "path-traversal": ("L", "N", "N", False, 0.56, 0.22, 0), "eval-exec": ("L", "N", "N", True, 0.56, 0.56, 0.56), "ssrf": ("L", "N", "N", True, 0.56, 0.22, 0),
    "hardcoded-secret": ("L", "N", "N", True, 0.56, 0.56, 0.22), "insecure-deserialization": ("H", "N", "N", True, 0.56, 0.56, 0.56), "weak-crypto": ("H", "N", "N", False, 0.22, 0.22, 0), "prototype-pollution": ("L", "N", "N", True, 0.56, 0.56, 0.22), "open-redirect": ("L", "N", "R", False, 0.22, 0.22, 0), "insecure-randomness": ("H", "N", "N", False, 0.22, 0.22, 0),
    "weak-cors": ("L", "N", "R", True, 0.56, 0.56, 0), "backdoor-detection": ("L", "N", "N", True, 0.56, 0.56, 0.56), "pii-in-logs": ("L", "L", "N", False, 0.56, 0, 0), "timing-attack": ("H", "N", "N", False, 0.22, 0, 0), "cookie-insecurity": ("L", "N", "R", False, 0.22, 0.22, 0), "header-injection": ("L", "N", "N", False, 0.22, 0.22, 0),
    "nosql-injection": ("L", "N", "N", True, 0.56, 0.56, 0), "ldap-injection": ("L", "N", "N", True, 0.56, 0.22, 0), "jwt-bypass": ("L", "N", "N", True, 0.56, 0.56, 0), "ssti": ("L", "N", "N", True, 0.56, 0.56, 0.56), "xxe": ("L", "N", "N", False, 0.56, 0.22, 0.22), "mass-assignment": ("L", "L", "N", False, 0.22, 0.56, 0), "redos": ("L", "N", "N", False, 0, 0, 0.56),
}
DEFAULT_PROFILE = ("L", "N", "N", False, 0.22, 0.22, 0)
REACHED = {"unreachable": 0.30, "reachable": 0.65, "tainted-path": 1.00, "entry-point": 1.15}
GUARDED = r"\b(?:authenticate|authorize|verifyToken|checkAuth|requireAuth|isAuthenticated|passport\.authenticate|jwt\.verify|session\.user)\b"
LIMITED = r"\b(?:rateLimit|throttle|rateLimiter|rate_limit|checkRateLimit)\b"


def base_score(profile) -> float:
    """The base score of a vector from the network, to one place."""
    complexity, privileges, interaction, changed, *loss = profile
    kept = 1.0
    for x in loss:
        kept *= 1 - x
    lost = 1 - kept
    impact = 7.52 * (lost - 0.029) - 3.25 * (lost - 0.02) ** 15 if changed else 6.42 * lost
    if impact <= 0:
        return 0.0
    ease = 8.22 * 0.85 * AC[complexity] * PR[privileges] * UI[interaction]
    return int(min(10.0, (1.08 if changed else 1.0) * (impact + ease)) * 10 + 0.5) / 10


@query("settings_merged", "SELECT c_custkey, map_extract_value(MAP {'theme': 'light', 'rows': '10', 'beta': 'off'}, k) AS base, k AS name, CASE k WHEN 'rows' THEN (c_custkey % 50)::VARCHAR WHEN 'beta' THEN CASE WHEN c_custkey % 3 = 0 THEN 'on' ELSE 'off' END ELSE 'light' END AS value FROM customer, (SELECT unnest(['theme', 'rows', 'beta']) AS k)")
def settings_merged(g):
    """Defaults merged with each customer's settings; the later map wins."""
    base = {"theme": "light", "rows": "10", "beta": "off"}
    first = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])
    own = F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("rows"), (F.col("c_custkey") % 50).cast("string"), F.lit("beta"), F.lit("on"))).otherwise(F.create_map(F.lit("rows"), (F.col("c_custkey") % 50).cast("string")))
    merged = F.map_concat(F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys("own"), k)), F.col("own"))
    rows = g.table("customer").select("c_custkey", own.alias("own")).select("c_custkey", F.explode(merged).alias("name", "value"))
    return rows.select("c_custkey", first[F.col("name")].alias("base"), "name", "value")


@query("single_row", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey = 3")
def single_row(g):
    """The one row that a key names; more than one is an error, none an empty table."""
    from ..operators import relational

    rows = g.table("region").where("r_regionkey = 3").select("r_regionkey", "r_name")
    found = relational.single(rows)
    return g.spark.createDataFrame([found] if found else [], rows.schema)


# What each role may do; rights that a role does not name are absent, not refused.
RIGHTS = "can_attest_critical can_attest_high can_attest_medium can_resolve_violations can_manage_incidents can_view_secrets can_export_data can_manage_policies can_manage_team can_manage_integrations can_view_audit_log can_trigger_scans can_create_reports can_manage_billing".split()
ROLE_RIGHTS = {
    "platform_admin": {"all": True},
    "admin": dict.fromkeys(RIGHTS, True),
    "security_reviewer": {k: k not in ("can_export_data", "can_manage_policies", "can_manage_team") for k in RIGHTS if k not in ("can_manage_integrations", "can_manage_billing")},
    "developer": {"can_attest_critical": False, "can_attest_high": False, "can_attest_medium": True, "can_resolve_violations": False, "can_view_secrets": False, "can_view_audit_log": False, "can_trigger_scans": True, "can_create_reports": False},
    "auditor": {"can_attest_critical": False, "can_attest_high": False, "can_view_secrets": True, "can_export_data": True, "can_view_audit_log": True, "can_create_reports": True, "can_trigger_scans": False},
}
_ROLES = [*ROLE_RIGHTS, "guest"]


def user_rights(role, custom):
    """The rights of a role as a map, with a custom role's map over them (the later wins); unknown roles have none."""
    base = F.create_map().cast("map<string,boolean>")
    for name, rights in ROLE_RIGHTS.items():
        base = F.when(role == name, F.create_map(*[F.lit(x) for kv in rights.items() for x in kv])).otherwise(base)
    own = F.coalesce(custom, F.create_map().cast("map<string,boolean>"))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)


def check_permission(rights, right):
    """Whether a map of rights allows one: ``all`` allows every one, an absent one is refused."""
    return F.coalesce(F.try_element_at(rights, F.lit("all")), F.lit(False)) | F.coalesce(F.try_element_at(rights, right), F.lit(False))


_GRANTED = ", ".join(f"('{r}', '{k}', {str(v).lower()})" for r, rights in ROLE_RIGHTS.items() for k, v in rights.items())


@query("permission_checks", f"""WITH g(role, name, ok) AS (VALUES {_GRANTED}), m AS (SELECT c_custkey, [{', '.join(repr(r) for r in _ROLES)}][(c_custkey % {len(_ROLES)})::INT + 1] AS role FROM customer), r AS (SELECT unnest([{', '.join(repr(k) for k in RIGHTS)}]) AS name)
    SELECT c_custkey, r.name AS permission, coalesce(EXISTS (SELECT 1 FROM g WHERE g.role = m.role AND g.name = 'all'), false) OR CASE WHEN c_custkey % 9 = 0 AND r.name = 'can_export_data' THEN true WHEN c_custkey % 9 = 0 AND r.name = 'can_attest_medium' THEN false ELSE coalesce(g.ok, false) END AS allowed FROM m CROSS JOIN r LEFT JOIN g ON g.role = m.role AND g.name = r.name""")
def permission_checks(g):
    """Every right of every member, by role and custom role."""
    k = F.col("c_custkey")
    role = F.element_at(F.array(*[F.lit(r) for r in _ROLES]), (k % len(_ROLES) + 1).cast("int"))
    custom = F.when(k % 9 == 0, F.create_map(F.lit("can_export_data"), F.lit(True), F.lit("can_attest_medium"), F.lit(False)))
    rows = g.table("customer").select(k, user_rights(role, custom).alias("rights"))
    rows = rows.select("c_custkey", "rights", F.explode(F.array(*[F.lit(r) for r in RIGHTS])).alias("permission"))
    return rows.select("c_custkey", "permission", check_permission(F.col("rights"), F.col("permission")).alias("allowed"))


@query("scan_increment", """WITH c AS (SELECT scan_id, repo, file_path, created_at, sha256(file_path || ':' || line_count || ':' || max_q::INT) AS h FROM scan_files), s AS (SELECT *, lag(h) OVER (PARTITION BY repo, file_path ORDER BY created_at, scan_id) AS before FROM c)
    SELECT scan_id, count(*) AS files, count(*) FILTER (before = h) AS skipped FROM s GROUP BY 1""")
def scan_increment(g):
    """Files of each scan, and those an incremental scan skips as their last version has the same content."""
    hashed = g.scan_files.select("scan_id", "repo", "file_path", "created_at", F.sha2(F.concat_ws(":", "file_path", "line_count", F.col("max_q").cast("int")), 256).alias("h"))
    before = F.lag("h").over(Window.partitionBy("repo", "file_path").orderBy("created_at", "scan_id"))
    return hashed.withColumn("before", before).groupBy("scan_id").agg(F.count("*").alias("files"), F.count_if(F.col("before") == F.col("h")).alias("skipped"))


#: Metrics of the three frameworks' reports: label, value, whole (or null) and status, over what an organisation's dashboard holds.
_STATUS = lambda good, warn=None: f"CASE WHEN {good} THEN 'good' WHEN {warn or 'true'} THEN 'warn' ELSE 'bad' END"
_ATT, _AI, _RISKY = "floor(attestation_rate * 100 + 0.5)", "round(overall_ai_pct * 100, 1)", "crit + high"
REPORTS = [
    ("SOC2", "Attestation Rate", _ATT, "NULL", _STATUS(f"{_ATT} >= 80", f"{_ATT} >= 60")),
    ("SOC2", "Unattested Deploys", "unattested_count", "breach_critical + breach_high", _STATUS("unattested_count = 0")),
    ("SOC2", "Critical Files", "crit", "NULL", _STATUS("crit = 0", "crit <= 2")),
    ("SOC2", "Scans Completed", "scan_count", "file_count", "'info'"),
    ("EU AI Act", "Avg AI Content", _AI, "NULL", _STATUS("overall_ai_pct < 0.4", "overall_ai_pct < 0.7")),
    ("EU AI Act", "High-Risk Systems", "machine_repos", "NULL", _STATUS("machine_repos = 0")),
    ("EU AI Act", "Oversight Coverage", _ATT, "NULL", _STATUS(f"{_ATT} >= 70", f"{_ATT} >= 50")),
    ("EU AI Act", "Provenance Complete", "tracked_signed", "tracked", _STATUS(f"{_RISKY} = 0")),
    ("PCI-DSS", "Dual-Review Rate", _ATT, "NULL", _STATUS(f"{_ATT} >= 90", f"{_ATT} >= 70")),
    ("PCI-DSS", "Repos in Scope", "repos", "NULL", "'info'"),
    ("PCI-DSS", "AI-Flagged Changes", _RISKY, "NULL", _STATUS("crit = 0", "crit <= 2")),
    ("PCI-DSS", "SoD Compliance", f"CASE WHEN {_RISKY} = 0 THEN 1 ELSE 0 END", "NULL", _STATUS(f"{_RISKY} = 0")),
]
_BOARD = f"""b AS ({registry.sql('dashboard_totals')}), tf AS (SELECT org_id, count(*) FILTER (risk = 'CRITICAL' AND NOT attested) AS crit, count(*) FILTER (risk = 'HIGH' AND NOT attested) AS high, count(*) AS tracked, count(*) FILTER (attested) AS tracked_signed FROM top_files GROUP BY 1),
    rp AS (SELECT org_id, count(*) AS repos, count(*) FILTER (round(ai_pct, 9) > 0.5) AS machine_repos FROM repo_stats GROUP BY 1), d AS (SELECT * FROM b JOIN rp USING (org_id) JOIN tf USING (org_id))"""


@query("framework_report", f"WITH {_BOARD} " + " UNION ALL ".join(f"SELECT org_id, '{f}' AS framework, '{n}' AS label, ({v})::DOUBLE AS value, ({w})::DOUBLE AS whole, {s} AS status FROM d" for f, n, v, w, s in REPORTS))
def framework_report(g):
    """The four metrics of each of three frameworks' reports, with their status."""
    from .governance import dashboard_totals

    g = g.settle()
    n = F.count_if
    files = top_files(g).groupBy("org_id").agg(n((F.col("risk") == "CRITICAL") & ~F.col("attested")).alias("crit"), n((F.col("risk") == "HIGH") & ~F.col("attested")).alias("high"), F.count("*").alias("tracked"), n("attested").alias("tracked_signed"))
    repos = repo_stats(g).groupBy("org_id").agg(F.count("*").alias("repos"), n(F.round("ai_pct", 9) > 0.5).alias("machine_repos"))
    rows = dashboard_totals(g).join(repos, "org_id").join(files, "org_id")
    metrics = F.array(*[F.struct(F.lit(f).alias("framework"), F.lit(n).alias("label"), F.expr(f"double({v})").alias("value"), F.expr(f"double({w})").alias("whole"), F.expr(s).alias("status")) for f, n, v, w, s in REPORTS])
    return rows.select("org_id", F.inline(metrics))


@query("framework_bars", "SELECT org_id, label, n AS count, round(n * 100 / sum(n) OVER (PARTITION BY org_id)::DOUBLE, 6) AS pct FROM (SELECT org_id, k AS label, count(*) FILTER (risk = k) AS n FROM top_files, (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW']) AS k) GROUP BY 1, 2)")
def framework_bars(g):
    """The bars of a report: an organisation's files by risk."""
    levels = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    rows = top_files(g).groupBy("org_id").agg(*[F.count_if(F.col("risk") == k).alias(k) for k in levels])
    total = F.greatest(F.lit(1), sum((F.col(k) for k in levels), F.lit(0)))
    return rows.select("org_id", F.inline(F.array(*[F.struct(F.lit(k).alias("label"), F.col(k).alias("count"), F.round(F.col(k) * 100 / total, 6).alias("pct")) for k in levels])))


_CLASS = "CASE risk WHEN 'CRITICAL' THEN 'HIGH-RISK' WHEN 'HIGH' THEN 'LIMITED' WHEN 'MEDIUM' THEN 'MINIMAL' ELSE 'EXEMPT' END"


@query("framework_rows", f"""SELECT org_id, scan_id, file_path, split_part(file_path, '/', -1) AS file, split_part(repo, '/', -1) AS repo, '#' || pr_number AS pr, round(ai * 100, 1) AS ai_pct, risk, coalesce(attested_by::VARCHAR, '—') AS reviewer, coalesce(strftime(attested_at, '%Y-%m-%d'), '—') AS attested_at,
    CASE WHEN attested THEN 'ATTESTED' ELSE 'PENDING' END AS soc2_status, {_CLASS} AS classification, CASE WHEN attested THEN 'Reviewed' ELSE 'REQUIRED' END AS oversight, CASE WHEN attested THEN 'Complete' ELSE 'Incomplete' END AS provenance, CASE WHEN attested THEN 'YES' ELSE 'PENDING' END AS cleared FROM top_files""")
def framework_rows(g):
    """The rows of the three frameworks' reports: one for each file of a latest scan, with the columns of all three."""
    word = lambda yes, no: F.when(F.col("attested"), yes).otherwise(no)
    return top_files(g).select(
        "org_id", "scan_id", "file_path", F.substring_index("file_path", "/", -1).alias("file"), F.substring_index("repo", "/", -1).alias("repo"), F.concat(F.lit("#"), "pr_number").alias("pr"), F.round(F.col("ai") * 100, 1).alias("ai_pct"), "risk",
        F.coalesce(F.col("attested_by").cast("string"), F.lit("—")).alias("reviewer"), F.coalesce(F.date_format("attested_at", "yyyy-MM-dd"), F.lit("—")).alias("attested_at"),
        word("ATTESTED", "PENDING").alias("soc2_status"), F.expr(_CLASS).alias("classification"), word("Reviewed", "REQUIRED").alias("oversight"), word("Complete", "Incomplete").alias("provenance"), word("YES", "PENDING").alias("cleared"),
    )


_SCAN_FILES = f"""nb AS ({registry.sql('nb_score')}), att AS ({registry.sql('attribution_posterior')}), k AS ({registry.sql('code_risks')}), f AS (SELECT doc_id, path, doc_id // 7 AS scan_id, len(string_split(text, chr(10))) AS lines, lang = '' AS skip FROM ({_FILES})),
    a AS (SELECT scan_id, path, lines, skip, probability AS ai, model, att.confidence, nb.confidence AS quality, lines > 20 AND NOT skip AS scorable FROM f JOIN nb USING (doc_id) JOIN att USING (path)),
    m AS (SELECT scan_id, max(n) AS top FROM (SELECT scan_id, model, count(*) AS n FROM a WHERE confidence >= 0.40 AND model NOT IN ('human', 'unknown') GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT scan_id, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS md, count(*) FILTER (severity = 'low') AS l FROM f JOIN k USING (path) GROUP BY 1),
    t AS (SELECT scan_id, list(kind ORDER BY n DESC, kind)[1:3] AS kinds FROM (SELECT scan_id, kind, count(*) AS n FROM f JOIN k USING (path) GROUP BY 1, 2) GROUP BY 1),
    r AS (SELECT scan_id, count(*) AS files, count(*) FILTER (scorable) AS scorable, sum(ai * lines) / sum(lines) AS mean, {', '.join(f'round(quantile_cont(ai, {p / 100}) FILTER (scorable), 8) AS p{p}' for p in rollup.PERCENTILES)}, count(*) FILTER (scorable AND ai > 0.65) AS hi, count(*) FILTER (scorable AND ai < 0.25) AS lo, coalesce(avg(quality) FILTER (scorable), 0) AS q, count(*) FILTER (scorable AND quality >= 0.70) AS sure FROM a GROUP BY 1)"""


@query("scan_report", f"""WITH {_SCAN_FILES} SELECT scan_id, files, scorable, round(CASE WHEN boosted THEN least(1, mean + 0.05) ELSE mean END, 6) AS ai, boosted, files >= 4 AND hi >= 2 AND lo >= 2 AND hi + lo >= scorable * 0.70 AS mixed, p10, p25, p50, p75, p90, round(q, 6) AS scan_quality, sure AS confident_files,
    coalesce(c, 0) AS critical_count, coalesce(h, 0) AS high_count, coalesce(md, 0) AS medium_count, coalesce(l, 0) AS low_count, coalesce(c + h + md + l, 0) AS findings, array_to_string(coalesce(kinds, []), ',') AS top_kinds, coalesce(c + h, 0) > 0 AS immediate
    FROM (SELECT r.*, files >= 3 AND coalesce(top, 0) >= ceil(files * 0.60) AS boosted, c, h, md, l, kinds FROM r LEFT JOIN m USING (scan_id) LEFT JOIN s USING (scan_id) LEFT JOIN t USING (scan_id))""")
def scan_report(g):
    """One row a scan of seven files: weighted share with the boost of one dominant model, percentiles, mixture, findings by severity, most frequent kinds."""
    from . import code

    files = code_files(g)
    scans = files.select("doc_id", "path", F.expr("doc_id div 7").alias("scan_id"), F.size(F.split("content", "\n")).alias("lines"), (F.col("lang") == "").alias("skip"))
    scored = code.nb_score(g).select("doc_id", F.col("probability").alias("ai"), F.col("confidence").alias("quality"))
    # Written once: three aggregates read it, and a filter pushed into the models' expressions would repeat them without end.
    rows = stored(scans.join(scored, "doc_id").join(code.attribution_posterior(g).select("path", "model", "confidence"), "path"), "scan-report")
    out = rollup.rollup(rows, code_risks(g).join(scans.select("path", "scan_id"), "path"))
    return out.withColumn("top_kinds", F.array_join("top_kinds", ",")).select(*[F.round(c, 8 if c[0] == "p" else 6).alias(c) if c in ("ai", "scan_quality", *(f"p{p}" for p in rollup.PERCENTILES)) else c for c in out.columns])


_TREE = tree_sql(f"SELECT user_id % 5 AS org_id, event_id AS id, sha256({_ENTRY}) AS h, 1 AS n FROM events")
_DOCUMENT = """'{"org_id":' || org_id || ',"event_count":' || n || ',"chain_valid":' || valid || CASE WHEN broken IS NULL THEN '' ELSE ',"broken_at":' || broken END || ',"root":"' || h || '"}'"""


@query("signed_export", f"""WITH {_TREE}, v AS (SELECT user_id % 5 AS org_id, count(*) FILTER (event_id % 997 = 5) = 0 AS valid, min(event_id) FILTER (event_id % 997 = 5) AS broken FROM events GROUP BY 1)
    SELECT org_id, rows, root, chain_valid, broken_at, document, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || document::BLOB))) AS signature FROM (SELECT org_id, n AS rows, h AS root, valid AS chain_valid, broken AS broken_at, {_DOCUMENT} AS document FROM t{signed.LEVELS} JOIN v USING (org_id))""")
def signed_export(g):
    """The signed export of each organisation's audit events: root of their digests, verdict on the actors' chains, document, signature."""
    rows = g.table("events").select("event_id", "user_id", F.concat_ws("|", "event_type", "props").alias("payload"))
    stored_chain = chained(rows, "user_id", "event_id", "payload").withColumn("payload", F.when(F.col("event_id") % 997 == 5, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    chains = verify_chain(stored_chain, "user_id", "event_id", "payload").withColumn("org_id", F.col("user_id") % 5)
    texts = g.table("events").select((F.col("user_id") % 5).alias("org_id"), "event_id", audit_entry().alias("text"))
    return signed.signed_documents(texts, chains, "org_id", "event_id", "text", _HMAC_KEY)
