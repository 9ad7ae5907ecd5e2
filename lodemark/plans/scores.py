"""Scores: trust, health, posture, risk, readiness, debt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, grade, half_up, hours_between, ratio
from ..sources.governance import AS_OF, Governance
from .governance import current_violations, repo_stats, top_files, weekly
from .registry import query

_NOW = f"TIMESTAMP '{AS_OF}'"


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


def org_facts(g: Governance) -> DataFrame:
    """One row for each organisation: what most scores are functions of."""
    g = g.settle()
    repos = repo_stats(g).groupBy("org_id").agg(
        F.avg("attestation_rate").alias("att"), F.stddev_pop("attestation_rate").alias("att_sd"), F.min("attestation_rate").alias("att_min"), F.stddev_pop("ai_pct").alias("ai_sd"),
        F.avg(_freshness(F.col("last_scan"))).alias("fresh"), F.sum("scan_count").alias("scans"), F.sum("file_count").alias("files"),
    )
    ai = g.scans_plain.groupBy("org_id").agg(F.avg("ai").alias("ai"))
    risky = top_files(g).where(F.col("risk").isin("CRITICAL", "HIGH")).groupBy("org_id").agg(F.count("*").alias("risky"), F.count_if("attested").alias("risky_signed"), F.count_distinct(F.when(~F.col("attested"), F.col("repo"))).alias("blocked"))
    return repos.join(ai, "org_id").join(risky, "org_id", "left").fillna(0, ["risky", "risky_signed", "blocked"])


def _freshness(last):
    age = hours_between(last, now())
    return F.when(age <= 24, 1.0).when(age <= 72, 0.7).when(age <= 168, 0.4).otherwise(0.1)


_AGE = f"epoch({_NOW} - last_scan) / 3600.0"
_FACTS = f"""facts AS (SELECT r.*, ai, coalesce(risky, 0) AS risky, coalesce(risky_signed, 0) AS risky_signed, coalesce(blocked, 0) AS blocked FROM (
    SELECT org_id, avg(attestation_rate) AS att, stddev_pop(attestation_rate) AS att_sd, min(attestation_rate) AS att_min, stddev_pop(ai_pct) AS ai_sd,
      avg(CASE WHEN {_AGE} <= 24 THEN 1.0::DOUBLE WHEN {_AGE} <= 72 THEN 0.7::DOUBLE WHEN {_AGE} <= 168 THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END) AS fresh, CAST(sum(scan_count) AS BIGINT) AS scans, CAST(sum(file_count) AS BIGINT) AS files FROM repo_stats GROUP BY 1) r
    JOIN (SELECT org_id, avg(ai) AS ai FROM scans GROUP BY 1) USING (org_id)
    LEFT JOIN (SELECT org_id, count(*) AS risky, count(*) FILTER (attested) AS risky_signed, count(DISTINCT CASE WHEN NOT attested THEN repo END) AS blocked FROM top_files WHERE risk IN ('CRITICAL', 'HIGH') GROUP BY 1) USING (org_id))"""
_D = """dims AS (SELECT org_id, att AS d1, CASE WHEN ai <= 0.4 THEN 1.0 WHEN ai < 0.65 THEN (0.65 - ai) / (0.65 - 0.4) ELSE 0.0 END AS d2, CASE WHEN risky = 0 THEN 1.0 ELSE risky_signed / risky::DOUBLE END AS d3,
    greatest(0.0, 1 - att_sd * 2) * 0.5 + CASE WHEN att_min < 0.4 THEN att_min / 0.4 ELSE 1.0 END * 0.35 + greatest(0.0, 1 - ai_sd * 1.5) * 0.15 AS d4, fresh AS d5 FROM facts)"""


@query("trust_score", f"WITH {_FACTS}, {_D} SELECT org_id, floor((d1 * 0.30 + d2 * 0.25 + d3 * 0.20 + d4 * 0.15 + d5 * 0.10) * 1000 + 0.5)::BIGINT AS total, round(d1, 6) AS attestation, round(d2, 6) AS policy, round(d3, 6) AS critical, round(d4, 6) AS consistency, round(d5, 6) AS freshness, CASE WHEN d1 >= 0.9 THEN 'A' WHEN d1 >= 0.75 THEN 'B' WHEN d1 >= 0.6 THEN 'C' WHEN d1 >= 0.45 THEN 'D' ELSE 'F' END AS attestation_grade FROM dims")
def trust_score(g):
    """0 to 1000 from five dimensions of .30, .25, .20, .15 and .10."""
    ai, low = F.col("ai"), F.col("att_min")
    d2 = F.when(ai <= 0.4, 1.0).when(ai < 0.65, (0.65 - ai) / (F.lit(0.65) - 0.4)).otherwise(0.0)
    d4 = F.greatest(F.lit(0.0), 1 - F.col("att_sd") * 2) * 0.5 + F.when(low < 0.4, low / 0.4).otherwise(1.0) * 0.35 + F.greatest(F.lit(0.0), 1 - F.col("ai_sd") * 1.5) * 0.15
    dims = org_facts(g).select("org_id", F.col("att").alias("d1"), d2.alias("d2"), ratio(F.col("risky_signed"), F.col("risky"), 1.0).alias("d3"), d4.alias("d4"), F.col("fresh").alias("d5"))
    total = sum((F.col(f"d{i + 1}") * w for i, w in enumerate([0.30, 0.25, 0.20, 0.15, 0.10])), F.lit(0.0))
    named = [F.round(f"d{i + 1}", 6).alias(n) for i, n in enumerate(["attestation", "policy", "critical", "consistency", "freshness"])]
    return dims.select("org_id", half_up(total * 1000).alias("total"), *named, grade(F.col("d1")).alias("attestation_grade"))


@query("health_score", f"WITH {_FACTS} SELECT org_id, round(60 * att + 25 * (1 - least(ai, 1)) + greatest(0, 15 - 3 * n), 6) AS health FROM facts JOIN (SELECT org_id, count(v.scan_id) AS n FROM (SELECT DISTINCT org_id FROM scans) LEFT JOIN (SELECT * FROM current_violations WHERE risk IN ('CRITICAL', 'HIGH')) v USING (org_id) GROUP BY 1) USING (org_id)")
def health_score(g):
    """60 for attestation, 25 for little AI, 15 less 3 for each unsigned risky file."""
    bad = current_violations(g).where(F.col("risk").isin("CRITICAL", "HIGH")).groupBy("org_id").agg(F.count("*").alias("n"))
    rows = org_facts(g).join(bad, "org_id", "left").fillna(0, ["n"])
    score = F.col("att") * 60 + (1 - F.least("ai", F.lit(1.0))) * 25 + F.greatest(F.lit(0), 15 - F.col("n") * 3)
    return rows.select("org_id", F.round(score, 6).alias("health"))


@query("repo_security_score", f"SELECT repo, round(40 * attestation_rate + 30 * (1 - ai_pct) + greatest(0.0, 15 - 0.5 * floor(epoch({_NOW} - last_scan) / 86400)) + CASE WHEN scan_count >= 100 THEN 15 WHEN scan_count >= 20 THEN 7.5 ELSE 0 END, 6) AS score FROM repo_stats")
def repo_security_score(g):
    days = F.floor(hours_between(F.col("last_scan"), now()) / 24)
    n = F.col("scan_count")
    score = F.col("attestation_rate") * 40 + (1 - F.col("ai_pct")) * 30 + F.greatest(F.lit(0.0), 15 - days * 0.5) + F.when(n >= 100, 15.0).when(n >= 20, 7.5).otherwise(0.0)
    return repo_stats(g).select("repo", F.round(score, 6).alias("score"))


@query("repo_risk_rank", "SELECT *, CASE WHEN score >= 60 THEN 'critical' WHEN score >= 40 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS band FROM (SELECT org_id, repo, round(40 * ai_pct + 40 * (1 - attestation_rate) + 20 * greatest(0.0, 1 - scan_count / 20.0::DOUBLE), 6) AS score FROM repo_stats)")
def repo_risk_rank(g):
    score = F.col("ai_pct") * 40 + (1 - F.col("attestation_rate")) * 40 + F.greatest(F.lit(0.0), 1 - F.col("scan_count") / 20.0) * 20
    s = F.col("score")
    return repo_stats(g).select("org_id", "repo", F.round(score, 6).alias("score")).withColumn("band", F.when(s >= 60, "critical").when(s >= 40, "high").when(s >= 25, "medium").otherwise("low"))


_W = "CASE risk WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"


@query("weighted_coverage", f"SELECT org_id, round(sum({_W}) FILTER (attested) / sum({_W})::DOUBLE, 8) AS coverage FROM top_files GROUP BY 1")
def weighted_coverage(g):
    """Share of sign-offs, a critical file counting four times a low one."""
    risk = F.col("risk")
    w = F.when(risk == "CRITICAL", 4).when(risk == "HIGH", 3).when(risk == "MEDIUM", 2).otherwise(1)
    return top_files(g).groupBy("org_id").agg(F.round(F.sum(F.when(F.col("attested"), w)) / F.sum(w), 8).alias("coverage"))


@query("burn_down", f"WITH {_FACTS} SELECT org_id, ceil((risky - risky_signed) / greatest(0.3::DOUBLE, risky_signed / 30.0::DOUBLE))::BIGINT AS days FROM facts")
def burn_down(g):
    """Days until all risky files are signed, at the pace of the last 30 days, 0.3 a day at least."""
    pace = F.greatest(F.lit(0.3), F.col("risky_signed") / 30.0)
    return org_facts(g).select("org_id", F.ceil((F.col("risky") - F.col("risky_signed")) / pace).alias("days"))


@query("posture", f"""WITH {_FACTS}, t AS (SELECT org_id, critical_count + high_count AS ch, lead(critical_count + high_count) OVER (PARTITION BY org_id ORDER BY week DESC) AS prev, row_number() OVER (PARTITION BY org_id ORDER BY week DESC) AS k FROM weekly),
    v AS (SELECT org_id, count(*) FILTER (status = 'resolved') AS done FROM violations GROUP BY 1),
    p AS (SELECT org_id, greatest(0.0, least(100.0, 100 - (risky - risky_signed) * 0.5::DOUBLE)) AS ai_risk, att * 100 AS attestation,
      greatest(0.0, least(100.0, greatest(0.0, least(100.0, CASE WHEN prev > 0 THEN 65 + (prev - ch)::DOUBLE / prev * 100 * 0.5 ELSE 65.0 END)) + least(15, done * 2))) AS response FROM facts JOIN t USING (org_id) JOIN v USING (org_id) WHERE k = 1)
    SELECT org_id, round(ai_risk, 6) AS ai_risk, round(attestation, 6) AS attestation, round(response, 6) AS response, floor(ai_risk * 0.25 + attestation * 0.2 + 80 * 0.2::DOUBLE + 70 * 0.15::DOUBLE + 75 * 0.1::DOUBLE + response * 0.1 + 0.5)::BIGINT AS overall FROM p""")
def posture(g):
    """Six weighted domains; secrets, compliance and dependencies take given values as inputs."""
    order = Window.partitionBy("org_id").orderBy(F.desc("week"))
    ch = F.col("critical_count") + F.col("high_count")
    trend = weekly(g).select("org_id", ch.alias("ch"), F.lead(ch).over(order).alias("prev"), F.row_number().over(order).alias("k")).where("k = 1")
    done = g.violations.groupBy("org_id").agg(F.count_if(F.col("status") == "resolved").alias("done"))
    rows = org_facts(g).join(trend, "org_id").join(done, "org_id")
    ai = clamp(100 - (F.col("risky") - F.col("risky_signed")) * 0.5)
    change = F.when(F.col("prev") > 0, F.lit(65.0) + (F.col("prev") - F.col("ch")) / F.col("prev") * 100 * 0.5).otherwise(65.0)
    response = clamp(clamp(change) + F.least(F.lit(15), F.col("done") * 2))
    rows = rows.select("org_id", ai.alias("ai_risk"), (F.col("att") * 100).alias("attestation"), response.alias("response"))
    total = F.col("ai_risk") * 0.25 + F.col("attestation") * 0.2 + F.lit(80) * 0.2 + F.lit(70) * 0.15 + F.lit(75) * 0.1 + F.col("response") * 0.1
    return rows.select("org_id", F.round("ai_risk", 6).alias("ai_risk"), F.round("attestation", 6).alias("attestation"), F.round("response", 6).alias("response"), half_up(total).alias("overall"))


@query("derived_violations", f"""WITH {_FACTS}
    SELECT org_id, CASE risk WHEN 'CRITICAL' THEN 'unattested_critical' WHEN 'HIGH' THEN 'unattested_high' ELSE 'unattested_medium' END AS kind, CASE risk WHEN 'CRITICAL' THEN 'crit::' WHEN 'HIGH' THEN 'high::' ELSE 'med::' END || scan_id || '::' || file_path AS id, repo, CASE risk WHEN 'CRITICAL' THEN 24 WHEN 'HIGH' THEN 48 ELSE 168 END AS sla_hours FROM top_files WHERE NOT attested AND risk <> 'LOW'
    UNION ALL SELECT org_id, 'deploy_blocked', 'deploy::blocked', NULL, 24 FROM facts WHERE blocked > 0
    UNION ALL SELECT org_id, 'ai_threshold', 'ai-thresh::' || repo, repo, NULL FROM repo_stats WHERE ai_pct > 0.8
    UNION ALL SELECT org_id, 'no_reviewer', 'low-attest::' || repo, repo, NULL FROM repo_stats WHERE attestation_rate < 0.6 AND scan_count > 0""")
def derived_violations(g):
    """Six rules over the hub: unsigned files by risk, blocked deploys, AI limit, low coverage."""
    g = g.settle()
    files = top_files(g).where("not attested and risk <> 'LOW'")
    risk = F.col("risk")
    pick = lambda a, b, c: F.when(risk == "CRITICAL", a).when(risk == "HIGH", b).otherwise(c)
    out = files.select("org_id", pick("unattested_critical", "unattested_high", "unattested_medium").alias("kind"), F.concat_ws("::", pick("crit", "high", "med"), "scan_id", "file_path").alias("id"), "repo", pick(24, 48, 168).alias("sla_hours"))
    none = F.lit(None)
    blocked = org_facts(g).where("blocked > 0").select("org_id", F.lit("deploy_blocked").alias("kind"), F.lit("deploy::blocked").alias("id"), none.cast("string").alias("repo"), F.lit(24).alias("sla_hours"))
    repos = repo_stats(g)
    row = lambda kind, mark: (F.lit(kind).alias("kind"), F.concat(F.lit(mark), "repo").alias("id"), "repo", none.cast("int").alias("sla_hours"))
    high = repos.where("ai_pct > 0.8").select("org_id", *row("ai_threshold", "ai-thresh::"))
    low = repos.where("attestation_rate < 0.6 and scan_count > 0").select("org_id", *row("no_reviewer", "low-attest::"))
    return out.unionByName(blocked).unionByName(high).unionByName(low)


@query("policy_gate", """SELECT scan_id, count(*) FILTER (sev IS NOT NULL) AS n, count(*) FILTER (sev IS NOT NULL) = 0 AS pass, bool_or(coalesce(sev IN ('critical', 'high'), false)) AS gated FROM (
    SELECT scan_id, CASE WHEN attested THEN NULL WHEN risk = 'CRITICAL' THEN 'critical' WHEN risk = 'HIGH' THEN 'high' WHEN ai > 0.5 AND risk NOT IN ('LOW', 'UNKNOWN') THEN 'medium' END AS sev FROM (SELECT *, has_r AS attested FROM scan_files)) GROUP BY 1""")
def policy_gate(g, ai_threshold: float = 0.5, block=("CRITICAL", "HIGH")):
    """Whether each scan passes the policy, and whether it gates the merge.

    A file has one violation at most: its risk's, else that of the AI threshold.
    """
    risk = F.col("risk")
    severity = F.when(F.col("has_r"), None)
    for name in ("CRITICAL", "HIGH", "MEDIUM"):
        if name in block:
            severity = severity.when(risk == name, name.lower())
    severity = severity.when((F.col("ai") > ai_threshold) & ~risk.isin("LOW", "UNKNOWN"), "medium")
    rows = g.scan_files.select("scan_id", severity.alias("s"))
    n = F.count("s")
    return rows.groupBy("scan_id").agg(n.alias("n"), (n == 0).alias("pass"), F.bool_or(F.coalesce(F.col("s").isin([b.lower() for b in block]), F.lit(False))).alias("gated"))


_RISK_ITEMS = """items AS (SELECT org_id, repo, 5 AS l, 5 AS i FROM top_files WHERE risk = 'CRITICAL' AND NOT attested GROUP BY 1, 2 UNION ALL SELECT org_id, repo, 4, 4 FROM top_files WHERE risk = 'HIGH' AND NOT attested GROUP BY 1, 2
    UNION ALL SELECT org_id, repo, 3, 3 FROM repo_stats WHERE attestation_rate < 0.6 UNION ALL SELECT org_id, repo, 3, 2 FROM repo_stats WHERE ai_pct > 0.5)"""


def risk_items(g) -> DataFrame:
    """Derived risks of each repository, with likelihood l and impact i."""
    files, repos = top_files(g).where("not attested"), repo_stats(g)
    item = lambda rows, l, i: rows.select("org_id", "repo", F.lit(l).alias("l"), F.lit(i).alias("i"))  # noqa: E731, E741
    of = lambda r: files.where(F.col("risk") == r).select("org_id", "repo").distinct()
    return item(of("CRITICAL"), 5, 5).unionByName(item(of("HIGH"), 4, 4)).unionByName(item(repos.where("attestation_rate < 0.6"), 3, 3)).unionByName(item(repos.where("ai_pct > 0.5"), 3, 2))


@query("risk_register", f"WITH {_RISK_ITEMS} SELECT org_id, repo, count(*) AS risks, max(l * i) AS worst, CASE WHEN max(l * i) >= 20 THEN 'critical' WHEN max(l * i) >= 12 THEN 'high' WHEN max(l * i) >= 6 THEN 'medium' ELSE 'low' END AS band FROM items GROUP BY 1, 2")
def risk_register(g):
    w = F.max(F.col("l") * F.col("i"))
    return risk_items(g).groupBy("org_id", "repo").agg(F.count("*").alias("risks"), w.alias("worst"), F.when(w >= 20, "critical").when(w >= 12, "high").when(w >= 6, "medium").otherwise("low").alias("band"))


@query("risk_heatmap", f"WITH {_RISK_ITEMS} SELECT l AS likelihood, " + ", ".join(f"count(*) FILTER (i = {k}) AS impact_{k}" for k in range(1, 6)) + " FROM items GROUP BY 1")
def risk_heatmap(g):
    """Likelihood by impact, a column for each impact."""
    return risk_items(g).groupBy(F.col("l").alias("likelihood")).agg(*[F.count_if(F.col("i") == k).alias(f"impact_{k}") for k in range(1, 6)])


@query("sla_buckets", f"SELECT org_id, count(*) FILTER (h > 0) AS overdue, count(*) FILTER (h > -24 AND h <= 0) AS due_today, count(*) FILTER (h <= -24) AS on_track, round(100.0 * count(*) FILTER (h <= 0) / count(*), 6) AS compliance_pct, round(coalesce(avg(h) FILTER (h > 0), 0), 6) AS avg_overdue FROM (SELECT org_id, epoch({_NOW} - sla_deadline) / 3600.0 AS h FROM current_violations) GROUP BY 1")
def sla_buckets(g):
    rows = current_violations(g).select("org_id", hours_between(F.col("sla_deadline"), now()).alias("h"))
    h = F.col("h")
    return rows.groupBy("org_id").agg(
        F.count_if(h > 0).alias("overdue"), F.count_if((h > -24) & (h <= 0)).alias("due_today"), F.count_if(h <= -24).alias("on_track"),
        F.round(ratio(F.count_if(h <= 0), F.count("*")) * 100, 6).alias("compliance_pct"), F.round(F.coalesce(F.avg(F.when(h > 0, h)), F.lit(0.0)), 6).alias("avg_overdue"),
    )


@query("soc2_evidence", """WITH c AS (SELECT org_id, n_scans, coalesce(n_att, 0) AS n_att, coalesce(n_open, 0) AS n_open, coalesce(n_res, 0) AS n_res FROM (SELECT org_id, count(*) AS n_scans FROM scans GROUP BY 1) LEFT JOIN (SELECT org_id, count(*) AS n_att FROM attestations GROUP BY 1) USING (org_id)
      LEFT JOIN (SELECT org_id, count(*) FILTER (status = 'open') AS n_open, count(*) FILTER (status = 'resolved') AS n_res FROM violations GROUP BY 1) USING (org_id))
    SELECT org_id, 'CC6.1' AS control, CASE WHEN n_att > 0 THEN 'pass' ELSE 'partial' END AS status, CASE WHEN n_att > 0 THEN 100 ELSE 50 END AS score FROM c
    UNION ALL SELECT org_id, 'CC7.2', CASE WHEN n_scans > 0 THEN 'pass' ELSE 'fail' END, CASE WHEN n_scans > 10 THEN 100 WHEN n_scans > 0 THEN 80 ELSE 0 END FROM c
    UNION ALL SELECT org_id, 'CC8.1', CASE WHEN n_res > 0 AND n_open = 0 THEN 'pass' WHEN n_open > 5 THEN 'partial' ELSE 'pass' END, least(100, 100 - least(50, n_open * 5)) FROM c""")
def soc2_evidence(g):
    """Controls with their status and score; five open violations still pass change control."""
    from .governance import evidence_counts

    opened = g.violations.groupBy("org_id").agg(F.count_if(F.col("status") == "open").alias("n_strict"))
    c = evidence_counts(g).join(opened, "org_id", "left").fillna(0)
    n, o = F.col("n_scans"), F.col("n_strict")
    control = lambda name, status, score: c.select("org_id", F.lit(name).alias("control"), status.alias("status"), score.cast("long").alias("score"))
    out = control("CC6.1", F.when(F.col("n_att") > 0, "pass").otherwise("partial"), F.when(F.col("n_att") > 0, 100).otherwise(50))
    out = out.unionByName(control("CC7.2", F.when(n > 0, "pass").otherwise("fail"), F.when(n > 10, 100).when(n > 0, 80).otherwise(0)))
    change = F.when((F.col("n_resolved") > 0) & (o == 0), "pass").when(o > 5, "partial").otherwise("pass")
    return out.unionByName(control("CC8.1", change, F.least(F.lit(100), 100 - F.least(F.lit(50), o * 5))))


#: Controls of each framework: weight, and the score from coverage (att, in per cent), scans and files.
FRAMEWORKS = {
    "soc2": [(25, "least(100, att * 1.1)"), (20, "case when scans > 0 then 95 else 20 end"), (20, "case when scans > 10 then 100 else scans * 8 end"), (20, "least(100, att)"), (15, "case when files > 100 then 100 else files end")],
    "euai": [(25, "least(100, att * 0.9)"), (20, "case when files > 0 then 100 else 0 end"), (20, "case when scans > 0 then 100 else 0 end"), (20, "least(100, att)"), (15, "case when scans > 0 then 100 else 0 end")],
    "pcidss": [(25, "case when scans > 0 then least(100, 70 + att * 0.3) else 10 end"), (20, "case when files > 0 then 100 else 0 end"), (20, "case when blocked = 0 then 100 else greatest(20, 80 - blocked * 10) end"), (20, "least(100, att * 0.95)"), (15, "case when scans > 0 then 90 else 20 end")],
    "iso27001": [(25, "case when scans > 10 then 100 else scans * 8 end"), (20, "least(100, 60 + att * 0.4)"), (20, "least(100, att)"), (20, "case when files > 0 then 100 else 0 end"), (15, "case when scans > 0 then 100 else 0 end")],
}
_DOUBLE = {k: " + ".join(f"{w} * cast({e} as double) / 100" for w, e in v) for k, v in FRAMEWORKS.items()}


@query("framework_readiness", f"WITH {_FACTS}, s AS (SELECT org_id, att * 100 AS att, scans, files, blocked FROM facts) " + " UNION ALL ".join(f"SELECT org_id, '{k}' AS framework, floor(({e}) / {sum(w for w, _ in FRAMEWORKS[k])} * 100 + 0.5)::BIGINT AS readiness, ceil(greatest(0, 90 - floor(({e}) / {sum(w for w, _ in FRAMEWORKS[k])} * 100 + 0.5)) * 1.8::DOUBLE)::BIGINT AS days_to_ready FROM s" for k, e in _DOUBLE.items()))
def framework_readiness(g):
    facts = org_facts(g).select("org_id", (F.col("att") * 100).alias("att"), "scans", "files", "blocked")
    each = F.array(*[F.struct(F.lit(k).alias("framework"), half_up(F.expr(f"({e}) / {sum(w for w, _ in FRAMEWORKS[k])} * 100")).alias("readiness")) for k, e in _DOUBLE.items()])
    rows = facts.select("org_id", F.explode(each).alias("x")).select("org_id", "x.*")
    return rows.withColumn("days_to_ready", F.ceil(F.greatest(F.lit(0), 90 - F.col("readiness")) * 1.8))


@query("ai_bom", "SELECT repo, count(*) AS files, count(*) FILTER (ai > 0.5) AS mostly_ai, round(avg(ai), 8) AS avg_ai, count(*) FILTER (risk IN ('CRITICAL', 'HIGH')) AS risky FROM top_files GROUP BY 1")
def ai_bom(g):
    return top_files(g).groupBy("repo").agg(F.count("*").alias("files"), F.count_if(F.col("ai") > 0.5).alias("mostly_ai"), F.round(F.avg("ai"), 8).alias("avg_ai"), F.count_if(F.col("risk").isin("CRITICAL", "HIGH")).alias("risky"))


_M = "CASE risk WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 2 ELSE 1 END"


@query("ai_debt", f"SELECT org_id, round(sum(floor(80 * ai + 20 + 0.5) * epoch({_NOW} - s.created_at) / 3600.0 * {_M}), 4) AS debt, CAST(sum(floor(80 * ai + 20 + 0.5) * {_M}) AS BIGINT) AS hourly FROM (SELECT t.*, x.created_at FROM top_files t JOIN (SELECT id, created_at FROM scans) x ON t.scan_id = x.id) s WHERE NOT attested GROUP BY 1")
def ai_debt(g):
    """Cost of unsigned files: a rate by AI share times the hours since the scan and the risk."""
    risk = F.col("risk")
    m = F.when(risk == "CRITICAL", 10).when(risk == "HIGH", 4).when(risk == "MEDIUM", 2).otherwise(1)
    cost = half_up(F.col("ai") * 80 + 20)
    rows = top_files(g).where("not attested").join(g.scans_plain.select(F.col("id").alias("scan_id"), "created_at"), "scan_id")
    return rows.groupBy("org_id").agg(F.round(F.sum(cost * hours_between(F.col("created_at"), now()) * m), 4).alias("debt"), F.sum(cost * m).alias("hourly"))


#: Monthly limits by plan; -1 is unlimited.
PLANS = {0: ("free", 100), 1: ("team", 1000), 2: ("team", 1000), 3: ("business", 5000), 4: ("enterprise", -1)}


@query("usage_pct", "WITH plans(org_id, plan, max_scans) AS (VALUES " + ", ".join(f"({k}, '{p}', {n})" for k, (p, n) in PLANS.items()) + ") SELECT org_id, plan, n AS used, CASE WHEN max_scans < 0 THEN NULL ELSE floor(least(100.0, 100.0 * n / max_scans) + 0.5)::BIGINT END AS pct, coalesce(max_scans > 0 AND 100.0 * n / max_scans >= 80, false) AS warn FROM (SELECT org_id, count(*) AS n FROM scans WHERE created_at >= TIMESTAMP '2001-07-01' AND created_at < TIMESTAMP '2001-08-01' GROUP BY 1) JOIN plans USING (org_id)")
def usage_pct(g):
    """Scans of the month against the plan's limit."""
    plans = g.spark.createDataFrame([(k, p, n) for k, (p, n) in PLANS.items()], "org_id int, plan string, max_scans int")
    month = g.scans_plain.where("created_at >= timestamp_ntz'2001-07-01' and created_at < timestamp_ntz'2001-08-01'").groupBy("org_id").agg(F.count("*").alias("used"))
    share = F.col("used") * 100.0 / F.nullif(F.col("max_scans"), F.lit(0))
    pct = F.when(F.col("max_scans") >= 0, half_up(F.least(F.lit(100.0), share)))
    return month.join(F.broadcast(plans), "org_id").select("org_id", "plan", "used", pct.alias("pct"), ((F.col("max_scans") > 0) & (share >= 80)).alias("warn"))


@query("mttr", "SELECT org_id, risk, round(avg(epoch(resolved_at - created_at) / 3600.0), 6) AS mttr_hours, count(*) AS resolved FROM violations WHERE status = 'resolved' GROUP BY 1, 2")
def mttr(g):
    return g.violations.where("status = 'resolved'").groupBy("org_id", "risk").agg(F.round(F.avg(hours_between(F.col("created_at"), F.col("resolved_at"))), 6).alias("mttr_hours"), F.count("*").alias("resolved"))


@query("pattern_groups", "SELECT org_id, risk, ai_band, n FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY n DESC, risk, ai_band) AS k FROM (SELECT org_id, risk, floor(ai * 10 + 0.5) / 10 AS ai_band, count(*) AS n FROM top_files WHERE NOT attested GROUP BY 1, 2, 3 HAVING count(*) >= 2)) WHERE k <= 3")
def pattern_groups(g):
    """Unsigned files of equal risk and AI band: the three largest groups of each organisation."""
    groups = top_files(g).where("not attested").groupBy("org_id", "risk", (half_up(F.col("ai") * 10) / 10).alias("ai_band")).agg(F.count("*").alias("n")).where("n >= 2")
    order = Window.partitionBy("org_id").orderBy(F.desc("n"), "risk", "ai_band")
    return groups.withColumn("k", F.row_number().over(order)).where("k <= 3").drop("k")


@query("review_capacity", "SELECT org_id, ceil(n / 4.0 * ai * 2)::BIGINT AS incoming, done AS resolved, greatest(0, ceil(n / 4.0 * ai * 2)::BIGINT - done) AS gap FROM (SELECT org_id, count(*) AS n, avg(ai) AS ai FROM scans WHERE created_at >= TIMESTAMP '2001-07-04' GROUP BY 1) JOIN (SELECT org_id, count(*) FILTER (resolved_at >= TIMESTAMP '2001-07-25') AS done FROM violations GROUP BY 1) USING (org_id)")
def review_capacity(g):
    scans = g.scans_plain.where("created_at >= timestamp_ntz'2001-07-04'").groupBy("org_id").agg(F.ceil(F.count("*") / 4.0 * F.avg("ai") * 2).alias("incoming"))
    done = g.violations.groupBy("org_id").agg(F.count_if(F.col("resolved_at") >= F.lit("2001-07-25").cast("timestamp_ntz")).alias("resolved"))
    return scans.join(done, "org_id").withColumn("gap", F.greatest(F.lit(0), F.col("incoming") - F.col("resolved")))


@query("indicator_mix", "SELECT org_id, indicator, round(100.0 * n / sum(n) OVER (PARTITION BY org_id), 6) AS share FROM (SELECT org_id, unnest(indicators) AS indicator, count(*) AS n FROM top_files GROUP BY 1, 2)")
def indicator_mix(g):
    counts = top_files(g).select("org_id", F.explode("indicators").alias("indicator")).groupBy("org_id", "indicator").agg(F.count("*").alias("n"))
    return counts.select("org_id", "indicator", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("org_id")), 6).alias("share"))


@query("stale_repos", f"SELECT org_id, min_by(repo, (last_scan, repo)) AS oldest_repo, count(*) FILTER (last_scan < {_NOW} - INTERVAL 7 DAY) AS stale, count(*) FILTER (attestation_rate < 0.5) AS low_coverage FROM repo_stats GROUP BY 1")
def stale_repos(g):
    old = F.col("last_scan") < now() - F.expr("interval 7 days")
    return repo_stats(g).groupBy("org_id").agg(F.min_by("repo", F.struct("last_scan", "repo")).alias("oldest_repo"), F.count_if(old).alias("stale"), F.count_if(F.col("attestation_rate") < 0.5).alias("low_coverage"))


@query("ai_projection", "SELECT org_id, round(least(1.0, avg_now + (avg_now - avg_before)), 8) AS in_30_days, round(least(1.0, avg_now + 2 * (avg_now - avg_before)), 8) AS in_60_days FROM (SELECT org_id, avg(ai) FILTER (created_at >= TIMESTAMP '2001-07-03') AS avg_now, avg(ai) FILTER (created_at < TIMESTAMP '2001-07-03') AS avg_before FROM scans WHERE created_at >= TIMESTAMP '2001-06-03' GROUP BY 1)")
def ai_projection(g):
    """AI share in 30 and 60 days if the last month's change goes on."""
    late = F.col("created_at") >= F.lit("2001-07-03").cast("timestamp_ntz")
    rows = g.scans_plain.where("created_at >= timestamp_ntz'2001-06-03'").groupBy("org_id").agg(F.avg(F.when(late, F.col("ai"))).alias("a"), F.avg(F.when(~late, F.col("ai"))).alias("b"))
    step = lambda n: F.round(F.least(F.lit(1.0), F.col("a") + (F.col("a") - F.col("b")) * n), 8)
    return rows.select("org_id", step(1).alias("in_30_days"), step(2).alias("in_60_days"))
