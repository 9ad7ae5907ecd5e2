"""The hub: latest states, repository statistics, risk trend, breaches, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio, risk_rank
from ..operators import relational as R
from ..sources.governance import AS_OF, Governance
from .registry import query


def latest_scans(g: Governance, plain: bool = True) -> DataFrame:
    return R.latest_per_key(g.scans_plain if plain else g.scans, ["repo"], "created_at", "id")


def latest_violations(g: Governance) -> DataFrame:
    return R.latest_per_key(g.dealt().violations, ["repo", "file_path"], "created_at", "scan_id")


def current_violations(g: Governance) -> DataFrame:
    """Latest violations that are open or in review, of files attested in no scan of the repository."""
    rows = latest_violations(g).where(F.col("status").isin("open", "in_review"))
    return rows.join(g.attestations.select("repo", "file_path"), ["repo", "file_path"], "left_anti")


def top_files(g: Governance) -> DataFrame:
    """Files of each repository's latest scan, with their attestation if there is one."""
    files = g.scan_files.join(latest_scans(g).select(F.col("id").alias("scan_id")), "scan_id", "left_semi")
    signed = g.attestations.select("scan_id", "file_path", F.col("reviewer").alias("attested_by"), "attested_at")
    rows = files.select("scan_id", "repo", "org_id", "file_path", "ai", "risk", "pr_number", "line_count", "indicators").join(signed, ["scan_id", "file_path"], "left")
    return rows.withColumn("attested", F.col("attested_at").isNotNull())


def repo_stats(g: Governance) -> DataFrame:
    """Per repository: AI share, attestation rate (latest scan's sign-offs over all files), counts."""
    stats = g.scans.groupBy("org_id", "repo").agg(
        F.avg("ai").alias("ai_pct"), F.max("created_at").alias("last_scan"), F.count("*").alias("scan_count"),
        F.sum("file_count").alias("file_count"), F.max_by("id", F.struct("created_at", "id")).alias("latest_scan_id"),
    )
    signed = g.attestations.join(latest_scans(g).select(F.col("id").alias("scan_id")), "scan_id", "left_semi").groupBy("repo").agg(F.count("*").alias("n"))
    rate = F.least(F.lit(1.0), ratio(F.coalesce("n", F.lit(0)), F.col("file_count"), 1.0))
    return stats.join(signed, "repo", "left").withColumn("attestation_rate", rate).drop("n")


def weekly(g: Governance) -> DataFrame:
    count = lambda r: F.count_if(F.col("overall_risk") == r)
    return g.scans_plain.groupBy("org_id", F.date_trunc("week", "created_at").cast("date").alias("week")).agg(count("CRITICAL").alias("critical_count"), count("HIGH").alias("high_count"), count("MEDIUM").alias("medium_count"))


@query("weekly_risk_trend", """SELECT org_id, week, critical_count, high_count, medium_count FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY week DESC) AS k FROM weekly) WHERE k <= 10""")
def weekly_risk_trend(g):
    """The last ten weeks (from Monday) of each organisation, by overall risk."""
    last = Window.partitionBy("org_id").orderBy(F.desc("week"))
    return weekly(g).withColumn("k", F.row_number().over(last)).where("k <= 10").drop("k")


@query("latest_scan_per_repo", "SELECT repo, id, org_id, overall_risk, ai, created_at FROM latest_scans")
def latest_scan_per_repo(g):
    return latest_scans(g).select("repo", "id", "org_id", "overall_risk", "ai", "created_at")


@query("latest_violation_per_file", "SELECT repo, file_path, scan_id, org_id, risk, status, sla_deadline FROM latest_violations")
def latest_violation_per_file(g):
    return latest_violations(g).select("repo", "file_path", "scan_id", "org_id", "risk", "status", "sla_deadline")


@query("latest_scan_per_pr", "SELECT repo, pr_number, max_by(id, (created_at, id)) AS id, max(created_at) AS created_at FROM scans GROUP BY 1, 2")
def latest_scan_per_pr(g):
    return R.latest_per_key(g.scans_plain.select("repo", "pr_number", "id", "created_at"), ["repo", "pr_number"], "created_at", "id")


@query("repo_stats", "SELECT org_id, repo, round(ai_pct, 8) AS ai_pct, round(attestation_rate, 8) AS attestation_rate, last_scan, scan_count, file_count, latest_scan_id FROM repo_stats")
def repo_stats_query(g):
    return repo_stats(g).select("org_id", "repo", F.round("ai_pct", 8).alias("ai_pct"), F.round("attestation_rate", 8).alias("attestation_rate"), "last_scan", "scan_count", "file_count", "latest_scan_id")


@query("top_risk_files", """SELECT org_id, repo, file_path, scan_id, ai, risk, attested, attested_by, attested_at FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY ai DESC, repo, file_path) AS k FROM top_files WHERE risk IN ('CRITICAL', 'HIGH')) WHERE k <= 50""")
def top_risk_files(g):
    """The 50 files of highest AI share in each organisation's latest scans (a top-k report)."""
    rows = top_files(g).where(F.col("risk").isin("CRITICAL", "HIGH"))
    order = Window.partitionBy("org_id").orderBy(F.desc("ai"), "repo", "file_path")
    return rows.withColumn("k", F.row_number().over(order)).where("k <= 50").select("org_id", "repo", "file_path", "scan_id", "ai", "risk", "attested", "attested_by", "attested_at")


@query("sla_breaches", f"SELECT org_id, repo, file_path, scan_id, risk, sla_deadline FROM current_violations WHERE sla_deadline < TIMESTAMP '{AS_OF}' AND risk IN ('CRITICAL', 'HIGH')")
def sla_breaches(g):
    rows = current_violations(g).where((F.col("sla_deadline") < F.lit(AS_OF).cast("timestamp_ntz")) & F.col("risk").isin("CRITICAL", "HIGH"))
    return rows.select("org_id", "repo", "file_path", "scan_id", "risk", "sla_deadline")


@query("dashboard_totals", f"""SELECT org_id, round(ai, 8) AS overall_ai_pct, round(att, 8) AS attestation_rate, n AS scan_count, files AS file_count, coalesce(unattested, 0) AS unattested_count, coalesce(bc, 0) AS breach_critical, coalesce(bh, 0) AS breach_high
    FROM (SELECT org_id, avg(ai) AS ai, count(*) AS n, CAST(sum(file_count) AS BIGINT) AS files FROM scans GROUP BY 1)
    JOIN (SELECT org_id, avg(attestation_rate) AS att FROM repo_stats GROUP BY 1) USING (org_id)
    LEFT JOIN (SELECT org_id, count(*) FILTER (risk IN ('CRITICAL', 'HIGH')) AS unattested, count(*) FILTER (risk = 'CRITICAL' AND sla_deadline < TIMESTAMP '{AS_OF}') AS bc,
      count(*) FILTER (risk = 'HIGH' AND sla_deadline < TIMESTAMP '{AS_OF}') AS bh FROM current_violations GROUP BY 1) USING (org_id)""")
def dashboard_totals(g):
    """The headline numbers of each organisation."""
    g = g.settle()
    late = F.col("sla_deadline") < F.lit(AS_OF).cast("timestamp_ntz")
    scans = g.scans.groupBy("org_id").agg(F.round(F.avg("ai"), 8).alias("overall_ai_pct"), F.count("*").alias("scan_count"), F.sum("file_count").alias("file_count"))
    rates = repo_stats(g).groupBy("org_id").agg(F.round(F.avg("attestation_rate"), 8).alias("attestation_rate"))
    bad = current_violations(g).groupBy("org_id").agg(
        F.count_if(F.col("risk").isin("CRITICAL", "HIGH")).alias("unattested_count"), F.count_if((F.col("risk") == "CRITICAL") & late).alias("breach_critical"), F.count_if((F.col("risk") == "HIGH") & late).alias("breach_high"),
    )
    return scans.join(rates, "org_id").join(bad, "org_id", "left").fillna(0, ["unattested_count", "breach_critical", "breach_high"])


_RANK = "CASE risk WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"


# The two last scans of each repository, and their files, each computed once and from the base tables alone.
_LAST_TWO = f"""last_two AS MATERIALIZED (SELECT id AS scan_id, repo, k FROM (SELECT o_orderkey AS id, n_name || '/' || c_mktsegment AS repo, row_number() OVER (PARTITION BY n_name, c_mktsegment ORDER BY o_orderdate DESC, o_orderkey DESC) AS k
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) WHERE k <= 2),
    own AS MATERIALIZED (SELECT scan_id, repo, k, 'src/' || replace(p_name, ' ', '_') AS file_path, max(l_quantity) AS q FROM last_two JOIN lineitem ON l_orderkey = scan_id JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4)"""
_BY_QUANTITY = "CASE WHEN q >= 46 THEN {} WHEN q >= 36 THEN {} WHEN q >= 21 THEN {} ELSE {} END"


@query("scan_diff", f"""WITH {_LAST_TWO}, sides AS (SELECT repo, file_path, max({_BY_QUANTITY.format(4, 3, 2, 1)}) FILTER (k = 2) AS one, max({_BY_QUANTITY.format(4, 3, 2, 1)}) FILTER (k = 1) AS two FROM own GROUP BY 1, 2)
    SELECT repo, file_path, CASE WHEN one IS NULL THEN 'new' WHEN two IS NULL THEN 'resolved' WHEN two > one THEN 'worsened' WHEN two < one THEN 'improved' ELSE 'unchanged' END AS change FROM sides""")
def scan_diff(g):
    """How the files of each repository changed between its last two scans."""
    order = Window.partitionBy("repo").orderBy(F.desc("created_at"), F.desc("id"))
    ranked = g.scans_plain.withColumn("k", F.row_number().over(order)).where("k <= 2").select(F.col("id").alias("scan_id"), "k")
    files = g.scan_files.join(ranked, "scan_id").select("k", F.struct("repo", "file_path").alias("key"), risk_rank(F.col("risk")).alias("rank"))
    return R.snapshot_diff(files.where("k = 2"), files.where("k = 1"), "key", "rank").select("key.repo", "key.file_path", "change")


@query("scan_list_enriched", """SELECT s.id, s.repo, s.pr_number, s.overall_risk, s.file_count, CASE WHEN l.id IS NOT NULL THEN coalesce(a.n, 0) END AS attested, CASE WHEN l.id IS NOT NULL THEN coalesce(h.n, 0) END AS high_critical
    FROM scans s LEFT JOIN (SELECT max_by(id, (created_at, id)) AS id FROM scans GROUP BY repo, pr_number) l ON s.id = l.id
    LEFT JOIN (SELECT scan_id, count(*) AS n FROM attestations GROUP BY 1) a ON s.id = a.scan_id LEFT JOIN (SELECT scan_id, count(*) AS n FROM scan_files WHERE risk IN ('CRITICAL', 'HIGH') GROUP BY 1) h ON s.id = h.scan_id""")
def scan_list_enriched(g):
    """All scans; sign-offs and risky files are counted only for the latest of each pull request."""
    latest = R.latest_per_key(g.scans_plain.select("repo", "pr_number", "id", "created_at"), ["repo", "pr_number"], "created_at", "id").select("id", F.lit(True).alias("is_latest"))
    counts = g.scan_files.groupBy(F.col("scan_id").alias("id")).agg(F.count("*").alias("file_count"), F.count_if("has_r").alias("n_a"), F.count_if(F.col("risk").isin("CRITICAL", "HIGH")).alias("n_h"))
    rows = g.scans_plain.join(counts, "id", "left").join(latest, "id", "left")
    only = lambda c: F.when(F.col("is_latest"), F.coalesce(c, F.lit(0)))
    return rows.select("id", "repo", "pr_number", "overall_risk", F.coalesce("file_count", F.lit(0)).alias("file_count"), only("n_a").alias("attested"), only("n_h").alias("high_critical"))


@query("scan_role_scope", "SELECT id, repo, pr_author FROM scans WHERE pr_author = 'Customer#000000007'")
def scan_role_scope(g, role: str = "developer", login: str | None = "Customer#000000007"):
    """A developer with a known login sees their own scans; all others see every scan."""
    rows = g.scans_plain.select("id", "repo", "pr_author")
    return rows.where(F.col("pr_author") == login) if role == "developer" and login else rows


_HASH = "sha256(file_path || ':' || line_count || ':' || max_q::INT)"


@query("inherit_attestation_cross_pr", f"""SELECT scan_id, file_path, source_scan FROM (SELECT n.scan_id, n.file_path, o.scan_id AS source_scan, row_number() OVER (PARTITION BY n.scan_id, n.file_path ORDER BY o.attested_at, o.scan_id) AS k
    FROM (SELECT *, {_HASH} AS h FROM scan_files WHERE NOT has_r) n JOIN (SELECT f.org_id, f.file_path, f.scan_id, f.pr_number, {_HASH.replace("line_count", "f.line_count").replace("file_path", "f.file_path")} AS h, a.attested_at FROM scan_files f JOIN attestations a ON f.scan_id = a.scan_id AND f.file_path = a.file_path) o
    ON n.org_id = o.org_id AND n.file_path = o.file_path AND n.h = o.h AND n.scan_id <> o.scan_id) WHERE k = 1""")
def inherit_attestation_cross_pr(g):
    """Unsigned files take the earliest sign-off of a file of equal path and content in the organisation.

    One sign-off for each (organisation, path, content) is found first, so the join has one
    match for each file. A scan never matches itself, as unsigned files have no sign-off.
    """
    hashed = g.scan_files.withColumn("h", F.sha2(F.concat_ws(":", "file_path", "line_count", F.col("max_q").cast("int")), 256))
    signed = hashed.where("has_r").withColumn("attested_at", F.col("created_at") + F.make_dt_interval(hours=(F.col("r_line") * 5).cast("int")))
    first = signed.groupBy("org_id", "file_path", "h").agg(F.min_by("scan_id", F.struct("attested_at", "scan_id")).alias("source_scan"))
    return hashed.where("not has_r").join(first, ["org_id", "file_path", "h"]).select("scan_id", "file_path", "source_scan")


@query("inherit_attestation_within_pr", """SELECT scan_id, file_path, source_scan FROM (SELECT n.scan_id, n.file_path, o.scan_id AS source_scan, row_number() OVER (PARTITION BY n.scan_id, n.file_path ORDER BY o.created_at DESC, o.scan_id DESC) AS k
    FROM (SELECT * FROM scan_files WHERE NOT has_r) n JOIN (SELECT * FROM scan_files WHERE has_r) o ON n.repo = o.repo AND n.pr_number = o.pr_number AND n.file_path = o.file_path AND (o.created_at, o.scan_id) < (n.created_at, n.scan_id)) WHERE k = 1""")
def inherit_attestation_within_pr(g):
    """Unsigned files take the newest earlier sign-off of their path in the same pull request.

    An as-of lookup: one ordered window over the pull request's versions of the path.
    """
    before = Window.partitionBy("repo", "pr_number", "file_path").orderBy("created_at", "scan_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = g.scan_files.withColumn("source_scan", F.last(F.when(F.col("has_r"), F.col("scan_id")), ignorenulls=True).over(before))
    return rows.where("not has_r and source_scan is not null").select("scan_id", "file_path", "source_scan")


@query("delta_merge", f"""WITH {_LAST_TWO}, newest AS (SELECT *, min(k) OVER (PARTITION BY repo, file_path) AS first FROM own)
    SELECT repo, file_path, {_BY_QUANTITY.format("'CRITICAL'", "'HIGH'", "'MEDIUM'", "'LOW'")} AS risk, scan_id FROM newest WHERE k = first""")
def delta_merge(g):
    """The latest scan's files, and those of the scan before that it did not rescan."""
    order = Window.partitionBy("repo").orderBy(F.desc("created_at"), F.desc("id"))
    ranked = g.scans_plain.withColumn("k", F.row_number().over(order)).where("k <= 2").select(F.col("id").alias("scan_id"), "k")
    files = g.scan_files.join(ranked, "scan_id").select("repo", "file_path", "risk", "scan_id", "k")
    return R.delta_merge(files.where("k = 2").drop("k"), files.where("k = 1").drop("k"), ["repo", "file_path"])


def search_rank(title, subtitle, text: str):
    """Prefix 100, contained 50, in the subtitle 20, as a whole word 30; the text is quoted."""
    import re

    low = text.lower()
    word = rf"\b{re.escape(low)}\b"
    points = lambda test, n: F.when(test, n).otherwise(0)
    return points(F.lower(title).startswith(low), 100) + points(F.lower(title).contains(low), 50) + points(F.lower(subtitle).contains(low), 20) + points(F.lower(title).rlike(word), 30)


_TEXT = "ring"
_SCORE = f"(CASE WHEN starts_with(lower(title), '{_TEXT}') THEN 100 ELSE 0 END + CASE WHEN contains(lower(title), '{_TEXT}') THEN 50 ELSE 0 END + CASE WHEN contains(lower(subtitle), '{_TEXT}') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(lower(title), '\\b{_TEXT}\\b') THEN 30 ELSE 0 END)"
_BRANCHES = [
    ("file", "SELECT scan_id::VARCHAR || ':' || file_path AS id, file_path AS title, repo AS subtitle, created_at FROM scan_files"),
    ("scan", "SELECT id::VARCHAR AS id, repo AS title, pr_author AS subtitle, created_at FROM scans"),
    ("violation", "SELECT scan_id::VARCHAR || ':' || file_path AS id, file_path AS title, status AS subtitle, created_at FROM violations"),
]


@query("global_search", "SELECT kind, id, title, score FROM (" + " UNION ALL ".join(f"(SELECT '{k}' AS kind, id, title, {_SCORE} AS score, created_at FROM ({s}) WHERE contains(lower(title), '{_TEXT}') OR contains(lower(subtitle), '{_TEXT}') ORDER BY score DESC, created_at DESC, id LIMIT 10)" for k, s in _BRANCHES) + ") ORDER BY score DESC, created_at DESC, kind, id LIMIT 30")
def global_search(g, text: str = _TEXT, limit: int = 30):
    """Three typed searches, each limited, their union ranked and limited again (a top-k report)."""
    branches = [
        ("file", g.scan_files.select(F.concat_ws(":", "scan_id", "file_path").alias("id"), F.col("file_path").alias("title"), F.col("repo").alias("subtitle"), "created_at")),
        ("scan", g.scans_plain.select(F.col("id").cast("string").alias("id"), F.col("repo").alias("title"), F.col("pr_author").alias("subtitle"), "created_at")),
        ("violation", g.violations.select(F.concat_ws(":", "scan_id", "file_path").alias("id"), F.col("file_path").alias("title"), F.col("status").alias("subtitle"), "created_at")),
    ]
    out = None
    for kind, rows in branches:
        rows = rows.where(F.lower("title").contains(text.lower()) | F.lower("subtitle").contains(text.lower()))
        rows = rows.select(F.lit(kind).alias("kind"), "id", "title", search_rank(F.col("title"), F.col("subtitle"), text).alias("score"), "created_at")
        rows = rows.orderBy(F.desc("score"), F.desc("created_at"), "id").limit(limit // len(branches))
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy(F.desc("score"), F.desc("created_at"), "kind", "id").limit(limit).drop("created_at")


@query("evidence_counts", """SELECT s.org_id, n_scans, n_att, n_open, n_resolved FROM (SELECT org_id, count(*) AS n_scans FROM scans GROUP BY 1) s LEFT JOIN (SELECT org_id, count(*) AS n_att FROM attestations GROUP BY 1) a USING (org_id)
    LEFT JOIN (SELECT org_id, count(*) FILTER (status IN ('open', 'in_review')) AS n_open, count(*) FILTER (status = 'resolved') AS n_resolved FROM violations GROUP BY 1) v USING (org_id)""")
def evidence_counts(g):
    """Counts that the evidence needs; those over one table are one pass."""
    scans = g.scans_plain.groupBy("org_id").agg(F.count("*").alias("n_scans"))
    files = g.scan_files.groupBy("org_id").agg(
        F.count_if("has_r").alias("n_att"), F.count_if(F.expr("risk <> 'LOW' and has_o")).alias("n_open"), F.count_if(F.expr("risk <> 'LOW' and not has_o")).alias("n_resolved"),
    )
    return scans.join(files, "org_id", "left")


@query("orgs_summary", f"""SELECT s.org_id, n_recent, open_violations, members, last_scan FROM (SELECT org_id, count(*) FILTER (created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS n_recent, max(created_at) AS last_scan, count(DISTINCT pr_author) AS members FROM scans GROUP BY 1) s
    LEFT JOIN (SELECT org_id, count(*) FILTER (status = 'open') AS open_violations FROM violations GROUP BY 1) USING (org_id)""")
def orgs_summary(g):
    recent = F.col("created_at") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 30 days")
    scans = g.scans_plain.groupBy("org_id").agg(F.count_if(recent).alias("n_recent"), F.max("created_at").alias("last_scan"), F.count_distinct("pr_author").alias("members"))
    return scans.join(g.violations.groupBy("org_id").agg(F.count_if(F.col("status") == "open").alias("open_violations")), "org_id", "left")


@query("repo_file_versions", f"SELECT repo, file_path, scan_id, risk, k AS place FROM (SELECT repo, file_path, scan_id, risk, row_number() OVER (PARTITION BY repo ORDER BY {_RANK} DESC, ai DESC, file_path) AS k FROM (SELECT *, row_number() OVER (PARTITION BY repo, file_path ORDER BY created_at DESC, scan_id DESC) AS v FROM scan_files) WHERE v = 1)")
def repo_file_versions(g):
    """The latest version of each file of a repository, in order of risk."""
    latest = R.latest_per_key(g.dealt().scan_files.select("repo", "file_path", "scan_id", "risk", "ai", "created_at"), ["repo", "file_path"], "created_at", "scan_id")
    order = Window.partitionBy("repo").orderBy(F.desc(risk_rank(F.col("risk"))), F.desc("ai"), "file_path")
    return latest.select("repo", "file_path", "scan_id", "risk", F.row_number().over(order).cast("long").alias("place"))
