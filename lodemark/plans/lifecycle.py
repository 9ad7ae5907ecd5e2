"""Writes and states: alerts, retention, paging, flags, rights, notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio, role_rank, rolling_hash
from ..operators import relational as R
from ..sources.governance import AS_OF
from .governance import current_violations, latest_violations, repo_stats
from .registry import query

_NOW = f"TIMESTAMP '{AS_OF}'"


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query("audit_page", "SELECT event_id, user_id, event_type, ts, (SELECT count(*) FROM events WHERE event_type = 'error') AS total FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 50 OFFSET 100")
def audit_page(g, number: int = 2, size: int = 50):
    """One page of the audit log, newest first, with the total (a paging query)."""
    rows = g.table("events").where("event_type = 'error'")
    page = R.page(rows.select("event_id", "user_id", "event_type", "ts"), [F.desc("event_id")], number, size)
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


@query("retention_keep", f"SELECT id, created_at FROM scans WHERE created_at >= {_NOW} - INTERVAL 365 DAY")
def retention_keep(g, days: int = 365):
    """Scans that stay after a delete by age; a cutoff of under seven days is refused."""
    if days < 7:
        raise ValueError("a retention of under 7 days is refused")
    return g.scans_plain.where(F.col("created_at") >= now() - F.make_dt_interval(days=F.lit(days))).select("id", "created_at")


@query("retention_counts", f"SELECT 'scans' AS table_name, count(*) FILTER (created_at < {_NOW} - INTERVAL 365 DAY) AS deleted, count(*) AS total FROM scans UNION ALL SELECT 'audit_log', count(*) FILTER (ts < TIMESTAMP '2031-01-01' - INTERVAL 2555 DAY), count(*) FROM events")
def retention_counts(g):
    scans = g.scans_plain.agg(F.lit("scans").alias("table_name"), F.count_if(F.col("created_at") < now() - F.expr("interval 365 days")).alias("deleted"), F.count("*").alias("total"))
    log = g.table("events").agg(F.lit("audit_log").alias("table_name"), F.count_if(F.col("ts") < F.lit("2031-01-01").cast("timestamp_ntz") - F.expr("interval 2555 days")).alias("deleted"), F.count("*").alias("total"))
    return scans.unionByName(log)


@query("sla_alerts", f"SELECT org_id, scan_id, count(*) AS files, CASE WHEN bool_or(risk = 'CRITICAL') THEN 'P1' ELSE 'P2' END AS severity FROM current_violations WHERE sla_deadline < {_NOW} AND scan_id % 5 <> 0 GROUP BY 1, 2")
def sla_alerts(g, open_alerts: DataFrame | None = None):
    """An alert for each scan with breaches, unless one is open (by default: every fifth scan's).

    The scans with open alerts are a table, so the test for one is an anti-join.
    """
    late = current_violations(g).where(F.col("sla_deadline") < now())
    rows = late.groupBy("org_id", "scan_id").agg(F.count("*").alias("files"), F.when(F.bool_or(F.col("risk") == "CRITICAL"), "P1").otherwise("P2").alias("severity"))
    if open_alerts is None:
        open_alerts = g.scans_plain.where("id % 5 = 0").select(F.col("id").alias("scan_id"))
    return rows.join(open_alerts, "scan_id", "left_anti").select("org_id", "scan_id", "files", "severity")


@query("alert_self_heal", "SELECT repo, CASE WHEN bool_or(status IN ('open', 'in_review')) THEN 'firing' ELSE 'resolved' END AS alert_status FROM latest_violations GROUP BY 1")
def alert_self_heal(g):
    """Alerts of repositories without an open latest violation resolve themselves."""
    return latest_violations(g).groupBy("repo").agg(F.when(F.bool_or(F.col("status").isin("open", "in_review")), "firing").otherwise("resolved").alias("alert_status"))


@query("alert_lifecycle", "SELECT event_id, CASE WHEN value >= 15 THEN 'resolved' WHEN value >= 8 THEN CASE WHEN ts + floor(value)::BIGINT * INTERVAL 1 HOUR <= TIMESTAMP '2024-01-10' THEN 'firing' ELSE 'snoozed' END WHEN value >= 4 THEN 'acknowledged' ELSE 'firing' END AS state FROM events WHERE event_type = 'error'")
def alert_lifecycle(g, at: str = "2024-01-10"):
    """States of alerts; a snooze that has run out fires again."""
    value = F.col("value")
    until = F.col("ts") + F.make_dt_interval(hours=F.floor(value).cast("int"))
    state = F.when(value >= 15, "resolved").when((value >= 8) & (until <= F.lit(at).cast("timestamp_ntz")), "firing").when(value >= 8, "snoozed").when(value >= 4, "acknowledged").otherwise("firing")
    return g.table("events").where("event_type = 'error'").select("event_id", state.alias("state"))


@query("webhook_retries", "SELECT event_id FROM events WHERE event_type = 'error' AND value >= 4 AND ts < TIMESTAMP '2024-01-05' - INTERVAL 5 MINUTE")
def webhook_retries(g, at: str = "2024-01-05"):
    """Deliveries to try again: enabled, failed, and last tried over five minutes ago."""
    return g.table("events").where((F.col("event_type") == "error") & (F.col("value") >= 4) & (F.col("ts") < F.lit(at).cast("timestamp_ntz") - F.expr("interval 5 minutes"))).select("event_id")


@query("due_schedules", f"SELECT repo, last_run FROM (SELECT repo, max(created_at) AS last_run FROM scans GROUP BY 1) WHERE last_run < {_NOW} - INTERVAL 23 HOUR ORDER BY last_run, repo LIMIT 20")
def due_schedules(g):
    """Repositories to scan again: never run or over 23 hours ago, 20 at a time."""
    last = g.scans_plain.groupBy("repo").agg(F.max("created_at").alias("last_run"))
    return last.where(F.col("last_run").isNull() | (F.col("last_run") < now() - F.expr("interval 23 hours"))).orderBy("last_run", "repo").limit(20)


@query("feature_flags", "SELECT org_id, flag, CASE WHEN flag = 'beta' THEN org_id IN (1, 2) ELSE coalesce(list_contains(plans, plan), false) END AS enabled FROM (VALUES (0, 'free'), (1, 'team'), (2, 'team'), (3, 'business'), (4, 'enterprise')) o(org_id, plan), (VALUES ('beta', NULL, 0), ('graphs', ['team', 'business'], 100), ('export', ['enterprise'], 100)) f(flag, plans, pct)")
def feature_flags(g):
    """Flags by plan, with overrides by organisation before the hashed roll-out share."""
    orgs = g.spark.createDataFrame([(0, "free"), (1, "team"), (2, "team"), (3, "business"), (4, "enterprise")], "org_id int, plan string")
    flags = g.spark.createDataFrame([("beta", None, 0, [1, 2]), ("graphs", ["team", "business"], 100, []), ("export", ["enterprise"], 100, [])], "flag string, plans array<string>, pct int, orgs array<int>")
    return evaluate_flags(orgs, flags)


def evaluate_flags(orgs: DataFrame, flags: DataFrame) -> DataFrame:
    """(org_id, flag, enabled): the plan allows it, and an override or the hash share does.

    Both tables are configuration of a few rows; the flags are broadcast.
    """
    rows = orgs.crossJoin(F.broadcast(flags))
    allowed = F.col("plans").isNull() | F.array_contains("plans", F.col("plan"))
    share = F.pmod(rolling_hash(F.concat_ws(":", "org_id", "flag")), F.lit(100)) < F.col("pct")
    return rows.select("org_id", "flag", (allowed & (F.array_contains("orgs", F.col("org_id")) | share)).alias("enabled"))


#: What each base role may do; a custom role's entries win over these.
PERMISSIONS = {"owner": ["all"], "admin": ["read", "write", "attest", "manage"], "reviewer": ["read", "attest"], "developer": ["read", "write"], "viewer": ["read"]}
_ROLE = "CASE c_custkey % 5 WHEN 0 THEN 'owner' WHEN 1 THEN 'admin' WHEN 2 THEN 'reviewer' WHEN 3 THEN 'developer' ELSE 'viewer' END"


def member_roles(g) -> DataFrame:
    k = F.col("c_custkey") % 5
    role = F.when(k == 0, "owner").when(k == 1, "admin").when(k == 2, "reviewer").when(k == 3, "developer").otherwise("viewer")
    return g.table("customer").select("c_custkey", role.alias("role"))


@query("permissions", f"SELECT c_custkey, role, role IN ('owner', 'admin', 'reviewer') AND NOT (c_custkey % 7 = 0 AND role <> 'owner') AS can_attest, role = 'owner' OR c_custkey % 11 = 0 OR role IN ('admin', 'developer') AS can_write, CASE role WHEN 'owner' THEN 4 WHEN 'admin' THEN 3 WHEN 'reviewer' THEN 2 WHEN 'developer' THEN 1 ELSE 0 END >= 2 AS reviewer_up FROM (SELECT c_custkey, {_ROLE} AS role FROM customer)")
def permissions(g):
    """Rights of each member: the base role's, with a custom role's map over it; ``all`` is all."""
    roles = member_roles(g)
    base = g.spark.createDataFrame([(r, p) for r, p in PERMISSIONS.items()], "role string, granted array<string>")
    custom = roles.where("c_custkey % 7 = 0 or c_custkey % 11 = 0").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, False).alias("attest"), F.when(F.col("c_custkey") % 11 == 0, True).alias("write"))
    rows = roles.join(F.broadcast(base), "role", "left").join(custom, "c_custkey", "left")
    has = lambda p: F.array_contains("granted", "all") | F.coalesce(F.col(p), F.array_contains("granted", p))
    return rows.select("c_custkey", "role", has("attest").alias("can_attest"), has("write").alias("can_write"), (role_rank(F.col("role")) >= 2).alias("reviewer_up"))


@query("api_key_gate", "SELECT c_custkey, NOT revoked AND (expires IS NULL OR expires > 500) AND (len(ips) = 0 OR list_contains(ips, '10.0.0.' || c_custkey % 3)) AS allowed FROM (SELECT c_custkey, c_custkey % 13 = 0 AS revoked, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 1000 END AS expires, CASE WHEN c_custkey % 2 = 0 THEN ['10.0.0.1', '10.0.0.2'] ELSE [] END AS ips FROM customer)")
def api_key_gate(g):
    """Keys found by their hash pass unless revoked, expired or used from another address."""
    k = F.col("c_custkey")
    keys = g.table("customer").select(F.sha2(k.cast("string"), 256).alias("hash"), (k % 13 == 0).alias("revoked"), F.when(k % 4 == 0, k % 1000).alias("expires"), F.when(k % 2 == 0, F.array(F.lit("10.0.0.1"), F.lit("10.0.0.2"))).otherwise(F.array().cast("array<string>")).alias("ips"))
    calls = g.table("customer").select(k, F.sha2(k.cast("string"), 256).alias("hash"), F.concat(F.lit("10.0.0."), k % 3).alias("ip"))
    rows = calls.join(keys, "hash", "left")
    good = ~F.col("revoked") & (F.col("expires").isNull() | (F.col("expires") > 500)) & ((F.size("ips") == 0) | F.array_contains("ips", F.col("ip")))
    return rows.select("c_custkey", F.coalesce(good, F.lit(False)).alias("allowed"))


@query("shared_org_members", "SELECT c_custkey FROM customer SEMI JOIN (SELECT n2.n_nationkey FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey WHERE n1.n_nationkey = 3) v ON c_nationkey = v.n_nationkey")
def shared_org_members(g, own: int = 3):
    """Members that share an organisation with one's own: a semi-join on a self-join."""
    n = g.table("nation")
    region = n.where(F.col("n_nationkey") == own).select("n_regionkey")
    visible = n.join(region, "n_regionkey", "left_semi").select(F.col("n_nationkey").alias("c_nationkey"))
    return g.table("customer").join(visible, "c_nationkey", "left_semi").select("c_custkey")


@query("attest_insert_once", "SELECT scan_id, file_path, 'old' AS origin FROM attestations UNION ALL SELECT scan_id, file_path, 'new' FROM scan_files f WHERE risk = 'CRITICAL' AND NOT EXISTS (SELECT 1 FROM attestations a WHERE a.scan_id = f.scan_id AND a.file_path = f.file_path)")
def attest_insert_once(g):
    """The sign-offs after one more round over all critical files; none is there twice."""
    have = g.attestations.select("scan_id", "file_path", F.lit("old").alias("origin"))
    more = g.scan_files.where("risk = 'CRITICAL'").select("scan_id", "file_path", F.lit("new").alias("origin"))
    return R.insert_once(have, more, ["scan_id", "file_path"])


@query("upsert_repositories", "SELECT repo, max_by(id, (created_at, id)) AS last_id, max(created_at) AS updated_at FROM scans GROUP BY 1")
def upsert_repositories(g):
    """Repositories after an upsert of the year 2001's rows into those before it."""
    rows = g.scans_plain.select("repo", F.col("id").alias("last_id"), F.col("created_at").alias("updated_at"))
    year = F.col("updated_at") >= F.lit("2001-01-01").cast("timestamp_ntz")
    old, new = (R.latest_per_key(x, ["repo"], "updated_at", "last_id") for x in (rows.where(~year), rows.where(year)))
    return R.upsert(old, new, ["repo"]).select("repo", "last_id", "updated_at")


@query("conditional_update", "SELECT scan_id, file_path, CASE WHEN status = 'open' AND risk = 'MEDIUM' AND created_at < TIMESTAMP '1999-01-01' THEN 'accepted' ELSE status END AS status FROM violations")
def conditional_update(g):
    """An update under a predicate, as a rewrite."""
    hit = (F.col("status") == "open") & (F.col("risk") == "MEDIUM") & (F.col("created_at") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return g.violations.select("scan_id", "file_path", F.when(hit, "accepted").otherwise(F.col("status")).alias("status"))


@query("payload_match", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE props LIKE '%\"k\": 6%'")
def payload_match(g):
    """Audit rows whose payload, as text, holds a fragment; the key is read from the JSON."""
    return g.table("events").where(F.col("props").like('%"k": 6%')).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("notification_diff", """WITH before AS (SELECT repo, avg(ai) AS ai FROM scans WHERE created_at < TIMESTAMP '2001-07-01' GROUP BY 1), after AS (SELECT repo, avg(ai) AS ai FROM scans WHERE created_at >= TIMESTAMP '2001-07-01' GROUP BY 1)
    SELECT repo, CASE WHEN before.repo IS NULL THEN 'new_repo' WHEN after.ai > before.ai THEN 'ai_up' ELSE 'ai_down' END AS event, round(after.ai - before.ai, 8) AS change FROM after LEFT JOIN before USING (repo) WHERE before.repo IS NULL OR abs(after.ai - before.ai) >= 0.1""")
def notification_diff(g):
    """Events between two snapshots: new repositories and AI moves of ten points or more."""
    cut = F.col("created_at") < F.lit("2001-07-01").cast("timestamp_ntz")
    rows = g.scans_plain.groupBy("repo").agg(F.avg(F.when(cut, F.col("ai"))).alias("a"), F.avg(F.when(~cut, F.col("ai"))).alias("b")).where("b is not null")
    event = F.when(F.col("a").isNull(), "new_repo").when(F.col("b") > F.col("a"), "ai_up").otherwise("ai_down")
    return rows.where("a is null or abs(b - a) >= 0.1").select("repo", event.alias("event"), F.round(F.col("b") - F.col("a"), 8).alias("change"))


@query("weekly_digest", "SELECT org_id, n AS scans, coalesce(opened, 0) AS opened, coalesce(signed, 0) AS signed FROM (SELECT org_id, count(*) AS n FROM scans WHERE created_at >= TIMESTAMP '2001-07-26' GROUP BY 1) LEFT JOIN (SELECT org_id, count(*) FILTER (risk <> 'LOW') AS opened, count(*) FILTER (has_r) AS signed FROM scan_files WHERE created_at >= TIMESTAMP '2001-07-26' GROUP BY 1) USING (org_id)")
def weekly_digest(g):
    scans = g.scans_plain.where("created_at >= timestamp_ntz'2001-07-26'").groupBy("org_id").agg(F.count("*").alias("scans"))
    files = g.scan_files.where("created_at >= timestamp_ntz'2001-07-26'").groupBy("org_id").agg(F.count_if(F.col("risk") != "LOW").alias("opened"), F.count_if("has_r").alias("signed"))
    return scans.join(files, "org_id", "left").fillna(0)


@query("shadow_tools", "SELECT brand AS tool, brand IN ('Brand#1', 'Brand#2', 'Brand#3') AS allowed, count(*) AS uses, count(DISTINCT pr_author) AS developers FROM scan_files GROUP BY 1")
def shadow_tools(g, allowed=("Brand#1", "Brand#2", "Brand#3")):
    """Tools in use, split by an allow-list, with their uses and developers."""
    return g.scan_files.groupBy(F.col("brand").alias("tool")).agg(F.first(F.col("brand").isin(*allowed)).alias("allowed"), F.count("*").alias("uses"), F.count_distinct("pr_author").alias("developers"))


@query("threat_relevance", "SELECT org_id, threat, greatest(10, least(100, base + 15 * len(list_intersect(langs, seen)) + CASE WHEN len(list_intersect(langs, seen)) = 0 THEN -35 ELSE 0 END))::BIGINT AS relevance FROM (VALUES ('deserialization', ['ECONOMY', 'STANDARD'], 60), ('typosquat', ['PROMO'], 50), ('legacy', ['OBSOLETE'], 70)) t(threat, langs, base), (SELECT org_id, list(DISTINCT indicator) AS seen FROM (SELECT org_id, unnest(indicators) AS indicator FROM scan_files) GROUP BY 1)")
def threat_relevance(g):
    """Threats scored by the overlap of their languages with those an organisation uses."""
    threats = g.spark.createDataFrame([("deserialization", ["ECONOMY", "STANDARD"], 60), ("typosquat", ["PROMO"], 50), ("legacy", ["OBSOLETE"], 70)], "threat string, langs array<string>, base int")
    seen = g.scan_files.select("org_id", F.explode("indicators").alias("x")).groupBy("org_id").agg(F.collect_set("x").alias("seen"))
    rows = seen.crossJoin(F.broadcast(threats))
    both = F.size(F.array_intersect("langs", "seen"))
    score = F.col("base") + both * 15 + F.when(both == 0, -35).otherwise(0)
    return rows.select("org_id", "threat", F.greatest(F.lit(10), F.least(F.lit(100), score)).cast("long").alias("relevance"))


@query("evidence_gaps", "SELECT org_id, repo, round(1 - attestation_rate, 8) AS gap, row_number() OVER (PARTITION BY org_id ORDER BY attestation_rate < 0.2 DESC, last_scan, scan_count DESC, repo) AS place FROM repo_stats WHERE attestation_rate < 0.6")
def evidence_gaps(g):
    """Repositories short of evidence: expired first, then the oldest, then the heaviest."""
    rows = repo_stats(g).where("attestation_rate < 0.6")
    order = Window.partitionBy("org_id").orderBy(F.desc(F.col("attestation_rate") < 0.2), "last_scan", F.desc("scan_count"), "repo")
    return rows.select("org_id", "repo", F.round(1 - F.col("attestation_rate"), 8).alias("gap"), F.row_number().over(order).cast("long").alias("place"))


@query("admin_totals", "SELECT count(*) AS scans, count(DISTINCT org_id) FILTER (created_at >= TIMESTAMP '2001-07-03') AS active_orgs, count(DISTINCT repo) AS repos FROM scans")
def admin_totals(g):
    recent = F.col("created_at") >= F.lit("2001-07-03").cast("timestamp_ntz")
    return g.scans_plain.agg(F.count("*").alias("scans"), F.count_distinct(F.when(recent, F.col("org_id"))).alias("active_orgs"), F.count_distinct("repo").alias("repos"))


@query("connection_stats", "SELECT event_type AS state, count(*) AS n, count(*) FILTER (value > 10) AS slow, round(100.0 * count(*) / (SELECT count(*) FROM events), 6) AS pct FROM events GROUP BY 1")
def connection_stats(g):
    """Counts by state with a filtered aggregate and the share of a scalar total."""
    rows = g.table("events").groupBy(F.col("event_type").alias("state")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 10).alias("slow"))
    total = Window.partitionBy(F.lit(0))
    return rows.withColumn("pct", F.round(ratio(F.col("n") * 100.0, F.sum("n").over(total)), 6))
