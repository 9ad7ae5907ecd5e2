"""Sources and sinks as queries: exports, SARIF, manifests, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signed
from ..sources import formats
from .governance import top_files
from .registry import query

_Q = "CASE WHEN regexp_matches({0}, '[,\"\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@query("csv_export", "SELECT " + " || ',' || ".join(_Q.format(c) for c in ("scan_id::VARCHAR", "file_path", "(risk || ', ' || status)", "repo")) + " AS line FROM violations ORDER BY scan_id DESC, file_path LIMIT 10000")
def csv_export(g):
    """The violations export: quoted lines, 10,000 at most (the export's own limit)."""
    rows = g.violations.select("scan_id", "file_path", F.concat_ws(", ", "risk", "status").alias("what"), "repo")
    rows = rows.orderBy(F.desc("scan_id"), "file_path").limit(10_000)
    return rows.select(formats.csv_line("scan_id", "file_path", "what", "repo").alias("line"))


def tree_sql(first: str) -> str:
    """The digests of a signed tree in SQL, ``t0`` being ``first`` (org_id, id, h, n)."""
    levels = [f"t{k} AS (SELECT org_id, id // {signed.FAN} AS id, sha256(string_agg(h, chr(10) ORDER BY id, h)) AS h, CAST(sum(n) AS BIGINT) AS n FROM t{k - 1} GROUP BY 1, id // {signed.FAN})" for k in range(1, signed.LEVELS + 1)]
    return f"t0 AS ({first}), " + ", ".join(levels)


_EXPORTED = "SELECT org_id, scan_id AS id, sha256(scan_id || ':' || file_path) AS h, 1 AS n FROM attestations WHERE risk = 'CRITICAL' AND attested_at >= TIMESTAMP '2001-06-01'"


@query("json_export", f"WITH {tree_sql(_EXPORTED)} SELECT org_id, n AS count, h AS digest FROM t{signed.LEVELS}")
def json_export(g):
    """Size and digest of the rows of each organisation's JSON export; the digest is a tree's root, so no organisation is one task.

    :func:`formats.json_document` writes the document.
    """
    rows = g.attestations.where("risk = 'CRITICAL' and attested_at >= timestamp_ntz'2001-06-01'")
    rows = rows.select("org_id", "scan_id", F.concat_ws(":", "scan_id", "file_path").alias("text"))
    return signed.tree_root(rows, "org_id", "scan_id", "text").select("org_id", F.col("rows").alias("count"), F.col("root").alias("digest"))


@query("sarif_results", "SELECT repo, file_path, indicator AS rule, CASE WHEN risk IN ('CRITICAL', 'HIGH') THEN 'error' WHEN risk = 'MEDIUM' THEN 'warning' ELSE 'note' END AS level, greatest(1, line_count - 30)::BIGINT AS line FROM (SELECT *, unnest(indicators) AS indicator FROM top_files)")
def sarif_results(g):
    """Findings as rows of a SARIF report: level by risk, lines from 1 on."""
    rows = top_files(g).withColumn("rule", F.explode("indicators"))
    return rows.select("repo", "file_path", "rule", formats.sarif_level(F.col("risk")).alias("level"), F.greatest(F.lit(1), F.col("line_count") - 30).alias("line"))


@query("sarif_rules", "SELECT repo, list_sort(list(DISTINCT indicator)) AS rules FROM (SELECT repo, unnest(indicators) AS indicator FROM top_files) GROUP BY 1")
def sarif_rules(g):
    return top_files(g).select("repo", F.explode("indicators").alias("rule")).groupBy("repo").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


@query("compliance_report", "SELECT org_id, s.n AS scans, coalesce(v.total, 0) AS violations, coalesce(v.resolved, 0) AS resolved, coalesce(a.n, 0) AS attestations FROM (SELECT org_id, count(*) AS n FROM scans WHERE created_at BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-12-31' GROUP BY 1) s LEFT JOIN (SELECT org_id, count(*) AS total, count(*) FILTER (status = 'resolved') AS resolved FROM violations WHERE created_at BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-12-31' GROUP BY 1) v USING (org_id) LEFT JOIN (SELECT org_id, count(*) AS n FROM attestations WHERE attested_at BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-12-31' GROUP BY 1) a USING (org_id)")
def compliance_report(g, first: str = "2000-01-01", last: str = "2000-12-31"):
    """Counts over a closed interval."""
    within = lambda df, c: df.where(F.col(c).between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))
    scans = within(g.scans_plain, "created_at").groupBy("org_id").agg(F.count("*").alias("scans"))
    bad = within(g.violations, "created_at").groupBy("org_id").agg(F.count("*").alias("violations"), F.count_if(F.col("status") == "resolved").alias("resolved"))
    signed = within(g.attestations, "attested_at").groupBy("org_id").agg(F.count("*").alias("attestations"))
    return scans.join(bad, "org_id", "left").join(signed, "org_id", "left").fillna(0)


@query("scannable_files", "SELECT file_path, regexp_matches(file_path, '\\.(ts|tsx|js|jsx|py|go|java|rb|rs|cs|php|swift|kt)$') AS scannable FROM (SELECT 'src/' || doc_id || CASE lang WHEN 'en' THEN '.ts' WHEN 'de' THEN '.py' WHEN 'fr' THEN '.md' ELSE '.lock' END AS file_path FROM documents)")
def scannable_files(g):
    """Which files are scanned, by their extension."""
    ext = F.when(F.col("lang") == "en", ".ts").when(F.col("lang") == "de", ".py").when(F.col("lang") == "fr", ".md").otherwise(".lock")
    rows = g.table("documents").select(F.concat(F.lit("src/"), "doc_id", ext).alias("file_path"))
    return rows.select("file_path", formats.scannable(F.col("file_path")).alias("scannable"))


_MANIFEST = "'{\"dependencies\":{\"' || replace(p_name, ' ', '-') || '\":\"^' || p_size || '.2.' || p_partkey % 7 || '\",\"lodash\":\"4.17.' || p_partkey % 25 || '\"}}'"


@query("manifest_dependencies", "SELECT p_partkey, 'npm' AS ecosystem, unnest([replace(p_name, ' ', '-'), 'lodash']) AS name, unnest([p_size || '.2.' || p_partkey % 7, '4.17.' || p_partkey % 25]) AS version FROM part")
def manifest_dependencies(g):
    """Dependencies read from one generated package manifest for each part."""
    rows = g.table("part").selectExpr("p_partkey", f"{_MANIFEST} as content")
    return rows.select("p_partkey", F.explode(formats.npm_dependencies(F.col("content"))).alias("d")).select("p_partkey", F.lit("npm").alias("ecosystem"), "d.name", "d.version")


@query("requirements_dependencies", "SELECT p_partkey, replace(p_name, ' ', '_') AS name, p_size || '.0' AS version FROM part")
def requirements_dependencies(g):
    rows = g.table("part").selectExpr("p_partkey", "'# pinned\\n' || replace(p_name, ' ', '_') || '==' || p_size || '.0\\n\\n' as content")
    return rows.select("p_partkey", F.explode(formats.requirements(F.col("content"))).alias("d")).select("p_partkey", "d.name", "d.version")


@query("git_log", "SELECT event_id, user_id AS author, ts, event_type || ' | ' || props AS subject, value > 10 AS signed FROM events")
def git_log(g):
    """Commits parsed from log lines; a subject may hold the separator."""
    lines = g.table("events").select("event_id", F.concat_ws("|", F.sha2(F.col("event_id").cast("string"), 256), "user_id", F.concat(F.col("user_id").cast("string"), F.lit("@x")), F.unix_micros(F.col("ts").cast("timestamp")), F.when(F.col("value") > 10, "G").otherwise("N"), F.concat_ws(" | ", "event_type", "props")).alias("line"))
    c = formats.commit(F.col("line"))
    return lines.select("event_id", c["name"].cast("long").alias("author"), F.timestamp_micros(c["ts"].cast("long")).cast("timestamp_ntz").alias("ts"), c["subject"].alias("subject"), (c["gpg"] == "G").alias("signed"))


@query("sarif_document", """WITH f AS (SELECT scan_id, file_path, risk, line_count, unnest(indicators) AS id FROM top_files) SELECT scan_id AS report, to_json({'version': '2.1.0', 'runs': [{'tool': {'driver': {'name': 'lodemark', 'rules': list_sort(list(DISTINCT {'id': id, 'shortDescription': {'text': lower(id)}}))}},
    'results': list_sort(list({'ruleId': id, 'level': CASE WHEN risk IN ('CRITICAL', 'HIGH') THEN 'error' WHEN risk = 'MEDIUM' THEN 'warning' ELSE 'note' END, 'message': {'text': lower(id)}, 'locations': [{'physicalLocation': {'artifactLocation': {'uri': file_path}, 'region': {'startLine': greatest(1, line_count - 30)::BIGINT}}}]}))}]})::VARCHAR AS document FROM f GROUP BY 1""")
def sarif_document(g):
    """The 2.1.0 document of each repository's latest scan."""
    rows = top_files(g).select(F.col("scan_id").alias("report"), F.col("file_path").alias("path"), F.explode("indicators").alias("id"), F.col("risk").alias("severity"), (F.col("line_count") - 30).alias("line"))
    return formats.sarif(rows.withColumn("label", F.lower("id")))


@query("go_modules", "SELECT p_partkey, 'github.com/x/' || split_part(p_name, ' ', 2) AS name, p_size || '.2.0' AS version FROM part UNION ALL SELECT p_partkey, 'golang.org/y', '1.' || p_size || '.0-rc1' FROM part")
def go_modules(g):
    """Modules and versions of go.mod files, from blocks and single lines."""
    content = F.concat(F.lit("module m\nrequire (\n\tgithub.com/x/"), F.element_at(F.split("p_name", " "), 2), F.lit(" v"), "p_size", F.lit(".2.0\n)\nrequire golang.org/y v1."), "p_size", F.lit(".0-rc1 // indirect"))
    return g.table("part").select("p_partkey", F.inline(formats.go_modules(content)))


@query("json_documents", "WITH a AS (SELECT scan_id, file_path, risk FROM attestations WHERE risk = 'CRITICAL' AND org_id = 1 ORDER BY scan_id, file_path LIMIT 10000) SELECT to_json({'exported_at': '2001-08-02', 'count': count(*), 'data': list_sort(list({'scan_id': scan_id, 'file_path': file_path, 'risk': risk}))})::VARCHAR AS document FROM a")
def json_documents(g):
    """The JSON export of one organisation's critical sign-offs, 10,000 rows at most (the export's own limit)."""
    rows = g.attestations.where("risk = 'CRITICAL' and org_id = 1").select("scan_id", "file_path", "risk")
    return formats.json_document(rows.orderBy("scan_id", "file_path").limit(10_000), "2001-08-02")
