"""The governance tables, as views over the star schema of the test data.

Scans come from orders, files of a scan from its line items, findings and sign-offs from
their flags. ``SQL`` states the same views for an oracle, each over those before it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checkpoint import stored
from ..functions.scalars import hours

#: All relative dates are measured from here; never from the clock.
AS_OF = "2001-08-02"
#: Lines of scans that a task takes where they are dealt by their number.
LINES_A_TASK = 500_000
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL = {
    "file_rows": """SELECT l_orderkey AS scan_id, 'src/' || replace(p_name, ' ', '_') AS file_path, max(l_quantity) AS max_q,
        CAST(sum(l_quantity) AS BIGINT) AS line_count, bool_or(l_returnflag = 'R') AS has_r, bool_or(l_returnflag = 'A') AS has_a,
        bool_or(l_linestatus = 'O') AS has_o, min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS r_line,
        min(CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS reviewer, max(l_linenumber) AS max_line,
        list_sort(list(DISTINCT p_type)) AS indicators, min(p_brand) AS brand
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "scans": """SELECT o_orderkey AS id, n_regionkey AS org_id, n_name || '/' || c_mktsegment AS repo, o_custkey AS pr_number, c_name AS pr_author,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' WHEN '5' THEN 'LOW' ELSE 'UNKNOWN' END AS overall_risk,
        CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS DOUBLE) / 1000 AS ai, o_orderdate AS created_at, o_orderstatus AS triggered_by,
        coalesce(n_files, 0) AS file_count
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT scan_id, count(*) AS n_files FROM file_rows GROUP BY 1) ON o_orderkey = scan_id""",
    "scan_files": """SELECT f.*, max_q / 50 AS ai, CASE WHEN max_q >= 46 THEN 'CRITICAL' WHEN max_q >= 36 THEN 'HIGH' WHEN max_q >= 21 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
        s.org_id, s.repo, s.pr_number, s.pr_author, s.created_at, s.overall_risk FROM file_rows f JOIN scans s ON f.scan_id = s.id""",
    "attestations": """SELECT scan_id, file_path, org_id, repo, reviewer, risk, created_at + r_line * 5 * INTERVAL 1 HOUR AS attested_at FROM scan_files WHERE has_r""",
    "violations": """SELECT scan_id, file_path, org_id, repo, risk, created_at, CASE WHEN NOT has_o THEN 'resolved' WHEN has_a THEN 'in_review' ELSE 'open' END AS status,
        created_at + CASE WHEN overall_risk = 'CRITICAL' THEN 24 ELSE 48 END * INTERVAL 1 HOUR AS sla_deadline,
        CASE WHEN NOT has_o THEN created_at + max_line * 12 * INTERVAL 1 HOUR END AS resolved_at FROM scan_files WHERE risk <> 'LOW'""",
    "latest_scans": """SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, id DESC) AS k FROM scans) WHERE k = 1""",
    "latest_violations": """SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY repo, file_path ORDER BY created_at DESC, scan_id DESC) AS k FROM violations) WHERE k = 1""",
    "current_violations": """SELECT v.* FROM latest_violations v WHERE status IN ('open', 'in_review')
        AND NOT EXISTS (SELECT 1 FROM attestations a WHERE a.repo = v.repo AND a.file_path = v.file_path)""",
    "top_files": """SELECT f.scan_id, f.repo, f.org_id, f.file_path, f.ai, f.risk, f.pr_number, f.line_count, f.indicators, a.reviewer AS attested_by, a.attested_at, a.scan_id IS NOT NULL AS attested
        FROM scan_files f JOIN latest_scans s ON f.scan_id = s.id LEFT JOIN attestations a ON f.scan_id = a.scan_id AND f.file_path = a.file_path""",
    "repo_stats": """SELECT s.org_id, s.repo, s.ai_pct, CASE WHEN file_count = 0 THEN 1.0 ELSE least(1.0, coalesce(n, 0)::DOUBLE / file_count) END AS attestation_rate, last_scan, scan_count, file_count, latest_scan_id
        FROM (SELECT org_id, repo, avg(ai) AS ai_pct, max(created_at) AS last_scan, count(*) AS scan_count, CAST(sum(file_count) AS BIGINT) AS file_count, max_by(id, (created_at, id)) AS latest_scan_id FROM scans GROUP BY 1, 2) s
        LEFT JOIN (SELECT repo, count(*) AS n FROM attestations a SEMI JOIN latest_scans l ON a.scan_id = l.id GROUP BY 1) USING (repo)""",
    "weekly": """SELECT org_id, date_trunc('week', created_at)::DATE AS week, count(*) FILTER (overall_risk = 'CRITICAL') AS critical_count, count(*) FILTER (overall_risk = 'HIGH') AS high_count,
        count(*) FILTER (overall_risk = 'MEDIUM') AS medium_count FROM scans GROUP BY 1, 2""",
    "daily": """SELECT org_id, created_at::DATE AS day, count(*) FILTER (overall_risk = 'CRITICAL') AS critical_count, count(*) FILTER (overall_risk = 'HIGH') AS high_count,
        count(*) FILTER (overall_risk = 'MEDIUM') AS medium_count, count(*) FILTER (overall_risk IN ('LOW', 'UNKNOWN')) AS low_count, count(*) AS scan_count, avg(ai) AS avg_ai FROM scans GROUP BY 1, 2""",
}


def oracle(sql: str) -> str:
    """``sql`` with those views before it that it uses, directly or through others."""
    wanted: set[str] = set()

    def add(text: str) -> None:
        for name in SQL:
            if name not in wanted and any(f"{c}{name}{d}" in f" {text} " for c in " (,\n" for d in " ),\n"):
                wanted.add(name)
                add(SQL[name])

    add(sql)
    views = ", ".join(f"{k} AS ({v})" for k, v in SQL.items() if k in wanted)
    sql = sql.strip()
    if not views:
        return sql
    return f"WITH {views}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {views} {sql}"


class Governance:
    """The tables of one directory; nothing is read before an action."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.settled, self.tasks = spark, sf_dir, False, 0

    def settle(self) -> Governance:
        """Write the files of all scans once, for a query that reads them many times."""
        if not self.settled:
            self.scan_files = stored(self.scan_files, "scan-files")
            self.file_rows = self.scan_files
            self.settled = True
        return self

    def dealt(self) -> Governance:
        """Deal the lines of all scans, counted first, over so many tasks that no task's share grows with them.

        For a query that aggregates, joins and sorts the files of all scans in one stage, where each step holds a task's rows.
        """
        if not self.tasks and not self.settled:
            lines = self.table("lineitem").count()
            self.tasks = max(self.spark.sparkContext.defaultParallelism, -(-lines // LINES_A_TASK))
        return self

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise ValueError(f"no table {name}")
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def file_rows(self) -> DataFrame:
        flag = lambda c, v: F.bool_or(F.col(c) == v)
        signed = lambda c: F.min(F.when(F.col("l_returnflag") == "R", F.col(c)))
        rows = self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        if self.tasks:
            # By the scan alone: its files are grouped and joined with it where they are.
            rows = rows.repartition(self.tasks, "l_orderkey")
        return rows.groupBy(F.col("l_orderkey").alias("scan_id"), F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("file_path")).agg(
            F.max("l_quantity").alias("max_q"), F.sum("l_quantity").cast("long").alias("line_count"),
            flag("l_returnflag", "R").alias("has_r"), flag("l_returnflag", "A").alias("has_a"), flag("l_linestatus", "O").alias("has_o"),
            signed("l_linenumber").alias("r_line"), signed("l_suppkey").alias("reviewer"), F.max("l_linenumber").alias("max_line"),
            F.array_sort(F.collect_set("p_type")).alias("indicators"), F.min("p_brand").alias("brand"),
        )

    @cached_property
    def scans_plain(self) -> DataFrame:
        """Scans without their file counts, for queries that do not need the line items."""
        first = F.substring("o_orderpriority", 1, 1)
        risk = F.when(first == "1", "CRITICAL").when(first == "2", "HIGH").when(first == "3", "MEDIUM").when(first == "5", "LOW").otherwise("UNKNOWN")
        rows = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return rows.select(
            F.col("o_orderkey").alias("id"), F.col("n_regionkey").alias("org_id"), F.concat_ws("/", "n_name", "c_mktsegment").alias("repo"),
            F.col("o_custkey").alias("pr_number"), F.col("c_name").alias("pr_author"), risk.alias("overall_risk"),
            (F.floor("o_totalprice") % 1000 / F.lit(1000.0)).alias("ai"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("triggered_by"),
        )

    @cached_property
    def scans(self) -> DataFrame:
        files = self.file_rows.groupBy(F.col("scan_id").alias("id")).agg(F.count("*").alias("n_files"))
        return self.scans_plain.join(files, "id", "left").withColumn("file_count", F.coalesce("n_files", F.lit(0))).drop("n_files")

    @cached_property
    def scan_files(self) -> DataFrame:
        q = F.col("max_q")
        own = self.scans_plain.select(F.col("id").alias("scan_id"), "org_id", "repo", "pr_number", "pr_author", "created_at", "overall_risk")
        rows = self.file_rows.join(own, "scan_id")
        return rows.withColumn("ai", q / 50).withColumn("risk", F.when(q >= 46, "CRITICAL").when(q >= 36, "HIGH").when(q >= 21, "MEDIUM").otherwise("LOW"))

    @cached_property
    def attestations(self) -> DataFrame:
        rows = self.scan_files.where("has_r")
        return rows.select("scan_id", "file_path", "org_id", "repo", "reviewer", "risk", (F.col("created_at") + hours(F.col("r_line") * 5)).alias("attested_at"))

    @cached_property
    def violations(self) -> DataFrame:
        status = F.when(~F.col("has_o"), "resolved").when(F.col("has_a"), "in_review").otherwise("open")
        limit = F.when(F.col("overall_risk") == "CRITICAL", 24).otherwise(48)
        return self.scan_files.where("risk <> 'LOW'").select(
            "scan_id", "file_path", "org_id", "repo", "risk", "created_at", status.alias("status"),
            (F.col("created_at") + hours(limit)).alias("sla_deadline"),
            F.when(~F.col("has_o"), F.col("created_at") + hours(F.col("max_line") * 12)).alias("resolved_at"),
        )


def tenant(df: DataFrame, org_id) -> DataFrame:
    """Only one organisation's rows; every public query goes through this or groups by org_id."""
    return df.where(F.col("org_id") == F.lit(org_id))


def quarantine(df: DataFrame, domains: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """Rows whose enum columns hold allowed values or null, and the others."""
    good = F.lit(True)
    for name, values in domains.items():
        good = good & (F.col(name).isNull() | F.col(name).isin(values))
    return df.where(good), df.where(~good)
