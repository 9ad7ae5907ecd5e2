"""Time series: daily trend, velocities, regressions, spines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, half_up, hours_between, ratio
from ..operators import relational as R
from ..sources.governance import AS_OF
from .governance import weekly
from .registry import query


def daily(g) -> DataFrame:
    count = lambda *r: F.count_if(F.col("overall_risk").isin(*r))
    return g.scans_plain.groupBy("org_id", F.to_date("created_at").alias("day")).agg(
        count("CRITICAL").alias("critical_count"), count("HIGH").alias("high_count"), count("MEDIUM").alias("medium_count"),
        count("LOW", "UNKNOWN").alias("low_count"), F.count("*").alias("scan_count"), F.avg("ai").alias("avg_ai"),
    )


def last_days(g, n: int = 14) -> DataFrame:
    """The last n days with scans of each organisation, with their index from 0."""
    back = Window.partitionBy("org_id").orderBy(F.desc("day"))
    rows = daily(g).withColumn("k", F.row_number().over(back)).where(F.col("k") <= n)
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("org_id").orderBy("day")) - 1).drop("k")


_LAST = "last AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY day) - 1 AS i FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY day DESC) AS k FROM daily) WHERE k <= 14)"


@query("daily_risk_trend", f"WITH {_LAST} SELECT org_id, day, critical_count, high_count, medium_count, low_count, scan_count, round(avg_ai, 8) AS avg_ai FROM last")
def daily_risk_trend(g):
    return last_days(g).drop("i").withColumn("avg_ai", F.round("avg_ai", 8))


@query("attestation_velocity", """SELECT org_id, list_sort(list(h))[(len(list(h)) // 2) + 1] AS median_hours, count(*) AS samples FROM (SELECT s.org_id, epoch(min(attested_at) - any_value(s.created_at)) / 3600.0 AS h FROM attestations a JOIN scans s ON a.scan_id = s.id GROUP BY s.org_id, s.id) WHERE h >= 0 AND h < 720 GROUP BY 1""")
def attestation_velocity(g):
    """Upper median of the hours from a scan to its first sign-off, outliers (30 days) left out."""
    first = g.attestations.groupBy(F.col("scan_id").alias("id")).agg(F.min("attested_at").alias("first"))
    rows = g.scans_plain.join(first, "id").select("org_id", hours_between(F.col("created_at"), F.col("first")).alias("h")).where("h >= 0 and h < 720")
    # Values repeat, so they are counted first and the list stays short for any number of scans.
    counts = rows.groupBy("org_id", "h").count()
    upto = F.sum("count").over(Window.partitionBy("org_id").orderBy("h"))
    total = F.sum("count").over(Window.partitionBy("org_id"))
    counts = counts.select("org_id", "h", upto.alias("upto"), total.alias("samples"))
    return counts.where(F.col("upto") > F.floor(F.col("samples") / 2)).groupBy("org_id").agg(F.min("h").alias("median_hours"), F.first("samples").alias("samples"))


@query("upper_median_by_author", "SELECT pr_author, list_sort(list(ai))[(len(list(ai)) // 2) + 1] AS median_ai FROM scans GROUP BY 1")
def upper_median_by_author(g):
    """The upper median of each author's scans, from counted values; no list of an author's scans is made."""
    counts = g.scans_plain.groupBy("pr_author", "ai").count()
    own = Window.partitionBy("pr_author")
    counts = counts.select("pr_author", "ai", F.sum("count").over(own.orderBy("ai")).alias("upto"), F.sum("count").over(own).alias("n"))
    return counts.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("pr_author").agg(F.min("ai").alias("median_ai"))


@query("sla_breach_rate", f"SELECT org_id, floor(100.0 * count(*) FILTER (coalesce(resolved_at, TIMESTAMP '{AS_OF}') > sla_deadline) / count(*) * 10 + 0.5) / 10 AS breach_rate FROM violations GROUP BY 1")
def sla_breach_rate(g):
    late = F.coalesce("resolved_at", F.lit(AS_OF).cast("timestamp_ntz")) > F.col("sla_deadline")
    return g.violations.groupBy("org_id").agg((half_up(ratio(F.count_if(late), F.count("*")) * 100.0 * 10) / 10).alias("breach_rate"))


@query("top_indicators", "SELECT org_id, indicator, n FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY n DESC, indicator) AS k FROM (SELECT org_id, indicator, count(*) AS n FROM (SELECT org_id, unnest(indicators) AS indicator FROM scan_files) GROUP BY 1, 2)) WHERE k <= 10")
def top_indicators(g):
    counts = g.scan_files.select("org_id", F.explode("indicators").alias("indicator")).groupBy("org_id", "indicator").agg(F.count("*").alias("n"))
    order = Window.partitionBy("org_id").orderBy(F.desc("n"), "indicator")
    return counts.withColumn("k", F.row_number().over(order)).where("k <= 10").drop("k")


@query("risk_forecast", f"""WITH {_LAST}, fitted AS (SELECT org_id, coalesce(regr_slope(critical_count, i), 0) AS slope, coalesce(regr_intercept(critical_count, i), 0) AS base, count(*) AS n FROM last GROUP BY 1)
    SELECT org_id, CASE WHEN slope > 0.1 THEN 'worsening' WHEN slope < -0.1 THEN 'improving' ELSE 'stable' END AS direction, round(slope, 6) AS slope, floor(greatest(0, base + slope * n) + 0.5)::BIGINT AS next_period, CASE WHEN n >= 4 THEN 'medium' ELSE 'low' END AS confidence FROM fitted""")
def risk_forecast(g):
    """Least-squares line through the daily critical counts, one step ahead."""
    rows = last_days(g).groupBy("org_id").agg(F.coalesce(F.regr_slope("critical_count", "i"), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_intercept("critical_count", "i"), F.lit(0.0)).alias("base"), F.count("*").alias("n"))
    slope = F.col("slope")
    return rows.select(
        "org_id", F.when(slope > 0.1, "worsening").when(slope < -0.1, "improving").otherwise("stable").alias("direction"), F.round("slope", 6).alias("slope"),
        half_up(F.greatest(F.lit(0.0), F.col("base") + slope * F.col("n"))).alias("next_period"), F.when(F.col("n") >= 4, "medium").otherwise("low").alias("confidence"),
    )


@query("ai_slope_by_repo", "SELECT org_id, repo, round(avg_ai, 8) AS avg_ai, round(slope, 8) AS slope, samples FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY avg_ai DESC, repo) AS k FROM (SELECT org_id, repo, avg(ai) AS avg_ai, coalesce(regr_slope(ai, i), 0) AS slope, count(*) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY created_at, id) - 1 AS i FROM scans) GROUP BY 1, 2)) WHERE k <= 10")
def ai_slope_by_repo(g):
    """The ten repositories of highest AI share in each organisation, with its slope over scans."""
    order = Window.partitionBy("repo").orderBy("created_at", "id")
    rows = g.scans_plain.withColumn("i", F.row_number().over(order) - 1).groupBy("org_id", "repo").agg(F.avg("ai").alias("avg_ai"), F.coalesce(F.regr_slope("ai", "i"), F.lit(0.0)).alias("slope"), F.count("*").alias("samples"))
    best = Window.partitionBy("org_id").orderBy(F.desc("avg_ai"), "repo")
    return rows.withColumn("k", F.row_number().over(best)).where("k <= 10").select("org_id", "repo", F.round("avg_ai", 8).alias("avg_ai"), F.round("slope", 8).alias("slope"), "samples")


@query("activity_spine_14d", "WITH spine AS (SELECT unnest(generate_series(DATE '2001-07-19', DATE '2001-08-01', INTERVAL 1 DAY))::DATE AS day) SELECT spine.day, coalesce(count(id), 0) AS scans, coalesce(count(*) FILTER (overall_risk IN ('CRITICAL', 'HIGH')), 0) AS risky FROM spine LEFT JOIN scans ON created_at::DATE = spine.day GROUP BY 1")
def activity_spine_14d(g):
    """The last 14 days, also those without a scan."""
    spine = R.day_spine(g.scans_plain, "2001-07-19", "2001-08-01")
    counts = g.scans_plain.where("created_at >= timestamp_ntz'2001-07-19'").groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("scans"), F.count_if(F.col("overall_risk").isin("CRITICAL", "HIGH")).alias("risky"))
    return spine.join(counts, "day", "left").fillna(0)


@query("risk_halves", "WITH t AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY week) AS i, count(*) OVER (PARTITION BY org_id) AS n FROM weekly) SELECT org_id, round(coalesce(avg(critical_count + high_count) FILTER (i <= n // 2), 0), 8) AS first_half, round(avg(critical_count + high_count) FILTER (i > n // 2), 8) AS second_half FROM t GROUP BY 1")
def risk_halves(g):
    """Mean risky scans a week in the first and the second half of the series."""
    rows = weekly(g).withColumn("i", F.row_number().over(Window.partitionBy("org_id").orderBy("week"))).withColumn("n", F.count("*").over(Window.partitionBy("org_id")))
    v, early = F.col("critical_count") + F.col("high_count"), F.col("i") <= F.floor(F.col("n") / 2)
    return rows.groupBy("org_id").agg(F.round(F.coalesce(F.avg(F.when(early, v)), F.lit(0.0)), 8).alias("first_half"), F.round(F.avg(F.when(~early, v)), 8).alias("second_half"))


@query("week_over_week", "SELECT org_id, week, critical_count + high_count - lag(critical_count + high_count) OVER (PARTITION BY org_id ORDER BY week) AS change FROM weekly")
def week_over_week(g):
    v = F.col("critical_count") + F.col("high_count")
    return weekly(g).select("org_id", "week", (v - F.lag(v).over(Window.partitionBy("org_id").orderBy("week"))).alias("change"))


_CLAMP = "greatest(0.0, least(100.0, {}))"


@query("posture_history", f"""WITH last AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY week) - 1 AS i, count(*) OVER (PARTITION BY org_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY week DESC) AS k FROM weekly) WHERE k <= 10),
    p AS (SELECT l.*, att, critical_count + high_count AS ch, coalesce(lag(critical_count + high_count) OVER (PARTITION BY l.org_id ORDER BY week), critical_count + high_count + 2) AS prev FROM last l JOIN (SELECT org_id, avg(attestation_rate) AS att FROM repo_stats GROUP BY 1) USING (org_id))
    SELECT org_id, week, floor({_CLAMP.format("100 - critical_count * 15 - high_count * 6 - medium_count * 1.5::DOUBLE")} * 0.25::DOUBLE + {_CLAMP.format("least(0.95::DOUBLE, att + (n - 1 - i) * -0.015::DOUBLE) * 100")} * 0.2::DOUBLE + 80 * 0.2::DOUBLE + 70 * 0.15::DOUBLE + 75 * 0.1::DOUBLE + (65 + CASE WHEN prev > ch THEN 15 WHEN prev < ch THEN -10 ELSE 0 END) * 0.1::DOUBLE + 0.5)::BIGINT AS score FROM p""")
def posture_history(g):
    """A posture score for each of the last ten weeks; parts without a history are constants."""
    from .governance import repo_stats

    back = Window.partitionBy("org_id").orderBy(F.desc("week"))
    order = Window.partitionBy("org_id").orderBy("week")
    rows = weekly(g).withColumn("k", F.row_number().over(back)).where("k <= 10")
    rows = rows.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("org_id")))
    ch = F.col("critical_count") + F.col("high_count")
    rows = rows.withColumn("ch", ch).withColumn("prev", F.coalesce(F.lag("ch").over(order), F.col("ch") + 2))
    rows = rows.join(repo_stats(g).groupBy("org_id").agg(F.avg("attestation_rate").alias("att")), "org_id")
    ai = clamp(100 - F.col("critical_count") * 15 - F.col("high_count") * 6 - F.col("medium_count") * 1.5)
    att = clamp(F.least(F.lit(0.95), F.col("att") + (F.col("n") - 1 - F.col("i")) * -0.015) * 100)
    response = 65 + F.when(F.col("prev") > F.col("ch"), 15).when(F.col("prev") < F.col("ch"), -10).otherwise(0)
    score = ai * 0.25 + att * 0.2 + F.lit(80) * 0.2 + F.lit(70) * 0.15 + F.lit(75) * 0.1 + response * 0.1
    return rows.select("org_id", "week", half_up(score).alias("score"))
