"""Content scanning: secrets, detectors, signals, scores, attribution, compliance rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import entropy, mask_secret
from ..operators import detectors, signals
from .registry import query

_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"
_VALUE = "regexp_extract(line, '(?i)(?:secret|token)(?:_?key|_?token|_?value)?\\s*=\\s*[\"'']([^\"'']{12,})[\"'']', 1)"


@query("secret_findings", f"WITH {_LINES} SELECT doc_id, n::INT AS line, {_VALUE} AS value FROM lines WHERE {_VALUE} <> ''")
def secret_findings(g):
    """Generic secret assignments in the lines of all documents."""
    rows = detectors.lines_of(g.table("documents"), "doc_id", "text")
    value = F.regexp_extract("text", detectors.GENERIC_SECRETS[2][2], 1)
    return rows.select(F.col("path").alias("doc_id"), "line", value.alias("value")).where("value <> ''")


@query("entropy_findings", f"WITH {_LINES}, v AS (SELECT doc_id, n, {_VALUE} AS value FROM lines WHERE {_VALUE} <> '') SELECT doc_id, n::INT AS line, round(e, 6) AS bits FROM (SELECT doc_id, n, (SELECT -sum(p * log2(p)) FROM (SELECT count(*)::DOUBLE / length(value) AS p FROM (SELECT unnest(string_split(value, '')) AS c) GROUP BY c)) AS e FROM v) WHERE e > 2.8")
def entropy_findings(g):
    return secret_findings(g).select("doc_id", "line", F.round(entropy(F.col("value")), 6).alias("bits")).where("bits > 2.8")


@query("masked_secrets", f"WITH {_LINES} SELECT doc_id, n::INT AS line, regexp_replace({_VALUE}, '([A-Za-z0-9_\\-]{{4}})[A-Za-z0-9_\\-]{{4,}}', '\\1••••', 'g') AS masked FROM lines WHERE {_VALUE} <> ''")
def masked_secrets(g):
    return secret_findings(g).select("doc_id", "line", mask_secret(F.col("value")).alias("masked"))


_WORDS = "list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda w: w <> '')"


@query("mattr", f"SELECT doc_id, round(avg(r), 8) AS mattr FROM (SELECT doc_id, k, len(list_distinct(w[k * 100 + 1 : k * 100 + 100])) / 100.0::DOUBLE AS r FROM (SELECT doc_id, w, unnest(range(len(w) // 100)) AS k FROM (SELECT doc_id, {_WORDS} AS w FROM documents))) GROUP BY 1")
def mattr(g):
    """Mean share of distinct words over whole windows of 100 words."""
    rows = signals.mattr(g.table("documents"), "doc_id", "text")
    return rows.select("doc_id", F.round("mattr", 8).alias("mattr"))


@query("line_length_uniformity", f"WITH {_LINES} SELECT doc_id, count(*) AS lines, round(stddev_pop(length(line)) / avg(length(line)), 6) AS variation FROM lines WHERE trim(line) <> '' GROUP BY 1")
def line_length_uniformity(g):
    rows = g.table("documents").select("doc_id", signals.line_variation(F.col("text")).alias("x")).where("x.n > 0")
    return rows.select("doc_id", F.col("x.n").alias("lines"), F.round("x.variation", 6).alias("variation"))


@query("comment_density", f"WITH {_LINES} SELECT doc_id, round(avg((trim(line) LIKE '#%' OR trim(line) LIKE '//%' OR trim(line) LIKE '%|%')::INT), 8) AS density FROM lines GROUP BY 1")
def comment_density(g):
    lines = F.split("text", "\n")
    odd = F.size(F.filter(lines, lambda x: F.trim(x).rlike(r"^#|^//|\|")))
    return g.table("documents").select("doc_id", F.round(odd / F.size(lines), 8).alias("density"))


@query("blank_runs", f"WITH {_LINES}, m AS (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS island FROM lines WHERE length(line) < 20) SELECT doc_id, count(*) AS runs, max(len) AS longest FROM (SELECT doc_id, island, count(*) AS len FROM m GROUP BY 1, 2) GROUP BY 1")
def blank_runs(g):
    """Runs of short lines in each document, by gaps and islands."""
    rows = detectors.lines_of(g.table("documents"), "doc_id", "text").where(F.length("text") < 20)
    island = F.col("line") - F.row_number().over(Window.partitionBy("path").orderBy("line"))
    runs = rows.select(F.col("path").alias("doc_id"), island.alias("island")).groupBy("doc_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("doc_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


_SEVERITY = "CASE split_part(x, ' ', 1) WHEN 'PROMO' THEN 'critical' WHEN 'ECONOMY' THEN 'high' WHEN 'STANDARD' THEN 'medium' ELSE 'low' END"


@query("file_risk", f"SELECT scan_id, file_path, CASE WHEN list_contains(s, 'critical') THEN 'CRITICAL' WHEN list_contains(s, 'high') OR ai > 0.75 THEN 'HIGH' WHEN ai > 0.52 OR len(s) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS derived FROM (SELECT scan_id, file_path, ai, list_transform(list_filter(indicators, lambda x: x <> 'SMALL'), lambda x: {_SEVERITY}) AS s FROM scan_files)")
def file_risk(g):
    """Risk level from the severities of a file's findings and its score; one critical finding is enough."""
    first = lambda x: F.split(x, " ")[0]
    severity = lambda x: F.when(first(x) == "PROMO", "critical").when(first(x) == "ECONOMY", "high").when(first(x) == "STANDARD", "medium").otherwise("low")
    found = F.transform(F.filter("indicators", lambda x: x != "SMALL"), severity)
    return g.scan_files.select("scan_id", "file_path", signals.risk_level(found, F.col("ai")).alias("derived"))


@query("scan_rollup", "SELECT scan_id, round(CASE WHEN sum(line_count) > 0 THEN sum(ai * line_count) / sum(line_count) ELSE 0 END, 8) AS weighted_ai, round(quantile_cont(ai, 0.5), 8) AS p50, round(quantile_cont(ai, 0.9), 8) AS p90, max(CASE risk WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS worst, round(1 - coalesce(stddev_pop(ai), 0), 8) AS consistency FROM scan_files GROUP BY 1")
def scan_rollup(g):
    """A scan's AI share weighted by lines, percentiles, worst risk and consistency."""
    from ..functions.scalars import risk_rank

    lines = F.sum("line_count")
    p = F.percentile("ai", F.array(F.lit(0.5), F.lit(0.9)))
    rows = g.scan_files.groupBy("scan_id").agg(F.coalesce(F.sum(F.col("ai") * F.col("line_count")) / F.nullif(lines, F.lit(0)), F.lit(0.0)).alias("w"), p.alias("p"), F.max(risk_rank(F.col("risk"))).alias("worst"), (1 - F.coalesce(F.stddev_pop("ai"), F.lit(0.0))).alias("c"))
    return rows.select("scan_id", F.round("w", 8).alias("weighted_ai"), F.round(F.col("p")[0], 8).alias("p50"), F.round(F.col("p")[1], 8).alias("p90"), "worst", F.round("c", 8).alias("consistency"))


@query("cross_file_outliers", "SELECT scan_id, file_path, round(ai - m, 8) AS deviation FROM (SELECT *, avg(ai) OVER (PARTITION BY scan_id) AS m FROM scan_files) WHERE round(abs(ai - m), 9) > 0.25")
def cross_file_outliers(g):
    d = F.col("ai") - F.avg("ai").over(Window.partitionBy("scan_id"))
    return g.scan_files.select("scan_id", "file_path", F.round(d, 8).alias("deviation"), d.alias("d")).where("round(abs(d), 9) > 0.25").drop("d")


@query("noisy_or", "SELECT scan_id, round(CASE WHEN bool_or(0.65 * ai >= 1) THEN 1 ELSE 1 - exp(sum(ln(1 - 0.65::DOUBLE * ai))) END, 8) AS combined FROM scan_files GROUP BY 1")
def noisy_or(g):
    """Independent signals combined: one minus the product of what each leaves."""
    leaks = F.collect_list(F.lit(0.65) * F.col("ai"))
    return g.scan_files.groupBy("scan_id").agg(F.round(signals.noisy_or(leaks), 8).alias("combined"))


_HALVES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x, i: (i - 1 < len(string_split(coalesce(text, ''), chr(10))) // 2) = {})"


@query("vocabulary_overlap", f"WITH h AS (SELECT doc_id, list_distinct(list_filter(string_split(array_to_string({_HALVES.format('true')}, ' '), ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(array_to_string({_HALVES.format('false')}, ' '), ' '), lambda x: x <> '')) AS b FROM documents) SELECT doc_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 8) AS jaccard FROM h")
def vocabulary_overlap(g):
    """Similarity of the words in a text's first and last half of lines, as sets."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = g.table("documents").select("doc_id", lines.alias("x")).withColumn("k", F.floor(F.size("x") / 2).cast("int"))
    words = lambda part: F.array_distinct(F.filter(F.split(F.array_join(part, " "), " "), lambda w: w != ""))
    rows = rows.select("doc_id", words(F.slice("x", F.lit(1), F.col("k"))).alias("a"), words(F.slice("x", F.col("k") + 1, F.size("x") - F.col("k"))).alias("b"))
    both = F.size(F.array_union("a", "b"))
    return rows.select("doc_id", F.round(F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect("a", "b")) / both), 8).alias("jaccard"))
