"""The roll-up of a scan: its files' shares, models and findings as one row.

Files and findings are aggregated by scan and kind first, so nothing of a scan is collected but its kinds and models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lines from which a file is scored, when a model counts, how many files it must have, and what that adds.
SCORED_LINES, SURE, SHARE, FILES, BOOST = 20, 0.40, 0.60, 3, 0.05
HIGH, LOW, MIXED_FILES, MIXED_SHARE, QUALITY = 0.65, 0.25, 4, 0.70, 0.70
PERCENTILES = (10, 25, 50, 75, 90)


def rollup(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row a scan. ``files``: scan_id, path, lines, skip, ai, model, confidence, quality; ``findings``: scan_id, kind, severity.

    Percentiles, mixture and quality count scorable files only; a scan without any has null percentiles and quality 0.
    Of kinds equally frequent the first by name stands first.
    """
    scorable = (F.col("lines") > SCORED_LINES) & ~F.col("skip")
    p = F.percentile(F.when(scorable, F.col("ai")), F.array(*[F.lit(x / 100) for x in PERCENTILES]))
    high, low = F.count_if(scorable & (F.col("ai") > HIGH)), F.count_if(scorable & (F.col("ai") < LOW))
    rows = files.groupBy("scan_id").agg(
        F.count("*").alias("files"), F.count_if(scorable).alias("scorable"), F.coalesce(F.sum(F.col("ai") * F.col("lines")) / F.nullif(F.sum("lines"), F.lit(0)), F.lit(0.0)).alias("mean"), p.alias("p"), high.alias("high"), low.alias("low"),
        F.coalesce(F.avg(F.when(scorable, F.col("quality"))), F.lit(0.0)).alias("scan_quality"), F.count_if(scorable & (F.col("quality") >= QUALITY)).alias("confident_files"),
    )
    named = files.where((F.col("confidence") >= SURE) & ~F.col("model").isin("human", "unknown"))
    models = named.groupBy("scan_id", "model").count().groupBy("scan_id").agg(F.max("count").alias("top"))
    kinds = findings.groupBy("scan_id", "kind", "severity").agg(F.count("*").alias("n"))
    of = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).alias(s)
    severities = kinds.groupBy("scan_id").agg(*map(of, ("critical", "high", "medium", "low")))
    frequent = kinds.groupBy("scan_id", "kind").agg(F.sum("n").alias("n")).groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "kind"))).alias("k"))
    frequent = frequent.select("scan_id", F.transform(F.slice("k", 1, 3), lambda x: x["kind"]).alias("top_kinds"))
    severities = severities.select("scan_id", *[F.col(s).alias(f"{s}_count") for s in ("critical", "high", "medium", "low")])
    rows = rows.join(models, "scan_id", "left").join(severities, "scan_id", "left").join(frequent, "scan_id", "left")
    boosted = (F.col("files") >= FILES) & (F.coalesce("top", F.lit(0)) >= F.ceil(F.col("files") * SHARE))
    mixed = (F.col("files") >= MIXED_FILES) & (F.col("high") >= 2) & (F.col("low") >= 2) & (F.col("high") + F.col("low") >= F.col("scorable") * MIXED_SHARE)
    counts = {s: F.coalesce(f"{s}_count", F.lit(0)).cast("long") for s in ("critical", "high", "medium", "low")}
    return rows.select(
        "scan_id", "files", "scorable", F.when(boosted, F.least(F.lit(1.0), F.col("mean") + BOOST)).otherwise(F.col("mean")).alias("ai"), boosted.alias("boosted"), mixed.alias("mixed"),
        *[F.col("p")[i].alias(f"p{x}") for i, x in enumerate(PERCENTILES)], "scan_quality", "confident_files", *[v.alias(f"{s}_count") for s, v in counts.items()],
        sum(counts.values()).alias("findings"), F.coalesce("top_kinds", F.array().cast("array<string>")).alias("top_kinds"), (counts["critical"] + counts["high"] > 0).alias("immediate"),
    )
