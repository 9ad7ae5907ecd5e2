"""Evaluation of a detector against labels: confusion, AUC, calibration, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..operators import authorship
from .code import _FILES, code_files
from .registry import query

#: The score under test: the share of signs in a text, times ten, at most 1. The label is low quality.
_SCORED = """scored AS (SELECT doc_id, least(1.0::DOUBLE, 10.0::DOUBLE * len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) / greatest(1, len(text))) AS score, 1 - quality AS y FROM documents JOIN labels USING (doc_id))"""


def scored(g) -> DataFrame:
    text = F.col("text")
    signs = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    score = F.least(F.lit(1.0), F.lit(10.0) * signs / F.greatest(F.lit(1), F.length(text)))
    docs = g.table("documents").select("doc_id", score.alias("score"))
    return docs.join(g.table("labels").select("doc_id", (1 - F.col("quality")).alias("y")), "doc_id")


def confusion_counts(hit, y) -> list:
    return [F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit & (y == 0)).alias("fp"), F.count_if(~hit & (y == 0)).alias("tn"), F.count_if(~hit & (y == 1)).alias("fn")]


@query("confusion", f"WITH {_SCORED}, c AS (SELECT count(*) FILTER (score >= 0.2 AND y = 1) AS tp, count(*) FILTER (score >= 0.2 AND y = 0) AS fp, count(*) FILTER (score < 0.2 AND y = 0) AS tn, count(*) FILTER (score < 0.2 AND y = 1) AS fn FROM scored) SELECT tp, fp, tn, fn, round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp::DOUBLE / (tp + fp) END, 8) AS precision, round(tp::DOUBLE / (tp + fn), 8) AS recall, round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 8) AS accuracy, round(fp::DOUBLE / (fp + tn), 8) AS fpr, round(fn::DOUBLE / (fn + tp), 8) AS fnr, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 8) AS f1 FROM c")
def confusion(g, threshold: float = 0.2, empty_precision: float = 1.0):
    """The four counts and their ratios; precision of no hits is a parameter."""
    c = scored(g).agg(*confusion_counts(F.col("score") >= threshold, F.col("y")))
    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))
    r = lambda x: F.round(x, 8)
    return c.select("tp", "fp", "tn", "fn", r(ratio(tp, tp + fp, empty_precision)).alias("precision"), r(ratio(tp, tp + fn)).alias("recall"), r(ratio(tp + tn, tp + fp + tn + fn)).alias("accuracy"), r(ratio(fp, fp + tn)).alias("fpr"), r(ratio(fn, fn + tp)).alias("fnr"), r(ratio(tp * 2.0, tp * 2 + fp + fn)).alias("f1"))


@query("auc_exact", f"WITH {_SCORED}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scored) SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)::DOUBLE / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 8) AS auc FROM r")
def auc_exact(g):
    """Area under the curve with ties as half, from counts of each distinct score.

    Scores are counted first, so the running sum goes over distinct scores and no pair of
    rows is made; the sums are two-level, so no task sees all scores.
    """
    counts = scored(g).groupBy("score").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    band = F.floor(F.col("score") * 1000)
    counts = counts.withColumn("band", band)
    inner = Window.partitionBy("band").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    bands = counts.groupBy("band").agg(F.sum("n").alias("n_band"))
    bands = bands.select("band", F.coalesce(F.sum("n_band").over(Window.partitionBy(F.lit(0)).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    rows = counts.withColumn("inside", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(F.broadcast(bands), "band")
    wins = F.sum(F.col("p") * (F.col("below") + F.col("inside") + F.col("n") / 2.0))
    return rows.agg(F.round(wins / F.nullif(F.sum("p") * F.sum("n"), F.lit(0)), 8).alias("auc"))


@query("auc_trapezoid", f"WITH {_SCORED}, t AS (SELECT unnest(range(11)) / 10.0::DOUBLE AS t), c AS (SELECT t, count(*) FILTER (score >= t AND y = 1)::DOUBLE / count(*) FILTER (y = 1) AS tpr, count(*) FILTER (score >= t AND y = 0)::DOUBLE / count(*) FILTER (y = 0) AS fpr FROM scored, t GROUP BY 1) SELECT round(sum((prev_f - fpr) * (prev_t + tpr) / 2), 8) AS auc FROM (SELECT *, lag(tpr) OVER (ORDER BY t) AS prev_t, lag(fpr) OVER (ORDER BY t) AS prev_f FROM c)")
def auc_trapezoid(g):
    """The approximation over eleven fixed thresholds, in one pass over the rows."""
    rates = F.array(*[F.struct(F.lit(k).alias("k"), (F.count_if((F.col("score") >= k / 10) & (F.col("y") == 1)) / F.count_if(F.col("y") == 1)).alias("tpr"), (F.count_if((F.col("score") >= k / 10) & (F.col("y") == 0)) / F.count_if(F.col("y") == 0)).alias("fpr")) for k in range(11)])
    rows = scored(g).agg(rates.alias("r"))
    area = "aggregate(sequence(1, size(r) - 1), 0D, (a, i) -> a + (r[i - 1].fpr - r[i].fpr) * (r[i - 1].tpr + r[i].tpr) / 2)"
    return rows.select(F.round(F.expr(area), 8).alias("auc"))


@query("brier", f"WITH {_SCORED} SELECT round(avg(pow(score - y, 2)), 8) AS brier, round(avg(score) FILTER (y = 1) - avg(score) FILTER (y = 0), 8) AS separation, round(count(*) FILTER (y = 0 AND score > 0.65) / greatest(1, count(*) FILTER (y = 0))::DOUBLE, 8) AS over_confident, round(count(*) FILTER (y = 1 AND score < 0.35) / greatest(1, count(*) FILTER (y = 1))::DOUBLE, 8) AS under_confident FROM scored")
def brier(g):
    """Calibration: squared error, distance of the classes' means, good rows scored high and bad ones scored low."""
    s, y = F.col("score"), F.col("y")
    share = lambda label, test: F.round(F.count_if((y == label) & test) / F.greatest(F.lit(1), F.count_if(y == label)), 8)
    return scored(g).agg(F.round(F.avg(F.pow(s - y, 2)), 8).alias("brier"), F.round(F.avg(F.when(y == 1, s)) - F.avg(F.when(y == 0, s)), 8).alias("separation"), share(0, s > 0.65).alias("over_confident"), share(1, s < 0.35).alias("under_confident"))


_F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END"


@query("threshold_search", f"WITH {_SCORED}, t AS (SELECT unnest(range(1, 20)) AS k), c AS (SELECT k, count(*) FILTER (score >= k / 20.0::DOUBLE AND y = 1) AS tp, count(*) FILTER (score >= k / 20.0::DOUBLE AND y = 0) AS fp, count(*) FILTER (score < k / 20.0::DOUBLE AND y = 1) AS fn FROM scored, t GROUP BY 1) SELECT k / 20.0::DOUBLE AS threshold, round({_F1}, 8) AS f1 FROM c ORDER BY {_F1} DESC, k LIMIT 1")
def threshold_search(g):
    """Best F1 of nineteen thresholds; of equals the smallest. One pass over the rows."""
    y = F.col("y")
    each = []
    for k in range(1, 20):
        hit = F.col("score") >= k / 20
        tp, fp, fn = F.count_if(hit & (y == 1)), F.count_if(hit & (y == 0)), F.count_if(~hit & (y == 1))
        each.append(F.struct(ratio(tp * 2.0, tp * 2 + fp + fn).alias("f1"), F.lit(-k).alias("k")))
    best = scored(g).agg(F.array_max(F.array(*each)).alias("b"))
    return best.select((F.col("b.k") / -20.0).alias("threshold"), F.round("b.f1", 8).alias("f1"))


#: A signal fires from this value on.
FIRES = 0.15
_RATE = "CASE WHEN fp = 0 THEN CASE WHEN tp > 0 THEN 99 ELSE 1 END ELSE (tp / greatest(1, bad)::DOUBLE) / (fp / greatest(1, good)::DOUBLE) END"
_VALUES = authorship.counted_sql(f"SELECT doc_id AS id, text, lang, len(string_split(text, chr(10))) AS lines FROM ({_FILES})", authorship.PORTABLE)


@query("signal_likelihood", f"WITH s AS MATERIALIZED ({_VALUES}), d AS (SELECT s.*, 1 - quality AS y FROM s JOIN labels ON id = doc_id), c AS (" + " UNION ALL ".join(f"""SELECT '{k}' AS signal, count(*) FILTER (y = 1 AND "{k}" > {FIRES}) AS tp, count(*) FILTER (y = 0 AND "{k}" > {FIRES}) AS fp, count(*) FILTER (y = 1) AS bad, count(*) FILTER (y = 0) AS good FROM d""" for k in authorship.PORTABLE) + f") SELECT signal, round(tp / greatest(1, bad)::DOUBLE, 8) AS fires_bad, round(fp / greatest(1, good)::DOUBLE, 8) AS fires_good, round({_RATE}, 6) AS likelihood_ratio FROM c")
def signal_likelihood(g):
    """Fire rates of each portable signal among bad and good files, and their ratio (99 if it fires on bad ones only)."""
    y = F.col("y")
    files = code_files(g).select(F.col("doc_id").alias("id"), F.col("content").alias("text"), "lang").withColumn("lines", F.size(F.split("text", "\n")))
    rows = authorship.counted(files, [s for s in authorship.SIGNALS if s.name in authorship.PORTABLE])
    labels = g.table("labels").select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("y"))
    rows = rows.select("id", *[(F.round(f"`{k}`", 8) > FIRES).alias(k) for k in authorship.PORTABLE]).join(labels, "id")
    counts = F.array(*[F.struct(F.lit(k).alias("signal"), F.count_if((y == 1) & F.col(f"`{k}`")).alias("tp"), F.count_if((y == 0) & F.col(f"`{k}`")).alias("fp")) for k in authorship.PORTABLE])
    rows = rows.agg(counts.alias("x"), F.greatest(F.lit(1), F.count_if(y == 1)).alias("bad"), F.greatest(F.lit(1), F.count_if(y == 0)).alias("good")).select("bad", "good", F.inline("x"))
    bad, good = F.col("tp") / F.col("bad"), F.col("fp") / F.col("good")
    ratio_ = F.when(F.col("fp") > 0, bad / good).when(F.col("tp") > 0, 99.0).otherwise(1.0)
    return rows.select("signal", F.round(bad, 8).alias("fires_bad"), F.round(good, 8).alias("fires_good"), F.round(ratio_, 6).alias("likelihood_ratio"))


@query("score_percentiles", f"WITH {_SCORED} SELECT y, " + ", ".join(f"round(quantile_cont(score, {p / 100}), 8) AS p{p}" for p in (10, 25, 50, 75, 90)) + " FROM scored GROUP BY 1")
def score_percentiles(g):
    """Percentiles with linear interpolation."""
    p = F.percentile("score", F.array(*[F.lit(x / 100) for x in (10, 25, 50, 75, 90)]))
    return scored(g).groupBy("y").agg(p.alias("p")).select("y", *[F.round(F.col("p")[i], 8).alias(f"p{x}") for i, x in enumerate((10, 25, 50, 75, 90))])
