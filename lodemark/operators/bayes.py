"""Naive Bayes over code: subtokens, structural features, bigram entropy and keyword ratios.

The weights are fixed; a labelled example moves priors and the likelihoods of its subtokens by a
small rate. Updates of different examples add up, so any number of them is one aggregate.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from .authorship import ascii_borders

# Log likelihoods of subtokens (people, machines).
SUBTOKENS = {
    "result": (-3.5, -2.0), "response": (-3.8, -2.2), "error": (-3.0, -2.0), "validate": (-4.2, -2.8), "handle": (-4.0, -2.5), "process": (-3.9, -2.6), "sanitize": (-5.0, -3.2), "handler": (-4.5, -3.0), "payload": (-4.8, -3.1), "config": (-3.8, -2.4),
    "service": (-4.2, -2.8), "manager": (-4.6, -3.2), "repository": (-5.2, -3.5), "interface": (-4.1, -2.6), "implement": (-4.8, -3.0), "ensure": (-5.5, -3.8), "utilize": (-6.0, -4.2), "leverage": (-6.5, -4.8), "maintain": (-5.0, -3.5), "retrieve": (-5.2, -3.6),
    "format": (-4.0, -2.8), "status": (-3.8, -2.5), "success": (-4.2, -2.8), "message": (-3.6, -2.3), "create": (-3.5, -2.2), "update": (-3.5, -2.3), "delete": (-4.0, -2.8), "fetch": (-4.2, -2.7), "async": (-3.0, -1.8), "await": (-2.8, -1.6),
}
# Keywords more frequent with machines, and with people; the first eighteen count for machines.
KEYWORDS = "await const interface readonly optional void undefined null typeof instanceof implements abstract override satisfies declare namespace enum tuple".split()
HUMAN_KEYWORDS = "var this prototype callback arguments that self closure mixin jquery".split()
# Means and deviations of the twelve structural features.
MEAN_AI, SIGMA_AI = [0.12, 0.20, 0.45, 0.25, 0.28, 0.22, 0.30, 0.38, 0.30, 0.55, 0.22, 0.40], [0.08, 0.10, 0.25, 0.20, 0.15, 0.15, 0.20, 0.15, 0.20, 0.25, 0.12, 0.25]
MEAN_HUMAN, SIGMA_HUMAN = [0.25, 0.35, 0.60, 0.15, 0.45, 0.50, 0.20, 0.15, 0.50, 0.65, 0.40, 0.10], [0.15, 0.20, 0.30, 0.15, 0.25, 0.30, 0.15, 0.12, 0.30, 0.30, 0.20, 0.12]
PRIOR_AI, EXAMPLES, RATE, RARE = 0.45, 500, 0.05, 0.001
#: Weight of the structural part, of the ratios of keywords, of the heuristic score in the blend, and the margin of full confidence.
STRUCTURE, KEYWORD, HEURISTIC, DECISIVE = 0.3, 10, 0.60, 20

#: Measures that a structural feature may be made of; files without a parse have the defaults.
METRICS = {"cyclomatic": 1.0, "nesting": 0.0, "functions": 0.0, "classes": 0.0, "mean_lines": 0.0, "max_lines": 0.0, "callbacks": 0.0, "comments": 0.0, "halstead": 0.0, "loc": 0.0}
#: The features over those measures, in the order of the means.
FEATURES = [
    "least(1, cyclomatic / 50)", "least(1, nesting / 10)", "least(1, functions / 20)", "least(1, classes / 5)", "least(1, mean_lines / 30)", "least(1, max_lines / 100)", "least(1, callbacks / 5)", "comments", "least(1, halstead / 5000)", "least(1, loc / 300)",
    "CASE WHEN functions > 0 THEN least(1, cyclomatic / functions / 5) ELSE 0 END", "CASE WHEN comments > 0.3 THEN least(1, (comments - 0.3) / 0.4) ELSE 0 END",
]


def gaussian(mean: list[float], sigma: list[float]) -> str:
    """SQL of the log likelihood of all structural features."""
    return " + ".join(f"-0.5 * power((({x}) - {m}) / {s}, 2) - {math.log(s * math.sqrt(2 * math.pi))!r}" for x, m, s in zip(FEATURES, mean, sigma, strict=True))


def subtokens(text: Column) -> Column:
    """Lower-case parts of all identifiers, by underscores and capitals, of two letters or more."""
    names = F.regexp_extract_all(text, F.lit(ascii_borders(r"\b[a-zA-Z_]\w*\b")), 0)
    spaced = F.regexp_replace(F.regexp_replace(F.array_join(names, "_"), "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(spaced), "_+"), lambda x: F.length(x) >= 2)


_WORD, _EVIDENCE = re.compile(r"\w+", re.A), {k: ai - human for k, (human, ai) in SUBTOKENS.items()}
_CAPITALS, _HUMPS, _JOINTS = re.compile("([A-Z]+)([A-Z][a-z])"), re.compile("([a-z0-9])([A-Z])"), re.compile("_+")
_TOLD = {"words": pa.int32(), "machine": pa.int32(), "human_words": pa.int32(), "parts": pa.int32(), "weights": pa.float64(), "tokens": pa.int32(), "kinds": pa.int32(), "runs": pa.float64()}


def told(text: str) -> tuple:
    """Words, keywords of both sides, parts of identifiers and their weights, tokens, kinds of bigrams and their n log2(n).

    Borders of words lie between ASCII letters, so identifiers and keywords are whole words.
    """
    words = _WORD.findall(text)
    spaced = _HUMPS.sub(r"\1_\2", _CAPITALS.sub(r"\1_\2", "_".join([w for w in words if not w[0].isdigit()])))
    parts = [x for x in _JOINTS.split(spaced.lower()) if len(x) >= 2]
    tokens = [w.lower() for w in words if len(w) > 1]
    pairs = Counter([f"{x}_{y}" for x, y in pairwise(tokens)])
    return (
        len(words), sum(w in _MACHINE for w in words), sum(w in _PEOPLE for w in words), len(parts), math.fsum(_EVIDENCE.get(x, 0.0) for x in parts),
        len(tokens), len(pairs), math.fsum(n * math.log2(n) for n in pairs.values()),
    )


_MACHINE, _PEOPLE = frozenset(KEYWORDS), frozenset(HUMAN_KEYWORDS)


def _tallied(files: DataFrame) -> DataFrame:
    own = files.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "text"] + [f"{k} {'double' if v == pa.float64() else 'int'}" for k, v in _TOLD.items()])

    def read(batches):
        for batch in batches:
            found = list(zip(*map(told, batch.column(own.index("text")).to_pylist()), strict=True)) if batch.num_rows else [[]] * len(_TOLD)
            kept = [c for c in own if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(own.index(c)) for c in kept), *(pa.array(x, k) for x, k in zip(found, _TOLD.values(), strict=True))], [*kept, *_TOLD])

    small_batches(files.sparkSession)
    return files.mapInArrow(read, schema)


def classify(files: DataFrame, key: str, heuristic: Column | None = None) -> DataFrame:
    """(key, probability, blended, confidence, structural) of files (key, text and any of METRICS)."""
    rows = files.withColumn("text", F.coalesce("text", F.lit("")))
    for name, default in METRICS.items():
        if name not in files.columns:
            own = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("double") if name == "loc" else F.lit(default)
            rows = rows.withColumn(name, own)
    rows = _tallied(rows.select(key, "text", *METRICS))
    rows = rows.withColumn("evidence", F.expr("weights / greatest(1, parts)"))
    rows = rows.withColumn("entropy", F.expr("CASE WHEN tokens < 20 OR kinds < 2 THEN 1D ELSE least(1D, (log2(tokens - 1) - runs / (tokens - 1)) / log2(kinds)) END"))
    rows = rows.withColumn("kw", (F.col("machine") / F.greatest(F.lit(1), F.col("words")) - F.col("human_words") / F.greatest(F.lit(1), F.col("words"))) * KEYWORD).withColumn("ai", F.expr(f"double({gaussian(MEAN_AI, SIGMA_AI)})")).withColumn("human", F.expr(f"double({gaussian(MEAN_HUMAN, SIGMA_HUMAN)})"))
    # Only the difference of the two log likelihoods matters; subtokens without a weight cancel out.
    margin = F.lit(math.log(PRIOR_AI / (1 - PRIOR_AI))) + F.col("evidence") + (F.col("ai") - F.col("human")) * STRUCTURE + 2 - F.col("entropy") * 4 + F.col("kw")
    probability = 1 / (1 + F.exp(-F.col("margin")))
    h = F.lit(0.5) if heuristic is None else heuristic
    rows = rows.withColumn("margin", margin)
    return rows.select(key, probability.alias("probability"), (h * HEURISTIC + probability * (1 - HEURISTIC)).alias("blended"), F.least(F.lit(1.0), F.abs("margin") / DECISIVE).alias("confidence"), (1 / (1 + F.exp(F.col("human") - F.col("ai")))).alias("structural"))


def updated(examples: DataFrame) -> DataFrame:
    """(token, human, ai): likelihoods after the labelled ``examples`` (text, is_ai), of the tokens they move.

    A token's frequency in its example counts from RARE on; unknown ones start at -5.
    """
    rows = examples.select(F.monotonically_increasing_id().alias("row"), "is_ai", subtokens(F.coalesce("text", F.lit(""))).alias("parts"))
    rows = rows.select("row", "is_ai", F.size("parts").alias("n"), F.explode("parts").alias("token"))
    rows = rows.groupBy("row", "is_ai", "n", "token").agg((F.count("*") / F.col("n")).alias("f")).where(F.col("f") >= RARE)
    moved = rows.groupBy("token").agg(*[F.sum(F.when(F.col("is_ai") == flag, F.col("f")).otherwise(0.0)).alias(name) for name, flag in (("h", False), ("a", True))])
    start = lambda k: F.expr("CASE token " + " ".join(f"WHEN '{t}' THEN {v[k]}D" for t, v in SUBTOKENS.items()) + " ELSE -5D END")
    return moved.select("token", (start(0) + F.col("h") * RATE).alias("human"), (start(1) + F.col("a") * RATE).alias("ai"))
