"""Quality rules: a learned decision list over text statistics.

Sequential covering grows conjunctions of thresholds that pick low-quality documents out of
labelled statistics, prunes each on rows it was not grown on, and emits the accepted ones as
one ordered Spark conditional expression. All statistics are DataFrame functions, so the
main path stays in the JVM; the learner sees at most ``SAMPLE`` rows of numbers.

Defined results: a null text counts as empty (no words, base_failed). Repeated rows give
repeated result rows. With no usable labels, or none of either class, the list is empty and
only the base rule rejects. Columns besides doc_id and text are never read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, one_each

#: Labelled rows that the learner sees at most.
SAMPLE = 20_000
#: Thresholds tried for each feature: so many quantiles of its values.
CUTS = 24
#: Conditions in a rule, and rules in the list, at most.
MAX_CONDITIONS, MAX_RULES = 4, 12
#: A rule is taken only if so much of what it picks among the pruning rows is low quality.
MIN_PRECISION = 0.9

#: The ratios that rules may test, from the counts of :func:`statistics`.
FEATURES = {
    "words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "pipes": "n_pipes / greatest(n_words, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
    "digits": "n_digits / greatest(n_chars_all, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
}

#: Positions of the 3-word windows of ``_words`` are packed below their hashes, in ``_bits`` bits.
_WINDOWS = "transform(sequence(0, size(_words) - 3), i -> shiftleft(xxhash64(_words[i], _words[i + 1], _words[i + 2]), _bits) | cast(i as bigint))"
_AT = "_words[int(_sorted[{0}] & _mask) + {1}]"
_SAME = " and ".join(["(shiftright(_sorted[{a}], _bits) = shiftright(_sorted[{b}], _bits)", *[f"{_AT.format('{a}', i)} = {_AT.format('{b}', i)}" for i in range(3)]]) + ")"


def statistics(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns of ``more`` and counts of each whole text.

    Words are maximal runs without blanks (space, tab to carriage return). Windows of three
    words are sorted by a hash that carries their position, so equal ones are neighbours;
    neighbours are compared word by word, so the hash decides nothing alone.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    blanks = " \t\n\x0b\x0c\r"
    rows = docs.select("doc_id", *more, text.alias("_text"))
    rows = rows.withColumn("_words", F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.translate(x, blanks, "") != ""))
    rows = rows.withColumn("_bits", F.expr("int(ceil(log2(size(_words) + 1)))"))
    rows = rows.withColumn("_mask", F.expr("shiftleft(1L, _bits) - 1"))
    rows = rows.withColumn("_sorted", F.expr(f"case when size(_words) > 3 then sort_array({_WINDOWS}) else array() end"))
    before, after = _SAME.format(a="k - 1", b="k"), _SAME.format(a="k", b="k + 1")
    rows = rows.withColumn("_found", F.expr(f"filter(_sorted, (x, k) -> (k > 0 and {before}) or (k < size(_sorted) - 1 and {after}))"))
    covered = "aggregate(sort_array(transform(_found, x -> x & _mask)), struct(0L as n, 0L as e), (s, p) -> struct(s.n + 3 - greatest(0L, s.e - p) as n, p + 3 as e), s -> s.n)"
    length = lambda drop: F.length("_text") - F.length(F.translate("_text", drop, ""))
    return rows.select(
        "doc_id",
        *more,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", blanks, "")).cast("long").alias("word_chars"),
        length("#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        length("|").cast("long").alias("n_pipes"),
        length(".!?").cast("long").alias("n_stops"),
        length("0123456789").cast("long").alias("n_digits"),
        F.length("_text").cast("long").alias("n_chars_all"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
    )


def with_features(stats: DataFrame) -> DataFrame:
    return stats.select("*", *[F.expr(f"coalesce(double({e}), 0D)").alias(f"f_{k}") for k, e in FEATURES.items()])


def base_failed():
    n = F.col("n_words")
    return (n < 50) | (F.col("n_repeat_words") * 100 > n * 50)


def learn(rows: list[tuple[list[float], int]]) -> list[list[tuple[str, str, float]]]:
    """Rules, in order, each a list of (feature, ``<=`` or ``>``, threshold) that all must hold.

    ``rows`` holds the features in the order of FEATURES and 1 for low quality. Every third
    row is kept for pruning. Ties between conditions go to the first feature, then ``<=``,
    then the smaller threshold, so equal input gives equal rules.
    """
    names = list(FEATURES)
    cuts = []
    for k in range(len(names)):
        values = sorted({x[k] for x, _ in rows})
        step = max(1, len(values) // CUTS)
        cuts.append([(a + b) / 2 for a, b in zip(values, values[1:], strict=False)][step // 2 :: step] if len(values) > 1 else [])
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    holds = lambda x, rule: all((x[k] <= t) if op == "<=" else (x[k] > t) for k, op, t in rule)
    out = []
    while len(out) < MAX_RULES:
        inside, rule = grow, []
        while len(rule) < MAX_CONDITIONS:
            p, n = sum(y for _, y in inside), sum(1 - y for _, y in inside)
            if not p or not n:
                break
            best, now = None, math.log2(p / (p + n))
            for k, each in enumerate(cuts):
                ordered = sorted((x[k], y) for x, y in inside)
                below, i, low_p = [], 0, 0
                for t in each:
                    while i < len(ordered) and ordered[i][0] <= t:
                        low_p += ordered[i][1]
                        i += 1
                    below.append((t, low_p, i - low_p))
                for t, bp, bn in below:
                    for op, a, b in (("<=", bp, bn), (">", p - bp, n - bn)):
                        if a and (gain := a * (math.log2(a / (a + b)) - now)) > 1e-9 and (best is None or gain > best[0] + 1e-12):
                            best = (gain, (k, op, t))
            if best is None:
                break
            rule.append(best[1])
            inside = [r for r in inside if holds(r[0], rule)]
        if not rule:
            break
        options = []
        for size in range(1, len(rule) + 1):
            hit = [y for x, y in prune if holds(x, rule[:size])]
            worth = (2 * sum(hit) - len(hit)) / len(hit) if hit else -1
            options.append((worth, sum(hit), -size))
        worth, good, size = max(options)
        rule = rule[:-size]
        if good < 2 or (worth + 1) / 2 < MIN_PRECISION:
            break
        out.append([(names[k], op, t) for k, op, t in rule])
        grow = [r for r in grow if not holds(r[0], rule)]
        prune = [r for r in prune if not holds(r[0], rule)]
    return out


def learn_from(docs: DataFrame, labels: DataFrame) -> list[list[tuple[str, str, float]]]:
    """The rules for ``docs``, from at most SAMPLE of its labelled rows."""
    sample = labelled_sample(docs, labels, "quality", SAMPLE)
    rows = with_features(statistics(one_each(docs.select("doc_id", "text"), sample), "label"))
    got = rows.select("doc_id", "label", base_failed(), *[f"f_{k}" for k in FEATURES]).collect()
    return learn([(list(r[3:]), int(r[1] == 0)) for r in sorted(got, key=lambda r: r[0]) if not r[2]])


def verdict(rules: list[list[tuple[str, str, float]]]):
    """The decision list as one conditional expression: true for a document to keep."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for name, op, t in rule:
            test = test & ((F.col(f"f_{name}") <= t) if op == "<=" else (F.col(f"f_{name}") > t))
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of ``docs``."""
    rules = learn_from(docs, labels)
    return _judged(with_features(statistics(docs)), rules)


def _judged(rows: DataFrame, rules) -> DataFrame:
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"),
    )


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they were, that the base rule and the list keep."""
    rules = learn_from(docs, labels)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = with_features(statistics(docs.select("doc_id", "text", row), "_row"))
    # The row number keeps the filter above the statistics: pushed below, it would repeat them for each word.
    rows = rows.select("_row", (~base_failed() & verdict(rules)).alias("_kept"), F.monotonically_increasing_id().alias("_n"))
    return rows.where(F.col("_kept") & (F.col("_n") >= 0)).select("_row.*")
