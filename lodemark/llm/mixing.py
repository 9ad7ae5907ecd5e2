"""Mixing sources to target weights, down a tree of domain, language and source.

A budget of tokens starts at the root. Each node shares its budget among its children by
weight, but gives none more than its subtree can supply (its tokens times ``max_epochs``);
what a child cannot take goes to its siblings, and only what all of them cannot take is
left to the parent's siblings, because a node never receives more than it can supply. That
is a water-filling with a closed form over a sort by capacity / weight, so it is three
window queries over one row for each leaf. A leaf's documents are then taken in seeded
epochs: whole epochs first, then the longest prefix, in the order of a seeded hash, whose
tokens fit what is left.

The prefix is found in two steps that no hot leaf can overload: token sums of 4096 ranges
of the hash (aggregated before the shuffle), then of the single hashes in the one range
where the budget ends.

Defined results: tokens are words (runs without blanks), a null text has none. A null
language or source is the node ``unknown``. Rows that share a doc_id stand at one place of
the order and are taken or left together. A weight of 0, or below, takes nothing. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpointed, md5_long

SEED = 20240601
#: Part of all tokens that the mix asks for, and how often a document may be used at most.
SHARE, MAX_EPOCHS = 0.5, 2
#: Target weights: a node that is not named has DEFAULT_WEIGHT.
DOMAIN_WEIGHTS = {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}
LANG_WEIGHTS = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}
SOURCE_WEIGHTS: dict[str, float] = {"src0": 1.0}
DEFAULT_WEIGHT = 1.0
LEAF = ["domain", "lang", "source"]
#: Hashes have 60 bits; their upper 12 are the range.
RANGE_SHIFT = 48


def domain_of(source):
    """The domain of a source: its number modulo 4; sources without a number are in d0."""
    return F.concat(F.lit("d"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(source, r"([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999")), F.lit(0)).cast("long") % 4)


def n_tokens(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weight(column: str, weights: dict[str, float]):
    out = F.lit(DEFAULT_WEIGHT)
    for name, w in sorted(weights.items()):
        out = F.when(F.col(column) == name, F.lit(float(max(0.0, w)))).otherwise(out)
    return out


def keyed(docs: DataFrame, *more) -> DataFrame:
    """The leaf and the id of each row, with ``more``."""
    source = F.coalesce(F.col("source"), F.lit("unknown"))
    return docs.select(domain_of(source).alias("domain"), F.coalesce(F.col("lang"), F.lit("unknown")).alias("lang"), source.alias("source"), "doc_id", *more)


def fill(children: DataFrame, parent: list[str], weight, budget) -> DataFrame:
    """``children`` (with ``cap``) and ``quota``: the parent's ``budget`` filled in by weight."""
    rows = children.withColumn("w", weight).withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0.0))
    rows = rows.withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(0.0)).withColumn("budget", budget)
    keys = [c for c in LEAF if c in children.columns]
    own = Window.partitionBy(*parent, F.lit(0)).orderBy("ratio", *keys)
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("cap_upto", F.sum("cap").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("w_after", F.sum("w").over(whole) - F.sum("w").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("is_full", F.col("cap_upto") + F.col("ratio") * F.col("w_after") <= F.col("budget") + 1e-6)
    full = F.col("is_full")
    rows = rows.withColumn("level", (F.col("budget") - F.sum(F.when(full, F.col("cap")).otherwise(0.0)).over(whole)) / F.sum(F.when(full, 0.0).otherwise(F.col("w"))).over(whole))
    return rows.withColumn("quota", F.when(full, F.col("cap")).otherwise(F.greatest(F.lit(0.0), F.least(F.col("cap"), F.col("level") * F.col("w")))))


def quotas(leaves: DataFrame, share: float, max_epochs: int) -> DataFrame:
    """domain, lang, source, tokens, whole epochs and the tokens left for the last one.

    A node's capacity counts only what children of positive weight can supply.
    """
    live = (_weight("lang", LANG_WEIGHTS) > 0) & (_weight("source", SOURCE_WEIGHTS) > 0)
    leaves = leaves.withColumn("cap", F.when(live, F.col("tokens") * float(max_epochs)).otherwise(0.0))
    total = leaves.agg((F.sum("tokens") * share).alias("ask"))
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).crossJoin(F.broadcast(total))
    domains = fill(domains, [], _weight("domain", DOMAIN_WEIGHTS), F.col("ask")).select("domain", F.col("quota").alias("above"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains, "domain")
    langs = fill(langs, ["domain"], _weight("lang", LANG_WEIGHTS), F.col("above")).select("domain", "lang", F.col("quota").alias("above"))
    out = fill(leaves.join(langs, ["domain", "lang"]), ["domain", "lang"], _weight("source", SOURCE_WEIGHTS), F.col("above"))
    quota = F.floor(F.col("quota") + 1e-6).cast("long")
    whole = F.when(F.col("tokens") > 0, F.floor(quota / F.col("tokens"))).otherwise(0).cast("long")
    return out.select(*LEAF, "tokens", quota.alias("quota"), whole.alias("whole")).withColumn("rest", F.col("quota") - F.col("whole") * F.col("tokens"))


def place(epoch, seed: int):
    return md5_long(str(seed), epoch, F.col("doc_id"))


def plan(docs: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The keyed token counts of all rows, and for each leaf its epochs and last place.

    Only the first reads texts; both are written to the checkpoint folder. The leaves are
    as many as the tree has, whatever the number of documents.
    """
    counts = checkpointed(keyed(docs, n_tokens(F.col("text")).alias("n_tokens")))
    leaves = counts.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    leaves = checkpointed(quotas(leaves, share, max_epochs))
    last = counts.join(small(leaves.where("rest > 0")), LEAF).select(*LEAF, "rest", "n_tokens", place(F.col("whole"), seed).alias("h"))
    last = last.withColumn("range", F.shiftright("h", RANGE_SHIFT))
    upto = Window.partitionBy(*LEAF).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = last.groupBy(*LEAF, "rest", "range").agg(F.sum("n_tokens").alias("t")).withColumn("upto", F.sum("t").over(upto))
    # The first range in which the budget is passed; none if all of the leaf fits.
    end = checkpointed(ranges.where("upto > rest").groupBy(*LEAF).agg(F.min_by(F.struct("range", (F.col("upto") - F.col("t")).alias("before")), "range").alias("e")).select(*LEAF, F.col("e.range").alias("range"), F.col("e.before").alias("before")))
    inside = last.join(small(end), [*LEAF, "range"]).groupBy(*LEAF, "rest", "before", "h").agg(F.sum("n_tokens").alias("t"))
    inside = inside.withColumn("upto", F.col("before") + F.sum("t").over(Window.partitionBy(*LEAF).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.groupBy(*LEAF).agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("h"))).alias("h_end"))
    leaves = leaves.join(end, LEAF, "left").join(inside, LEAF, "left")
    start = F.shiftleft(F.col("range"), RANGE_SHIFT) - 1
    h_last = F.when(F.col("rest") <= 0, F.lit(-1)).when(F.col("range").isNull(), F.lit((1 << 60) - 1)).otherwise(F.coalesce(F.col("h_end"), start)).cast("long")
    return counts, checkpointed(leaves.select(*LEAF, "tokens", "quota", "whole", h_last.alias("h_last")))


def small(leaves: DataFrame) -> DataFrame:
    """With a broadcast hint if the leaves are counted to be few; joined by key otherwise."""
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_ROWS else leaves


def taken(rows: DataFrame, leaves: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` (keyed) once for each epoch that takes them, with ``epoch`` from 0 on."""
    rows = rows.join(small(leaves.select(*LEAF, "whole", "h_last")), LEAF)
    n = F.col("whole") + F.when(place(F.col("whole"), seed) <= F.col("h_last"), 1).otherwise(0)
    return rows.withColumn("_n", n).where("_n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n", "whole", "h_last")


def mix(docs: DataFrame, **how) -> DataFrame:
    """domain, lang, source, doc_id, n_tokens, epoch of each document taken, in each epoch."""
    counts, leaves = plan(docs, **how)
    return taken(counts, leaves, how.get("seed", SEED))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns as they were, once for each epoch that takes them."""
    _, leaves = plan(docs, **how)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return taken(keyed(docs, row), leaves, how.get("seed", SEED)).select("_row.*")


def _case(column: str, weights: dict[str, float]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {float(max(0.0, v))!r}" for k, v in sorted(weights.items())) + f" ELSE {DEFAULT_WEIGHT!r} END"


def _fill_sql(table: str, parent: str, keys: str, weight: str, budget: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""
    SELECT *, CASE WHEN is_full THEN cap ELSE greatest(0.0, least(cap, level * w)) END AS quota FROM (
    SELECT *, (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part})) / nullif(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}), 0) AS level FROM (
    SELECT *, sum(cap) OVER a + ratio * (sum(w) OVER ({part}) - sum(w) OVER a) <= budget + 1e-6 AS is_full FROM (
    SELECT *, CASE WHEN w > 0 THEN cap / w ELSE 0.0 END AS ratio FROM (
    SELECT * REPLACE (CASE WHEN {weight} > 0 THEN cap ELSE 0.0 END AS cap), {weight} AS w, {budget} AS budget FROM {table}))
    WINDOW a AS ({part} ORDER BY ratio, {keys} ROWS UNBOUNDED PRECEDING)))"""


def oracle_sql(share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """The same mix in DuckDB's SQL, with one running sum for each leaf."""
    lang, source = _case("lang", LANG_WEIGHTS), _case("source", SOURCE_WEIGHTS)
    return f"""
    WITH counts AS (
      SELECT 'd' || (coalesce(try_cast(nullif(regexp_extract(coalesce(source, 'unknown'), '([0-9]{{1,9}})$', 1), '') AS BIGINT), 0) % 4) AS domain,
        coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, doc_id,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
      FROM documents),
    leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens,
        CASE WHEN {lang} > 0 AND {source} > 0 THEN sum(n_tokens)::DOUBLE * {max_epochs} ELSE 0.0 END AS cap FROM counts GROUP BY domain, lang, source),
    domains AS (SELECT domain, sum(cap) AS cap FROM leaves GROUP BY domain),
    domain_q AS ({_fill_sql("domains", "", "domain", _case("domain", DOMAIN_WEIGHTS), f"(SELECT sum(tokens)::DOUBLE * {share} FROM leaves)")}),
    langs AS (SELECT l.domain, l.lang, sum(l.cap) AS cap, any_value(q.quota) AS above FROM leaves l JOIN domain_q q USING (domain) GROUP BY l.domain, l.lang),
    lang_q AS ({_fill_sql("langs", "domain", "lang", lang, "above")}),
    sources AS (SELECT l.*, q.quota AS above FROM leaves l JOIN lang_q q USING (domain, lang)),
    source_q AS ({_fill_sql("sources", "domain, lang", "source", source, "above")}),
    ends AS (SELECT domain, lang, source, whole, q - whole * tokens AS rest FROM (
      SELECT *, CASE WHEN tokens > 0 THEN q // tokens ELSE 0 END AS whole FROM (SELECT *, floor(quota + 1e-6)::BIGINT AS q FROM source_q))),
    placed AS (SELECT c.*, whole, rest, ('0x' || substr(md5('{seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM counts c JOIN ends USING (domain, lang, source)),
    prefixed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto FROM placed)
    SELECT domain, lang, source, doc_id, n_tokens, unnest(range(whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS epoch FROM prefixed"""
