"""Sequences and graphs: bursts, hash chains, baselines, import graphs, dependencies."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import iterate
from .registry import query

def commits(g) -> DataFrame:
    return g.table("events").select("event_id", "user_id", "ts", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))


@query("commit_bursts", f"SELECT user_id, max(n) AS max_per_hour FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 3599 FOLLOWING) AS n FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)) GROUP BY 1")
def commit_bursts(g):
    """Most commits of an author in any hour that starts at a commit."""
    hour = Window.partitionBy("user_id").orderBy("s").rangeBetween(Window.currentRow, 3599)
    return commits(g).withColumn("n", F.count("*").over(hour)).groupBy("user_id").agg(F.max("n").alias("max_per_hour"))


@query("author_gaps", "SELECT user_id, count(*) AS commits, round(epoch(max(ts) - min(ts)) / nullif(count(*) - 1, 0), 4) AS mean_gap_s FROM events GROUP BY 1")
def author_gaps(g):
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return g.table("events").groupBy("user_id").agg(F.count("*").alias("commits"), F.round(span / F.nullif(F.count("*") - 1, F.lit(0)), 4).alias("mean_gap_s"))


@query("provenance_risk", """SELECT user_id, round(0.30 * unsigned + least(0.70, 0.20 * (burst >= 5)::INT + 0.08 * (gap < 60)::INT + 0.02 * (nights > 0.5)::INT), 6) AS score FROM (SELECT user_id, avg((value <= 10)::INT) AS unsigned, avg((hour(ts) < 6)::INT) AS nights, coalesce(epoch(max(ts) - min(ts)) / nullif(count(*) - 1, 0), 1e9) AS gap FROM events GROUP BY 1)
    JOIN (SELECT user_id, max(n) AS burst FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 3599 FOLLOWING) AS n FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)) GROUP BY 1) USING (user_id)""")
def provenance_risk(g):
    """Risk of an author's history: unsigned share, bursts, tiny gaps, night work."""
    own = commits(g).groupBy("user_id").agg(
        F.avg((F.col("value") <= 10).cast("int")).alias("unsigned"), F.avg((F.hour("ts") < 6).cast("int")).alias("nights"),
        F.coalesce((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6 / F.nullif(F.count("*") - 1, F.lit(0)), F.lit(1e9)).alias("gap"),
    )
    rows = own.join(commit_bursts(g), "user_id")
    points = lambda test, n: F.when(test, n).otherwise(0.0)
    score = F.col("unsigned") * 0.30 + F.least(F.lit(0.70), points(F.col("max_per_hour") >= 5, 0.20) + points(F.col("gap") < 60, 0.08) + points(F.col("nights") > 0.5, 0.02))
    return rows.select("user_id", F.round(score, 6).alias("score"))


def chained(rows: DataFrame, key: str, order: str, payload: str, genesis: str = "GENESIS", ordered: bool = True) -> DataFrame:
    """(key, order, payload, prev_hash, entry_hash): each entry hashes the one before it, its place if ``ordered``, and its payload.

    A chain is sequential by nature, so a sorted stream of each key's entries is folded as it
    passes; nothing of a chain is held but its last hash.
    """

    def link(batches):
        last, hash_ = object(), ""
        for batch in batches:
            before, after = [], []
            for k, o, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != last:
                    last, hash_ = k, genesis
                before.append(hash_)
                hash_ = hashlib.sha256((f"{hash_}:{o}:{p}" if ordered else f"{hash_}:{p}").encode()).hexdigest()
                after.append(hash_)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], [key, order, payload, "prev_hash", "entry_hash"])

    rows = rows.select(key, order, payload)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", prev_hash string, entry_hash string"
    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(link, schema)


def verify_chain(rows: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """(key, entries, valid, first_broken): entries against their own content and the one before.

    Verification is not sequential: each entry is tested against stored hashes with one lag.
    """
    before = F.coalesce(F.lag("entry_hash").over(Window.partitionBy(key).orderBy(order)), F.lit("GENESIS"))
    again = F.sha2(F.concat_ws(":", F.col("_before"), F.col(order), F.col(payload)), 256)
    bad = (F.col("prev_hash") != F.col("_before")) | (F.col("entry_hash") != again)
    rows = rows.withColumn("_before", before)
    return rows.groupBy(key).agg(F.count("*").alias("entries"), (F.count_if(bad) == 0).alias("valid"), F.min(F.when(bad, F.col(order))).alias("first_broken"))


@query("chain_verify", "SELECT user_id, count(*) AS entries, count(*) FILTER (event_id % 97 = 0) = 0 AS valid, min(event_id) FILTER (event_id % 97 = 0) AS first_broken FROM events GROUP BY 1")
def chain_verify(g):
    """Chains of each user's events, some payloads altered afterwards: the first broken entry."""
    rows = g.table("events").select("user_id", "event_id", F.concat_ws("|", "event_type", "props").alias("payload"))
    stored = chained(rows, "user_id", "event_id", "payload")
    stored = stored.withColumn("payload", F.when(F.col("event_id") % 97 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return verify_chain(stored, "user_id", "event_id", "payload")


@query("rolling_chain", "SELECT scan_id, list_reduce(list_prepend('SEED', list(file_path || ':' || line_count ORDER BY file_path)), lambda a, x: sha256(a || '::' || x)) AS seal FROM scan_files GROUP BY 1")
def rolling_chain(g):
    """A seal over each scan's files in order of path."""
    files = g.scan_files.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("file_path", "line_count"))).alias("f"))
    seal = F.aggregate("f", F.lit("SEED"), lambda a, x: F.sha2(F.concat_ws("::", a, F.concat_ws(":", x["file_path"], x["line_count"])), 256))
    return files.select("scan_id", seal.alias("seal"))


@query("attestation_hash", "SELECT scan_id, file_path, sha256(scan_id || '::' || file_path || '::' || reviewer || '::' || risk) AS payload_hash FROM attestations")
def attestation_hash(g):
    return g.attestations.select("scan_id", "file_path", F.sha2(F.concat_ws("::", "scan_id", "file_path", "reviewer", "risk"), 256).alias("payload_hash"))


@query("baseline_ema", "SELECT user_id, count(*) AS n, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x, i: a + least(0.3::DOUBLE, 1.0::DOUBLE / i) * (x - a)), 6) AS ema FROM events GROUP BY 1")
def baseline_ema(g):
    """A developer's baseline: an ordered fold with a rate of 1 / n, 0.3 at most, over a sorted stream of events."""

    def fold(batches):
        last, n, ema, out = None, 0, 0.0, []
        for batch in batches:
            for user, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if user != last:
                    if n:
                        out.append((last, n, ema))
                    last, n, ema = user, 0, 0.0
                n += 1
                ema = value if n == 1 else ema + min(0.3, 1.0 / n) * (value - ema)
        if n:
            out.append((last, n, ema))
        for at in range(0, len(out), 10_000):
            users, counts, values = zip(*out[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(users, pa.int64()), pa.array(counts, pa.int64()), pa.array(values, pa.float64())], ["user_id", "n", "ema"])

    events = g.table("events").select(F.col("user_id").cast("long"), F.col("value").cast("double"), "ts", "event_id")
    events = events.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").select("user_id", "value")
    return events.mapInArrow(fold, "user_id long, n long, ema double").select("user_id", "n", F.round("ema", 6).alias("ema"))



#: Ranges that a caller passes, for packages of the test tables: first vulnerable version (or none), first fixed one, severity.
#: The surveyed ranges are those of ``business.VULNERABLE``.
CVE_RANGES = [("small ring", None, "12.2.3", "high"), ("red widget", "10.0.0", "20.0.0", "critical"), ("blue gear", None, "30.1.0", "medium"), ("steel bolt", "5.0.0", "45.2.2", "high"), ("large bolt", None, "25.0.0", "low")]


def version_key(version):
    """Three numbers of a version, missing or odd parts as 0, for comparison as an array."""
    part = F.split(F.regexp_replace(version, r"^[^0-9]*", ""), r"[.\-+]")
    return F.array(*[F.coalesce(F.try_element_at(part, F.lit(i + 1)).try_cast("int"), F.lit(0)) for i in range(3)])


def match_cves(packages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Packages (name, version) whose version lies in a range [low, high) of their name.

    The join is on the name; the range is a filter on the matches. Versions that are not
    pinned (*) count as 0, as range checks take them.
    """
    rows = packages.withColumn("v", version_key(F.col("version"))).join(F.broadcast(ranges), "name")
    inside = (F.col("v") < version_key(F.col("high"))) & (F.col("low").isNull() | (F.col("v") >= version_key(F.coalesce("low", F.lit("0")))))
    return rows.where(inside).withColumn("unpinned", F.col("version") == "*").drop("v")


@query("cve_range_match", "WITH r(name, low, high, severity) AS (VALUES " + ", ".join(f"('{n}', {repr(a) if a else 'NULL'}, '{b}', '{s}')" for n, a, b, s in CVE_RANGES) + ") SELECT p_partkey, name, severity FROM (SELECT p_partkey, p_name, [p_size::INT, 2, (p_partkey % 7)::INT] AS v FROM part) JOIN r ON name = p_name WHERE v < list_transform(string_split(high, '.'), lambda x: x::INT) AND (low IS NULL OR v >= list_transform(string_split(low, '.'), lambda x: x::INT))")
def cve_range_match(g):
    packages = g.table("part").select("p_partkey", F.col("p_name").alias("name"), F.concat_ws(".", "p_size", F.lit(2), F.col("p_partkey") % 7).alias("version"))
    ranges = g.spark.createDataFrame(CVE_RANGES, "name string, low string, high string, severity string")
    return match_cves(packages, ranges).select("p_partkey", "name", "severity")


# Names that typosquats imitate.
POPULAR = ["react", "lodash", "express", "axios", "moment", "webpack", "eslint", "jquery", "chalk", "commander"]


def typosquats(packages: DataFrame, popular=POPULAR) -> DataFrame:
    """Packages at edit distance 1 of a popular name; the list is a short constant array."""
    names = F.array(*[F.lit(p) for p in popular])
    near = F.filter(names, lambda p: F.levenshtein(F.col("name"), p) == 1)
    return packages.withColumn("imitates", F.try_element_at(near, F.lit(1))).where("imitates is not null")


_NAME = "CASE WHEN p_partkey % 10 = 0 THEN list_extract(['" + "', '".join(POPULAR) + "'], (p_partkey // 10 % 10)::INT + 1) || 'x' ELSE replace(p_name, ' ', '-') END"


@query("typosquat", f"SELECT p_partkey, name, popular AS imitates FROM (SELECT p_partkey, {_NAME} AS name FROM part) JOIN (SELECT unnest(['" + "', '".join(POPULAR) + "']) AS popular) ON levenshtein(name, popular) = 1")
def typosquat(g):
    k = F.col("p_partkey")
    mutated = F.concat(F.element_at(F.array(*[F.lit(p) for p in POPULAR]), (F.floor(k / 10) % 10 + 1).cast("int")), F.lit("x"))
    packages = g.table("part").select(k, F.when(k % 10 == 0, mutated).otherwise(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("name"))
    return typosquats(packages)


# Subjects that name a machine as the author.
MACHINE_SUBJECTS = [
    r"(?i)^(?:generated|auto-generated|ai-generated|copilot|gpt|claude|gemini)\b", r"(?i)^(?:feat|fix|chore|refactor)\(.+\):\s+(?:implement|add|update|create)\s+\w+\s+(?:with|using|via)\s+(?:AI|ChatGPT|Copilot|Claude|Gemini)", r"(?i)bulk\s+(?:generate|generated|update|commit)", r"(?i)^\[AI\]",
    r"(?i)\b(?:ChatGPT|Copilot|Claude|Gemini|Cursor)\b.*\bgenerat", r"(?i)\b(?:windsurf|devin|aider|cline|codeium|cursor\s*agent|replit\s*agent)\b", r"(?i)co-authored-by:\s*(?:claude|cursor|copilot|chatgpt|gpt|gemini|devin|windsurf|aider|cline|codeium)", r"(?i)generated with\s*\[?(?:claude code|cursor|copilot|windsurf|devin|aider|cline)\]?", "🤖",
]
_SUBJECTS = ["fix typo", "[AI] add tests", "Bulk update of files", "feat(core): add cache using Copilot", "merge"]
_MACHINE = " OR ".join("regexp_matches(subject, '" + p.replace("'", "''") + "')" for p in MACHINE_SUBJECTS)
_LOG = f"""log AS (SELECT event_id, user_id % 3 AS repo, 'n' || user_id % 2 AS name, 'u' || user_id || '@d' || (user_id + event_id % 2) % 4 AS email, CAST(floor(epoch(ts)) AS BIGINT) AS s, CASE WHEN event_id % 101 = 0 THEN 'B' WHEN value > 40 THEN 'G' ELSE 'N' END AS gpg, event_type = 'signup' AS is_merge, [{', '.join(repr(x) for x in _SUBJECTS)}][(event_id % 5)::INT + 1] AS subject FROM events),
    authors AS (SELECT repo, email, min_by(name, (s, event_id)) AS name, count(*) AS n, (max(s) - min(s)) / nullif(count(*) - 1, 0)::DOUBLE AS gap, max(w) AS burst FROM (SELECT *, count(*) OVER (PARTITION BY repo, email ORDER BY s RANGE BETWEEN CURRENT ROW AND 3599 FOLLOWING) AS w FROM log) GROUP BY 1, 2),
    rates AS (SELECT repo, count(*) FILTER (NOT is_merge) AS own, count(*) FILTER (gpg = 'G') / nullif(count(*) FILTER (NOT is_merge), 0)::DOUBLE AS signed, count(*) FILTER (NOT is_merge AND gpg = 'G') / nullif(count(*) FILTER (NOT is_merge), 0)::DOUBLE AS rate FROM log GROUP BY 1),
    risks AS (SELECT repo, 'low-signature-rate' AS kind, CASE WHEN signed < 0.2 THEN 'high' ELSE 'medium' END AS severity, 1 AS n FROM rates WHERE signed < 0.5 AND own > 5
      UNION ALL SELECT repo, 'bad-gpg-signature', 'high', count(*) FROM log WHERE gpg = 'B' GROUP BY 1 UNION ALL SELECT repo, 'burst-commit-pattern', CASE WHEN burst > 15 THEN 'high' ELSE 'medium' END, count(*) FROM authors WHERE burst > 8 GROUP BY 1, 3
      UNION ALL SELECT repo, 'machine-commit-velocity', 'medium', count(*) FROM authors WHERE n > 5 AND gap > 0 AND gap < 120 GROUP BY 1 UNION ALL SELECT repo, 'unknown-contributor', 'low', count(*) FROM authors WHERE n = 1 AND burst > 1 GROUP BY 1
      UNION ALL SELECT repo, 'ai-generated-commit', 'low', count(*) FROM log WHERE {_MACHINE} GROUP BY 1 UNION ALL SELECT repo, 'email-domain-mismatch', 'low', count(*) FROM (SELECT repo, name FROM authors GROUP BY 1, 2 HAVING count(DISTINCT split_part(email, '@', 2)) > 2) GROUP BY 1)"""


def provenance(log: DataFrame) -> DataFrame:
    """(repo, kind, severity, n): the seven risks of a log of commits.

    ``log`` has repo, name, email, s (seconds), gpg, is_merge, subject and event_id. All counts combine
    before they are shuffled; only the burst window sorts an author's commits.
    """
    hour = Window.partitionBy("repo", "email").orderBy("s").rangeBetween(Window.currentRow, 3599)
    authors = log.withColumn("w", F.count("*").over(hour)).groupBy("repo", "email").agg(
        F.min_by("name", F.struct("s", "event_id")).alias("name"), F.count("*").alias("n"), ((F.max("s") - F.min("s")) / F.nullif(F.count("*") - 1, F.lit(0))).alias("gap"), F.max("w").alias("burst"),
    )
    machine = F.lit(False)
    for p in MACHINE_SUBJECTS:
        machine = machine | F.col("subject").rlike(p)
    one = log.groupBy("repo").agg(F.count_if(~F.col("is_merge")).alias("own"), F.count_if(F.col("gpg") == "G").alias("good"), F.count_if(F.col("gpg") == "B").alias("bad"), F.count_if(machine).alias("machine"))
    two = authors.groupBy("repo").agg(
        F.count_if((F.col("burst") > 8) & (F.col("burst") <= 15)).alias("some"), F.count_if(F.col("burst") > 15).alias("many"), F.count_if((F.col("n") > 5) & (F.col("gap") > 0) & (F.col("gap") < 120)).alias("fast"), F.count_if((F.col("n") == 1) & (F.col("burst") > 1)).alias("new"),
    )
    names = authors.groupBy("repo", "name").agg(F.count_distinct(F.split("email", "@")[1]).alias("domains")).groupBy("repo").agg(F.count_if(F.col("domains") > 2).alias("mixed"))
    signed = F.col("good") / F.nullif(F.col("own"), F.lit(0))
    risk = lambda kind, severity, n: F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), n.cast("long").alias("n"))
    low, medium, high = F.lit("low"), F.lit("medium"), F.lit("high")
    every = F.array(
        risk("low-signature-rate", F.when(signed < 0.2, "high").otherwise("medium"), F.coalesce(((signed < 0.5) & (F.col("own") > 5)).cast("int"), F.lit(0))), risk("bad-gpg-signature", high, F.col("bad")), risk("burst-commit-pattern", medium, F.col("some")),
        risk("burst-commit-pattern", high, F.col("many")), risk("machine-commit-velocity", medium, F.col("fast")), risk("unknown-contributor", low, F.col("new")), risk("ai-generated-commit", low, F.col("machine")), risk("email-domain-mismatch", low, F.col("mixed")),
    )
    return one.join(two, "repo").join(names, "repo").select("repo", F.inline(every)).where("n > 0")


def commit_log(g) -> DataFrame:
    """The event log as commits of three repositories."""
    k, u = F.col("event_id"), F.col("user_id")
    subject = F.element_at(F.array(*[F.lit(s) for s in _SUBJECTS]), (k % 5 + 1).cast("int"))
    gpg = F.when(k % 101 == 0, "B").when(F.col("value") > 40, "G").otherwise("N")
    return g.table("events").select("event_id", (u % 3).alias("repo"), F.concat(F.lit("n"), u % 2).alias("name"), F.concat(F.lit("u"), u, F.lit("@d"), (u + k % 2) % 4).alias("email"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), gpg.alias("gpg"), (F.col("event_type") == "signup").alias("is_merge"), subject.alias("subject"))


@query("provenance_risks", f"WITH {_LOG} SELECT repo, kind, severity, n::BIGINT AS n FROM risks")
def provenance_risks(g):
    return provenance(commit_log(g))


@query("provenance_summary", f"WITH {_LOG}, p AS (SELECT repo, sum(n * CASE severity WHEN 'high' THEN 0.20 WHEN 'medium' THEN 0.08 ELSE 0.02 END)::DOUBLE AS p FROM risks GROUP BY 1) SELECT repo, round(rate, 8) AS signed_rate, round(least(1, greatest(0, 1 - rate) * 0.30 + least(0.70, coalesce(p, 0))), 8) AS score FROM rates LEFT JOIN p USING (repo)")
def provenance_summary(g):
    """Share of signed commits, and the score: 0.30 for unsigned ones and up to 0.70 for risks by severity."""
    log = commit_log(g)
    weight = F.when(F.col("severity") == "high", 0.20).when(F.col("severity") == "medium", 0.08).otherwise(0.02)
    penalty = provenance(log).groupBy("repo").agg(F.sum(F.col("n") * weight).alias("p"))
    rates = log.where("not is_merge").groupBy("repo").agg((F.count_if(F.col("gpg") == "G") / F.count("*")).alias("rate"))
    score = F.greatest(F.lit(0.0), 1 - F.col("rate")) * 0.30 + F.least(F.lit(0.70), F.coalesce("p", F.lit(0.0)))
    return rates.join(penalty, "repo", "left").select("repo", F.round("rate", 8).alias("signed_rate"), F.round(F.least(F.lit(1.0), score), 8).alias("score"))
