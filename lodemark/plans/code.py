"""Queries over source files: each document's whole text with code of our own at its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import spread
from ..functions.checkpoint import stored
from ..operators import authorship, bayes, detectors, rules, signals, source
from .registry import query
from .samples import CODE, SNIPPETS


def _pick(values: list, modulus: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % len(values) + 1).cast("int")).alias(modulus)


def code_files(g) -> DataFrame:
    """(path, content, lang): a document's text and then the code that its id picks."""
    path = F.concat(F.lit("src/f"), "doc_id", _pick([e for e, _, _ in CODE], "e"))
    return spread(g.table("documents"), "doc_id").select("doc_id", path.alias("path"), F.concat_ws("\n", F.coalesce("text", F.lit("")), _pick([c for _, _, c in CODE], "c")).alias("content"), _pick([x for _, x, _ in CODE], "l").alias("lang"))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _one(values: list[str]) -> str:
    return "[" + ", ".join(map(_quote, values)) + f"][(doc_id % {len(values)})::INT + 1]"


_FILES = f"SELECT doc_id, 'src/f' || doc_id || {_one([e for e, _, _ in CODE])} AS path, coalesce(text, '') || chr(10) || {_one([c for _, _, c in CODE])} AS text, {_one([x for _, x, _ in CODE])} AS lang FROM documents"


def snippet_files(g) -> DataFrame:
    """(doc_id, path, content): a document's whole text as comments, then a snippet."""
    text = F.concat(F.lit("// "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n// ")))
    return g.table("documents").select("doc_id", F.concat(F.lit("src/f"), "doc_id", F.lit(".ts")).alias("path"), F.concat_ws("\n", text, _pick(["\n".join(x) for x, _ in SNIPPETS], "s")).alias("content"))


_EXPECTED = "(VALUES " + ", ".join(f"({k}, {n}, '{i}')" for k, (_, found) in enumerate(SNIPPETS) for n, i in found) + ") e(k, n, id)"


@query("detector_findings", f"SELECT 'src/f' || doc_id || '.ts' AS path, (len(string_split(coalesce(text, ''), chr(10))) + n)::INT AS line, id FROM documents JOIN {_EXPECTED} ON doc_id % {len(SNIPPETS)} = k")
def detector_findings(g):
    """All detectors over files whose comments are whole texts; the findings of the code below are known by hand."""
    return detectors.findings(snippet_files(g)).select("path", "line", "id")


@query("prose_findings")
def prose_findings(g):
    """All detectors over the lines of all documents."""
    return detectors.findings(g.table("documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")))


_TAINT, _SINK = detectors.one_of(detectors.TAINT_SOURCES), detectors.one_of(detectors.HTTP_SINKS)


@query("lookback_taint", f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM (SELECT doc_id, '// ' || replace(coalesce(text, ''), chr(10), chr(10) || '// ') || chr(10) || {_one([chr(10).join(x) for x, _ in SNIPPETS])} AS text FROM documents))
    SELECT doc_id, n::INT AS line FROM (SELECT doc_id, n, regexp_matches(line, {_quote(_SINK)}) AS sink, max(regexp_matches(line, {_quote(_TAINT)})::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS near FROM lines) WHERE sink AND near = 1""")
def lookback_taint(g):
    """Calls of a network sink with user input in the twelve lines before, as a window over each file's lines."""
    rows = detectors.lines_of(snippet_files(g), "doc_id", "content").select(F.col("path").alias("doc_id"), "line", F.col("text").rlike(_SINK).alias("sink"), F.col("text").rlike(_TAINT).cast("int").alias("source"))
    near = F.max("source").over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(-12, -1))
    return rows.withColumn("near", near).where("sink and near = 1").select("doc_id", "line")


def _tier(name: str, tier: dict[str, float]):
    portable = [k for k in authorship.PORTABLE if k in tier]
    sql = authorship.counted_sql(f"SELECT doc_id AS id, text, lang, len(string_split(text, chr(10))) AS lines FROM ({_FILES})", portable)

    @query(name, sql)
    def run(g):
        files = code_files(g).select(F.col("doc_id").alias("id"), F.col("content").alias("text"), "lang").withColumn("lines", F.size(F.split("text", "\n")))
        rows = authorship.counted(files, [s for s in authorship.SIGNALS if s.name in portable])
        return rows.select("id", *[F.round(f"`{k}`", 8).alias(k) for k in portable])

    return run


core_signals = _tier("authorship_core_signals", authorship.CORE)
secondary_signals = _tier("authorship_secondary_signals", authorship.SECONDARY)
style_signals = _tier("authorship_style_signals", authorship.STYLE)


@query("authorship_scores")
def authorship_scores(g):
    """All fifty signals and the score of each file, style drift from its thirds included."""
    return authorship.score(code_files(g).select("path", F.col("content").alias("text"), "lang"))


@query("code_risk")
def code_risk(g):
    """Risk level of each file from its real findings, firing signals and score."""
    files = code_files(g)
    return _risk(files, detectors.findings(files))


def _risk(files: DataFrame, findings: DataFrame) -> DataFrame:
    found = findings.groupBy("path").agg(F.collect_list("severity").alias("found"))
    scored = authorship.score(files.select("path", F.col("content").alias("text"), "lang"))
    fired = F.array_compact(F.array(*[F.when(F.col(f"`{k}`") > 0.15, F.when(F.col(f"`{k}`") > 0.70, "low").otherwise("info")) for k in [*authorship.CORE, *authorship.SECONDARY, *authorship.STYLE]]))
    rows = scored.select("path", "ai", fired.alias("fired")).join(found, "path", "left")
    every = F.concat("fired", F.coalesce("found", F.array().cast("array<string>")))
    return rows.select("path", F.round("ai", 8).alias("ai"), F.size(every).cast("long").alias("indicators"), signals.risk_level(every, F.col("ai")).alias("risk"))


_RULED = rules.compliance_sql(_FILES)


@query("compliance_controls", _RULED)
def compliance_controls(g):
    """Findings and status of each control of four frameworks in each file."""
    return rules.compliance(code_files(g))


@query("compliance_scores", f"""WITH c AS ({_RULED}), n AS (SELECT path, framework, count(*) FILTER (status = 'PASS') AS p, count(*) FILTER (status = 'FAIL') AS f, count(*) FILTER (status = 'WARN') AS w, count(*) AS n FROM c GROUP BY 1, 2)
    SELECT path, framework, round((p + w * 0.5) / n, 8) AS score, CASE WHEN f >= 2 THEN 'CRITICAL' WHEN f >= 1 THEN 'HIGH' WHEN w >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM n""")
def compliance_scores(g):
    rows = rules.framework_scores(rules.compliance(code_files(g)))
    return rows.select("path", "framework", F.round("score", 8).alias("score"), "risk_level")


@query("attribution_posterior", rules.attribution_sql(_FILES, "path"))
def attribution_posterior(g):
    """Shares of seven models and of people, the model that wins by a margin, and its confidence."""
    return rules.attribution(code_files(g).select("path", F.col("content").alias("text"), "lang"))


@query("code_structure")
def code_structure(g):
    """Functions, imports, branches and depth of each file, parsed in Arrow batches."""
    from ..operators import structure

    return structure.parse(code_files(g))


_IDENT = r"\b[a-zA-Z_]\w*\b"
_PARTS = f"list_filter(string_split_regex(lower(regexp_replace(regexp_replace(array_to_string(regexp_extract_all(text, '{_IDENT}'), '_'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_+'), lambda x: length(x) >= 2)"
_WEIGHT = "CASE x " + " ".join(f"WHEN '{k}' THEN {ai - human!r}::DOUBLE" for k, (human, ai) in bayes.SUBTOKENS.items()) + " ELSE 0 END"
#: The model's measures and those of ``source``; two depend on the text before the code, the others on the code that an id picks.
_MEASURED = {"cyclomatic": "complexity", "nesting": "nesting", "functions": "functions", "classes": "classes", "mean_lines": "mean_lines", "max_lines": "most_lines", "callbacks": "callbacks", "comments": "comments", "halstead": "volume", "loc": "loc"}
_OF_CODE = [source.describe("\n" + c, x)["measures"] for _, x, c in CODE]
_FILLED = "list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\r\f]'))"
_COMMENTED = f"len(list_filter({_FILLED}, lambda x: regexp_matches(x, '^\\s*(?://|#|[*]|/[*]|<!--)')))::DOUBLE / greatest(1, len({_FILLED}))"
_METRICS = ", ".join({"comments": f"{_COMMENTED} AS comments", "loc": f"len({_FILLED})::DOUBLE AS loc"}.get(k) or f"[{', '.join(str(float(m[v])) for m in _OF_CODE)}][(doc_id % {len(CODE)})::INT + 1]::DOUBLE AS {k}" for k, v in _MEASURED.items())
_RATIO = "len(regexp_extract_all(text, '\\b(?:{0})\\b')) / greatest(1, len(regexp_extract_all(text, '\\w+')))::DOUBLE * 10"


@query("nb_score", f"""WITH f AS ({_FILES}), b AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\\w+'), lambda x: lower(x)), lambda x: length(x) > 1) AS w FROM f),
    g AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) AS p FROM b WHERE len(w) >= 20), c AS (SELECT doc_id, p, count(*) AS n FROM g GROUP BY 1, 2),
    e AS (SELECT doc_id, CASE WHEN count(*) < 2 THEN 1 ELSE least(1, (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(*))) END AS e FROM c GROUP BY 1),
    m AS (SELECT doc_id, {_PARTS} AS parts, {_RATIO.format('|'.join(bayes.KEYWORDS))} - {_RATIO.format('|'.join(bayes.HUMAN_KEYWORDS))} AS kw, {_METRICS} FROM f),
    s AS (SELECT doc_id, {bayes.gaussian(bayes.MEAN_AI, bayes.SIGMA_AI)} AS ai, {bayes.gaussian(bayes.MEAN_HUMAN, bayes.SIGMA_HUMAN)} AS human, kw, coalesce(list_sum(list_transform(parts, lambda x: {_WEIGHT})), 0) / greatest(1, len(parts)) AS ev FROM m),
    z AS (SELECT doc_id, ai, human, ln(0.45::DOUBLE / 0.55::DOUBLE) + ev + (ai - human) * 0.3 + 2 - coalesce(e, 1) * 4 + kw AS margin FROM s LEFT JOIN e USING (doc_id))
    SELECT doc_id, round(1 / (1 + exp(-margin)), 6) AS probability, round(0.3 + 0.4 / (1 + exp(-margin)), 6) AS blended, round(least(1, abs(margin) / 20), 6) AS confidence, round(1 / (1 + exp(human - ai)), 6) AS structural FROM z""")
def nb_score(g):
    """Naive Bayes of each file, blended with an undecided heuristic score."""
    rows = source.measured(code_files(g)).select("doc_id", F.col("content").alias("text"), *[F.col(f"measures.{v}").cast("double").alias(k) for k, v in _MEASURED.items()])
    rows = bayes.classify(rows, "doc_id")
    return rows.select("doc_id", *[F.round(c, 6).alias(c) for c in ("probability", "blended", "confidence", "structural")])


_START = "CASE token " + " ".join(f"WHEN '{k}' THEN {{{n}}}" for n, k in enumerate(bayes.SUBTOKENS)) + " ELSE -5.0 END"


@query("nb_update", f"""WITH f AS (SELECT f.doc_id, quality = 0 AS is_ai, text FROM ({_FILES}) f JOIN labels l ON f.doc_id = l.doc_id WHERE quality IS NOT NULL), t AS (SELECT doc_id, is_ai, unnest({_PARTS}) AS token FROM f), n AS (SELECT doc_id, is_ai, token, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS f FROM t GROUP BY 1, 2, 3)
    SELECT token, round(({_START.format(*[v[0] for v in bayes.SUBTOKENS.values()])})::DOUBLE + 0.05 * coalesce(sum(f) FILTER (NOT is_ai), 0), 6) AS human, round(({_START.format(*[v[1] for v in bayes.SUBTOKENS.values()])})::DOUBLE + 0.05 * coalesce(sum(f) FILTER (is_ai), 0), 6) AS ai FROM n WHERE f >= 0.001 GROUP BY token""")
def nb_update(g):
    """Subtoken likelihoods after all labelled files."""
    labels = g.table("labels").where("quality is not null").select("doc_id", (F.col("quality") == 0).alias("is_ai"))
    rows = bayes.updated(code_files(g).join(labels, "doc_id").select(F.col("content").alias("text"), "is_ai"))
    return rows.select("token", F.round("human", 6).alias("human"), F.round("ai", 6).alias("ai"))


@query("explained_signals")
def explained_signals(g):
    """Firing signals of each file by tier, with their part of the score, the greatest first."""
    rows = authorship_scores(g)
    return authorship.explained(rows, "path")


@query("function_scores")
def function_scores(g):
    """All functions of each file, of five lines and fifty characters or more, scored by themselves."""
    return authorship.function_scores(code_files(g).select("path", F.col("content").alias("text"), "lang"))


@query("clone_pairs")
def clone_pairs(g):
    """Functions that are structural clones of others of their file: group and number of direct clones."""
    from ..operators import structure

    return structure.clones(code_files(g))


@query("ssa_paths")
def ssa_paths(g):
    """Single-assignment form of each function: blocks, joins, versions, and input that reaches a sink."""
    from ..operators import ssa

    return ssa.ssa_paths(code_files(g))


@query("file_report")
def file_report(g):
    """One result a file: type, hash, share, risk, findings, model, measures, paths of input; short and unscored files have empty ones."""
    from ..operators import evidence, filetype

    files = code_files(g)
    kind = filetype.file_type(F.col("path"))
    rows = files.select("doc_id", "path", evidence.language(F.col("path")).alias("language"), kind["test"].alias("test"), filetype.scanned(F.col("path"), F.col("content")).alias("scanned"), F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), F.size(F.split("content", "\n")).alias("lines"))
    # The detectors read each file once, for its risk and its counts.
    findings = stored(detectors.findings(files).select("path", "severity"), "findings")
    risk = _risk(files, findings).select("path", "ai", "risk", "indicators")
    severities = findings.groupBy("path").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")])
    found = source.facts(files).select("path", "measures.*", F.size(F.filter("flows", lambda x: (x["origin"] != "param") & ~x["target"].startswith("call:"))).alias("input_paths"))
    model = rules.attribution(files.select("path", F.col("content").alias("text"), "lang")).select("path", "model", "confidence")
    for part in (risk, severities, found, model):
        rows = rows.join(stored(part, "file-report"), "path", "left")
    empty = {"ai": 0.0, "risk": "LOW", "model": "unknown", "confidence": 0.0} | dict.fromkeys(["indicators", "critical", "high", "medium", "low", "input_paths"], 0) | dict.fromkeys([c for c in found.columns if c not in ("path", "input_paths")], 0)
    shown = lambda c: F.when(F.col("scanned"), F.coalesce(F.col(c), F.lit(empty[c]))).otherwise(F.lit(empty[c])).alias(c)
    return rows.select("doc_id", "path", "language", "test", "scanned", "content_hash", "lines", *map(shown, empty))
