"""Building blocks on small literals: hits, misses, ties and empty tables."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lodemark.functions import scalars
from lodemark.operators import authorship, bayes, detectors, flow, iterate, relational, signals, ssa, structure
from lodemark.plans import samples
from lodemark.sources import formats
from lodemark.sources.governance import quarantine, tenant
from lodemark.streaming import events


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_half_up_and_grades(spark):
    assert [one(spark, scalars.half_up(F.lit(x))) for x in (-0.5, 0.5, 1.49, 2.5)] == [0, 1, 1, 3]
    assert [one(spark, scalars.grade(F.lit(x))) for x in (0.9, 0.75, 0.6, 0.45, 0.1)] == list("ABCDF")


def test_entropy_and_hash(spark):
    assert one(spark, scalars.entropy(F.lit("aabb"))) == pytest.approx(1.0)
    assert one(spark, scalars.entropy(F.lit(""))) == 0.0

    def rolling(text):
        h = 0
        for c in text:
            h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
        return abs(h)

    for text in ("", "a", "org:flag-with-a-long-name"):
        assert one(spark, scalars.rolling_hash(F.lit(text))) == rolling(text)


def test_upper_median(spark):
    array = lambda *v: F.array(*[F.lit(x) for x in v])
    assert one(spark, scalars.upper_median(array(4.0, 1.0, 3.0, 2.0))) == 3.0
    assert one(spark, scalars.upper_median(F.array().cast("array<double>"))) is None


def test_latest_per_key_breaks_ties_and_is_idempotent(spark):
    df = spark.createDataFrame([("r", 1, 5), ("r", 2, 5), ("s", 3, 1)], "k string, id int, t int")
    latest = relational.latest_per_key(df, ["k"], "t", "id")
    assert rows(latest) == [("r", 2, 5), ("s", 3, 1)]
    assert rows(relational.latest_per_key(latest, ["k"], "t", "id")) == rows(latest)
    assert rows(relational.latest_per_key(df.repartition(3), ["k"], "t", "id")) == rows(latest)


def test_snapshot_diff(spark):
    make = lambda d: spark.createDataFrame(list(d.items()), "f string, r int")
    diff = relational.snapshot_diff(make({"a": 1, "b": 3, "c": 2, "e": 2}), make({"a": 2, "b": 1, "d": 4, "e": 2}), "f", "r")
    assert dict(rows(diff)) == {"a": "worsened", "b": "improved", "c": "resolved", "d": "new", "e": "unchanged"}


def test_writes(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert rows(relational.upsert(table, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(relational.insert_once(table, spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k int, v string"), ["k"])) == [(1, "a"), (2, "b"), (3, "d")]
    assert relational.single(table.where("k = 1"))["v"] == "a"
    assert relational.single(table.where("k = 9")) is None
    with pytest.raises(ValueError):
        relational.single(table)


def test_tenant_and_quarantine(spark):
    df = spark.createDataFrame([(1, "LOW"), (2, "ODD"), (1, None)], "org_id int, risk string")
    assert tenant(df, 1).count() == 2
    good, bad = quarantine(df, {"risk": scalars.RISKS})
    assert (good.count(), bad.count()) == (2, 1)


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (3, 5)], "src long, dst long")
    found = iterate.reach(edges, spark.createDataFrame([(1,)], "node long"))
    assert rows(found) == [(1, 0), (2, 1), (3, 2), (5, 3)]
    assert rows(iterate.cycles(edges)) == [([1, 2, 3], 3), ([4], 1)]
    nodes = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 1.0), (4, 0.2), (5, 0.0)], "node long, own double")
    assert dict(rows(iterate.contamination(nodes, edges)))[1] == pytest.approx(0.49)


def test_cycles_of_any_length(spark):
    ring = [(k, k % 8 + 1) for k in range(1, 9)]
    tails = [(k, k + 1) for k in range(20, 30)] + [(30, 1), (8, 40), (40, 41)]
    edges = spark.createDataFrame([*ring, *tails, (50, 51), (51, 50)], "src long, dst long")
    assert rows(iterate.cycles(edges)) == [([1, 2, 3, 4, 5, 6, 7, 8], 8), ([50, 51], 2)]


def test_fixpoints_come_to_rest_on_long_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(60, 55)], "src long, dst long")
    assert rows(iterate.reach(edges, spark.createDataFrame([(0,)], "node long"))) == [(k, k) for k in range(61)]
    nodes = spark.createDataFrame([(k, float(k == 20)) for k in range(61)], "node long, own double")
    got = dict(rows(iterate.contamination(nodes, edges)))
    assert got == pytest.approx({k: 0.7 ** (20 - k) if k <= 20 else 0.0 for k in range(61)})


@pytest.mark.parametrize(
    "line, id",
    [
        ("token = 'sk_live_abcdefghijklmnopqrstuv'", "hardcoded-secret"),
        ("res.status(500).json(err)", "verbose-error"),
        ("render_template_string(request.args)", "ssti"),
        ("res.setHeader('X', req.query)", "header-injection"),
        ("filter = '(uid=' + req.user", "ldap-injection"),
        ("req.files.doc.mv('/tmp')", "insecure-file-upload"),
        ("gql`query { x(id: ${req.query.id}) }`", "graphql-injection"),
        ("os.popen('ls ' + name)", "command-injection"),
        ("x = a​b", "watermark"),
    ],
)
def test_detector_hits(spark, line, id):
    found = detectors.findings(spark.createDataFrame([("a.ts", f"x\n{line}\n// {line}")], "path string, content string"))
    assert (2, id) in {(r["line"], r["id"]) for r in found.collect()}
    if id not in ("watermark",):
        assert not [r for r in found.collect() if r["line"] == 3 and r["id"] == id]


def test_context_detectors(spark):
    files = {
        "taint.js": "const u = req.query.u\n\nfetch(u)",
        "far.js": "go(req.query.u)" + "\n" * 12 + "fetch(u)",  # no name holds the input
        "toctou.js": "if (fs.existsSync(p)) {\n  fs.readFileSync(p)\n}",
        "cookie.js": "res.cookie('session', v, { path: '/' })",
        "safe.js": "res.cookie('session', v, {\n httpOnly: true,\n secure: true })",
        "sql.js": "const q = req.body.q\ndb.run(`update ${q}`)",
    }
    found = detectors.findings(spark.createDataFrame(list(files.items()), "path string, content string"))
    ids = {(r["path"], r["id"]) for r in found.collect()}
    assert ("taint.js", "ssrf") in ids and ("far.js", "ssrf") not in ids
    assert ("toctou.js", "toctou") in ids
    assert ("cookie.js", "cookie-no-httponly") in ids and not {i for p, i in ids if p == "safe.js"}
    assert ("sql.js", "sql-injection") in ids


def test_registry_refuses_and_isolates(spark):
    def broken():
        raise RuntimeError

    detectors.register("broken", broken)
    with pytest.raises(ValueError):
        detectors.register("xss", broken)
    try:
        assert detectors.findings(spark.createDataFrame([("a", "eval(x)")], "path string, content string")).count() == 1
    finally:
        detectors.REGISTRY.clear()


def test_signals(spark):
    values = lambda *v: F.array(*[F.lit(x) for x in v])
    assert one(spark, signals.noisy_or(values(0.5, 0.5))) == pytest.approx(0.75)
    assert one(spark, signals.noisy_or(values(1.0, 0.2))) == pytest.approx(1.0)
    level = lambda ai, *found: one(spark, signals.risk_level(values(*found) if found else F.array().cast("array<string>"), F.lit(ai)))
    assert [level(0.1, "critical"), level(0.1, "high"), level(0.8), level(0.6), level(0.1, "low"), level(0.5)] == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW"]


def test_authorship_of_samples(spark):
    """Signals worked out by hand for our samples; every signal has a column."""
    files = [(end, lang, code) for end, lang, code in samples.CODE] + [("null", None, None), ("two", "typescript", "\n".join(["x"] * 70) + "\n" + samples.TYPESCRIPT)]
    rows = {r["path"]: r for r in authorship.score(spark.createDataFrame(files, "path string, lang string, text string")).collect()}
    names = {*authorship.CORE, *authorship.SECONDARY, *authorship.STYLE}
    assert len(names) == 50 and all(0 <= r[n] <= 1 for r in rows.values() for n in names)
    assert all(rows[k][n] == 0 for k in (".md", "null") for n in names)
    assert rows["null"]["ai"] == pytest.approx(1 / (1 + math.exp(8 * 0.44)))
    # Three handlers of one shape, each with a documented guard, a log with context and a typed error.
    ts = rows[".ts"]
    assert [ts[k] for k in ("structural-clones", "exception-specificity", "structured-logging", "jsdoc-completeness")] == pytest.approx([0.65, 1.0, 1.0, 0.90])
    assert ts["import-exhaustiveness"] == pytest.approx(0.30 + 4 * 0.05)
    # Typed functions, docstring sections, data class, three imported types and a walrus: .30 + .25 + .15 + .10 + .10, and f-strings .20.
    assert rows[".py"]["language-specific"] == 1.0 and rows[".py"]["error-uniformity"] == 0.8
    assert rows[".go"]["language-specific"] == pytest.approx(0.30 + 0.25 + 0.20 + 0.15)
    # An image beacon (2), decoded code that is run (3), a literal admin (3): 8 points and the encoded text's 2 more.
    assert rows[".js"]["backdoor-detection"] >= 0.85
    assert rows["two"]["style-drift"] == 1.0 and ts["style-drift"] == 0.0


def test_function_bodies():
    js = "function a() { if (x) { y() } }\nconst b = (c) => { return c }\n"
    assert [b.count("{") for b in authorship.bodies(js, "typescript")] == [2, 1]
    py = "def a():\n    return 1\n\ndef b(x):\n    if x:\n        return 2\nz = 1\n"
    assert authorship.bodies(py, "python") == ["def a():\n    return 1\n", "def b(x):\n    if x:\n        return 2"]
    assert authorship.measures("", "python") == ([], [], 0, 0, 0)


def test_calls_metrics_and_clones():
    code = "export function a() { b(); }\nfunction b() { c(); }\nfunction c() { }\nfunction d() { }\nclass X { }\n// note"
    functions, classes, exports, complexity, nesting, comments, volume, loc = structure.metrics_of(code)
    assert (functions, classes, exports, complexity, nesting, loc) == (4, 1, 1, 4, 1, 6) and comments == pytest.approx(1 / 6) and volume > 0
    assert structure.metrics_of("") == (0, 0, 0, 1, 0, 0.0, 0, 0)
    groups = authorship.clone_groups(samples.TYPESCRIPT, "typescript")
    assert groups == [(0, 0, 2), (1, 0, 2), (2, 0, 2)]
    body = "function computeValue{0}(a) {{\n  const resultValue{0} = a;\n  const y = b + {0};\n  const z = c;\n  const w = d;\n  const v = e;\n  return g(resultValue{0});\n}}\n"
    many = "".join(body.format(n) for n in range(400)) + "function other(q) {\n  while (q) {\n    q = q - 1;\n    h(q);\n    k(q);\n  }\n}\n"
    assert authorship.clone_groups(many, "typescript") == [(n, 0, 399) for n in range(400)]


def test_function_scores(spark):
    rows = authorship.function_scores(spark.createDataFrame([("a.ts", samples.TYPESCRIPT, "typescript"), ("b", None, None)], "path string, text string, lang string")).collect()
    assert [(r["path"], r["number"]) for r in sorted(rows)] == [("a.ts", 0), ("a.ts", 1), ("a.ts", 2)] and all(0 < r["ai"] < 1 for r in rows)


def test_all_functions_of_a_file_are_scored(spark):
    body = "function f{0}(a) {{\n  const b = a + {0};\n  const c = b * 2;\n  log(c);\n  return g(c);\n}}\n"
    rows = authorship.function_scores(spark.createDataFrame([("a.ts", "".join(body.format(n) for n in range(95)), "typescript")], "path string, text string, lang string")).collect()
    assert sorted(r["number"] for r in rows) == list(range(95))


def test_a_function_that_files_share_is_scored_once(spark, monkeypatch):
    seen, plain = [], authorship.signals_of
    monkeypatch.setattr(authorship, "signals_of", lambda rows: (seen.append(rows.count()), plain(rows))[1])
    one = [("a0.ts", samples.TYPESCRIPT, "typescript")]
    files = lambda rows: spark.createDataFrame(rows, "path string, text string, lang string").coalesce(1)
    alone = authorship.function_scores(files(one)).collect()
    shared = authorship.function_scores(files([*one, ("a1.ts", "Prose (of no code), 'n' \n" + samples.TYPESCRIPT, "typescript"), ("a2.js", samples.TYPESCRIPT, "javascript")])).collect()
    assert seen == [3, 6] and len(shared) == 9
    of = lambda rows, path: sorted((r["number"], r["lines"], r["ai"]) for r in rows if r["path"] == path)
    assert of(alone, "a0.ts") == of(shared, "a0.ts") == of(shared, "a1.ts") and len(of(shared, "a2.js")) == 3


def test_naive_bayes(spark):
    files = [("ai", "handleResponse(payload); await validateResult(config);"), ("plain", "x = 1"), ("human", "var self = this; callback(arguments)"), ("null", None)]
    rows = {r["k"]: r for r in bayes.classify(spark.createDataFrame(files, "k string, text string"), "k").collect()}
    assert rows["ai"]["probability"] > rows["plain"]["probability"] > rows["human"]["probability"]
    assert rows["ai"]["blended"] == pytest.approx(0.6 * 0.5 + 0.4 * rows["ai"]["probability"])
    # One new token in two of the human example's two, one of ours once in the machine's two.
    moved = {r["token"]: r for r in bayes.updated(spark.createDataFrame([("zebra zebra", False), ("result other", True)], "text string, is_ai boolean")).collect()}
    assert (moved["zebra"]["human"], moved["zebra"]["ai"]) == (pytest.approx(-4.95), pytest.approx(-5.0))
    assert (moved["result"]["human"], moved["result"]["ai"]) == (pytest.approx(-3.5), pytest.approx(-2.0 + 0.025))


def test_single_assignment_form():
    body = "function f(req) {\n  let a = req.query.q\n  if (a) {\n    a = clean(a)\n  } else {\n    a = 1\n  }\n  db.query(a)\n  a = 2\n  db.query(a)\n}"
    near, frontier = ssa.dominators(flow.graph(body, "typescript").after)
    # Entry, the first statement, the condition, one statement of each branch, the first sink.
    assert (near[3], near[4], near[5]) == (2, 2, 2) and frontier[3] == frontier[4] == {5} and not frontier[2]
    form = ssa.converted(body)
    # One join of a before the first sink; the second sink's a is clean again.
    assert (form["joins"], form["versions"]) == (["a.1"], 5)
    assert form["paths"] == [("query", 2, 8, "a.1")]
    loop = "function g(req) {\n  let x = 1\n  while (x) {\n    db.query(x)\n    x = req.body.b\n  }\n}"
    assert ssa.converted(loop)["paths"] == [("query", 5, 4, "x.1")]
    branch = "function h(req) {\n  let x = 0\n  if (a) {\n    x = req.body.b\n    return x\n  } else if (b) {\n    x = 2\n  }\n  db.query(x)\n}"
    assert ssa.converted(branch)["paths"] == []
    assert ssa.converted("")["paths"] == []


def test_named_taint(spark):
    files = {
        "far.js": "const u = req.query.u\n" + "\n" * 20 + "got(u)\ngot(v)",
        "two.js": "const { a, b: c } = request.body\nel.outerHTML =a\nel.outerHTML =c",
        "p.py": "url = request.args.get('u')\nx = 1\naxios(url)",
        "none.js": "got(u)",
    }
    found = detectors.named_findings(spark.createDataFrame(list(files.items()), "path string, content string"))
    ids = {(r["path"], r["line"], r["id"]) for r in found.collect()}
    assert ids == {("far.js", 22, "ssrf"), ("p.py", 3, "ssrf")}  # .outerHTML = name is a pattern of its own
    assert detectors.findings(spark.createDataFrame([("a", "x")], "path string, content string")).count() == 0


def test_structure():
    names, imports, branches, depth, calls = structure.describe("import os\nfunction f(a) { if (a) { g('{') } }\nconst h = (x) => { return f(x) }")
    assert (names, imports, branches, depth, calls) == (["f", "h"], ["os"], 1, 2, ["g"])


def test_formats(spark):
    text = '{"dependencies": {"a": "^1.2.3"}, "devDependencies": {"b": "~2.0.0"}}'
    assert [tuple(x) for x in one(spark, formats.npm_dependencies(F.lit(text)))] == [("a", "1.2.3"), ("b", "2.0.0")]
    assert one(spark, formats.npm_dependencies(F.lit("no json"))) == []
    assert [tuple(x) for x in one(spark, formats.requirements(F.lit("# c\nflask==2.1\nrequests\n")))] == [("flask", "2.1"), ("requests", "*")]
    assert [tuple(x) for x in one(spark, formats.go_modules(F.lit("module m\nrequire github.com/x/y v1.2.3\n")))] == [("github.com/x/y", "1.2.3")]
    assert one(spark, formats.commit(F.lit("h|n|e|1|G|a | b"))["subject"]) == "a | b"
    line = spark.createDataFrame([('a,b', 'say "x"', None)], "p string, q string, r string").select(formats.csv_line("p", "q", "r")).first()[0]
    assert line == '"a,b","say ""x""",'
    report = spark.createDataFrame([("r", "f.ts", "xss", "XSS", "high", 0), ("r", "g.ts", "xss", "XSS", "low", 4)], "report string, path string, id string, label string, severity string, line int")
    document = json.loads(formats.sarif(report).first()["document"])["runs"][0]
    assert len(document["tool"]["driver"]["rules"]) == 1 and {x["level"] for x in document["results"]} == {"error", "note"}
    exported = formats.json_document(spark.range(2), "2001-01-01").first()[0]
    assert json.loads(exported)["count"] == 2


def test_webhooks(spark):
    texts = [
        '{"action":"opened","pull_request":{"number":3,"head":{"sha":"a"}},"repository":{"full_name":"r"}}',
        '{"object_kind":"merge_request","object_attributes":{"iid":4,"action":"open"},"project":{"path_with_namespace":"g/r"}}',
        '{"pullrequest":{"id":5,"state":"OPEN"},"repository":{"full_name":"b/r"}}',
        "{", '{"repository":{"full_name":"r"}}', '{"action":"closed","pull_request":{"number":3},"repository":{"full_name":"r"}}', None,
    ]
    good, bad = events.webhooks(spark.createDataFrame([(t,) for t in texts], "payload string"))
    assert rows(good.select("host", "pr_number")) == [("bitbucket", 5), ("github", 3), ("gitlab", 4)]
    assert bad.count() == 4


def test_taint_and_calls():
    found = structure.taint_of("const a = req.query.q\nconst b = clean\nlet c = a + 1\ndb.query(c)\na = 1\neval(a)")
    assert found == [("query", 1, 4, "a@1>c@3")]


def test_cycles_far_apart_on_a_mesh(spark):
    """Between two rings lie forty layers of two nodes: 2^40 ways, none of them in a cycle."""
    layer = [(k * 10 + a, k * 10 + 10 + b) for k in range(1, 41) for a in (0, 1) for b in (0, 1)]
    rings = [(1, 2), (2, 1), (2, 10), (2, 11), (410, 500), (411, 500), (500, 501), (501, 500)]
    edges = spark.createDataFrame(layer + rings, "src long, dst long")
    assert rows(iterate.cycles(edges)) == [([1, 2], 2), ([500, 501], 2)]


def test_cycles_of_random_graphs(spark):
    rng = random.Random(5)
    for _ in range(3):
        pairs = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(16)})

        def ways(path, pairs=pairs):
            for a, b in pairs:
                if a == path[-1] and b == path[0]:
                    yield (path, len(path))
                elif a == path[-1] and b > path[0] and b not in path:
                    yield from ways([*path, b])

        expected = sorted(x for n in range(9) for x in ways([n]))
        assert rows(iterate.cycles(spark.createDataFrame(pairs, "src long, dst long"))) == expected
