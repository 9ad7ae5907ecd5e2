"""Facts of source files, the graphs over them, and their joins, against hand-made and naive answers."""

import random
import time

import pytest

from lodemark.operators import callgraph, iterate, modules, source, ssa

T = """import { lookupUser } from "./helper";
export async function handler(db, req) {
  const user = lookupUser(db, req);
  const { a, b: c } = req.body;
  log(c, `x ${user.name} "q" { }`);
  if (a && c) { return go(a ? 1 : 2); }
  return user; // function no(x) { }
}
class A extends B {
  async run(x) { while (x) { x = x - 1; for (;;) {} } }
}
const f1 = async (q) => q + 1;
const f2 = p => { eval(p) };
export default handler;
export { f1 as g1 };
export { z } from './z';
const { k, m: n } = require("../lib");
exports.f2 = f2;
"""
HELPER = "export function lookupUser(db, req) {\n  const id = req.params.id;\n  const result = db.query(`SELECT * FROM users WHERE id=${id}`);\n  return result;\n}"
CONSUMER = 'import { lookupUser } from "./helper";\n\nexport async function handler(db, req) {\n  const user = lookupUser(db, req);\n  return user;\n}'


def program(spark, files):
    return source.facts(spark.createDataFrame([(p, t, "python" if p.endswith(".py") else "typescript") for p, t in files], "path string, content string, lang string")).cache()


def test_facts_of_a_file():
    d = source.describe(T, "typescript")
    assert [(f["name"], f["kind"], f["line"], f["end_line"], f["params"], f["complexity"], f["is_entry"]) for f in d["functions"]] == [
        ("handler", "function", 2, 8, ["db", "req"], 4, True), ("run", "method", 10, 10, ["x"], 3, True), ("f1", "arrow", 12, 12, ["q"], 1, False), ("f2", "arrow", 13, 13, ["p"], 1, True),
    ]
    assert [(c["name"], c["line"], c["end_line"], c["base"], c["methods"]) for c in d["classes"]] == [("A", 9, 11, "B", ["run"])]
    assert [(i["specifier"], i["name"], i["alias"], i["kind"], i["line"]) for i in d["imports"]] == [("./helper", "lookupUser", "lookupUser", "name", 1), ("./z", "z", "z", "re-export", 16), ("../lib", "k", "k", "name", 17), ("../lib", "m", "n", "name", 17)]
    assert [(e["name"], e["local"], e["kind"]) for e in d["exports"]] == [("handler", "handler", "function"), ("default", "handler", "default"), ("g1", "f1", "const"), ("z", "z", "re-export")]
    assert [(c["caller"], c["callee"], c["args"]) for c in d["calls"]] == [("handler", "lookupUser", ["db", "req"]), ("handler", "log", ["c", ""]), ("handler", "go", [""]), ("f2", "eval", ["p"])]
    assert ("user-input", "call:log", 0) in {(f["origin"], f["target"], f["arg"]) for f in d["flows"]}
    assert ("param", 0, "eval") in {(f["origin"], f["param"], f["target"]) for f in d["flows"]}


def test_python_and_go():
    d = source.describe('import os\nfrom a.b import (c, d as e)\n__all__ = ["f"]\nclass K(Base):\n    def m(self, x: int = 1):\n        """def no(): {"""\n        if x and self:\n            return g(x)\n\ndef f(p, *rest):\n    return os.system(p)\n', "python")
    assert [(f["name"], f["kind"], f["line"], f["end_line"], f["params"], f["complexity"], f["within"]) for f in d["functions"]] == [("m", "method", 5, 9, ["self", "x"], 2, "K"), ("f", "function", 10, 11, ["p", "rest"], 1, None)]
    assert [(i["specifier"], i["name"], i["alias"]) for i in d["imports"]] == [("os", "os", "os"), ("a.b", "c", "c"), ("a.b", "d", "e")]
    assert [(e["name"], e["kind"]) for e in d["exports"]] == [("f", "const")] and d["classes"][0]["base"] == "Base"
    d = source.describe("func (s *S) Load(ctx C, id string) error {\n\treturn read(id)\n}\n", "golang")
    assert [(f["name"], f["params"], f["is_exported"]) for f in d["functions"]] == [("Load", ["ctx", "id"], True)]


@pytest.mark.parametrize("text", ["", "function f(", "}}}{{{", "'unclosed\nfunction f(a) { return a }", "/* open function f() {}", "`${a", "prose (with one open\nfunction f(a) { g(a) }", "a" * 5000, "\r\n\x85 function f() {\n}"])
def test_odd_texts_have_facts(text):
    for lang in ("typescript", "python", "golang", "java", "", "other"):
        source.describe(text, lang)


@pytest.mark.parametrize("unit", ["{", "(", "f(", "function f(a) {", '"', "`", "/*", "a, ", "if (a) { ", "const {a, ", "x => ", "  def f(a):\n", "x = y\n", "a = req.body\n", "f(g("])
def test_long_texts_are_read_in_linear_time(unit):
    began = time.time()
    source.describe(unit * (200_000 // len(unit)), "python" if "def" in unit else "typescript")
    assert time.time() - began < 8


def test_long_functions_are_converted():
    body = "function f(req) {\n  const q = req.query.q;\n" + "  if (q) {\n    g(q);\n  }\n" * 4000 + "  eval(q);\n}\n"
    (found,) = source.bodies(body, "typescript")
    form = ssa.converted(found)
    assert form["paths"] and form["blocks"] > 8000


def test_resolution_order_and_paths(spark):
    files = [("src/a.ts", 'import { x } from "./b";\nimport y from "../lib/./c/../d";\nimport z from "react";\nimport q from "./e.js";'), ("src/b.js", "export const x = 1;"), ("src/b.ts", "export const x = 1;\nexport const unused = 2;"), ("lib/d/index.ts", "export default 1;"), ("src/e.js", ""), ("src/e.js.ts", "")]
    facts = program(spark, files)
    assert {tuple(r) for r in modules.resolved(facts).collect()} == {("src/a.ts", "./b", "src/b.ts"), ("src/a.ts", "../lib/./c/../d", "lib/d/index.ts"), ("src/a.ts", "./e.js", "src/e.js")}
    used = modules.uses(facts)
    assert {(r["path"], r["name"]) for r in modules.dead(facts, used).collect()} == {("src/b.ts", "unused"), ("src/b.js", "x")}
    assert {(r["alias"], r["dependency"], r["local"]) for r in modules.defined(facts, used).collect()} == {("x", "src/b.ts", "x"), ("y", "lib/d/index.ts", "default")}


def test_taint_crosses_files(spark):
    facts = program(spark, [("src/helper.ts", HELPER), ("src/consumer.ts", CONSUMER), ("src/clean.ts", 'import { add } from "./add";\nexport function s(x) { return add(x, x); }'), ("src/add.ts", "export function add(x, y) { return x + y; }")])
    got = [tuple(r) for r in modules.cross_file_taint(facts, modules.uses(facts)).collect()]
    assert got == [("src/consumer.ts", "src/helper.ts", "lookupUser", 1, "sql", 3, source.CONFIDENCE)]


def test_taint_over_calls(spark):
    code = "export function h(req) {\n  const q = req.query.q;\n  aa(1, q);\n  eval(q);\n}\nfunction aa(x, y) {\n  bb(y);\n  bb(x);\n}\nfunction bb(z) { aa(z, z); return exec(z); }\nfunction clean(w) { return exec(w); }\n"
    facts = program(spark, [("m.ts", code)])
    means = callgraph.callees(facts, modules.uses(facts))
    taint = callgraph.Taint(facts, means)
    got = {(r["sink_function"], r["sink"], r["hops"], tuple(x.split("#")[1] for x in r["chain"])) for r in taint.paths().collect()}
    assert got == {("h", "eval", 0, ("h",)), ("bb", "exec", 2, ("h", "aa", "bb"))}
    assert {r["function"] for r in taint.functions().collect()} == {"h", "aa", "bb"}


def test_reach_equals_a_naive_closure(spark):
    rng = random.Random(4)
    names = [f"fn{k}" for k in range(60)]
    calls = {n: rng.sample(names, rng.randint(0, 2)) for n in names}
    code = "".join(f"{'export ' if k % 17 == 0 else ''}function {n}(a) {{\n" + "".join(f"  {c}(a);\n" for c in calls[n]) + "}\n" for k, n in enumerate(names))
    facts = program(spark, [("m.ts", code)])
    got = {r["function"]: r["depth"] for r in callgraph.reach(facts, callgraph.edges(facts, callgraph.callees(facts, modules.uses(facts)))).collect()}
    depth = {n: 0 for k, n in enumerate(names) if k % 17 == 0}
    front = list(depth)
    while front:
        front = [c for n in front for c in calls[n] if c not in depth and not depth.update({c: depth[n] + 1})]
    assert got == {n: depth.get(n) for n in names}


def test_innermost_function_and_guards(spark):
    from lodemark.plans.modules import near_guards

    code = "function outer() {\n" + "  x();\n" * 70 + "  const inner = (a) => {\n    y();\n  };\n  z();\n}\nw();\n"
    facts = program(spark, [("m.ts", code)])
    lines = spark.createDataFrame([("m.ts", n) for n in (1, 5, 72, 73, 75, 77)], "path string, line int")
    got = {r["line"]: r["function"] for r in callgraph.enclosing(lines, facts).collect()}
    assert got == {1: "outer", 5: "outer", 72: "inner", 73: "inner", 75: "outer", 77: None}
    rng = random.Random(2)
    marks = [(n, rng.choice(["requireAuth", "throttle", "plain", "plain", "plain"])) for n in range(1, 400)]
    near = near_guards(spark.createDataFrame([("m", n) for n in range(1, 400, 3)], "path string, line int"), spark.createDataFrame([("m", *m) for m in marks], "path string, line int, text string"))
    for r in near.collect():
        window = [t for n, t in marks if r["line"] - 20 < n <= r["line"] + 5]
        assert (r["auth"], r["slow"]) == ("requireAuth" in window, "throttle" in window)


def test_empty_and_null_files(spark):
    facts = program(spark, [("a.ts", None), ("b.ts", "")])
    assert modules.resolved(facts).count() == 0 and callgraph.functions(facts).count() == 0
    means = callgraph.callees(facts, modules.uses(facts))
    assert callgraph.Taint(facts, means).paths().count() == 0
    assert iterate.reach(modules.edges(modules.resolved(facts)), facts.selectExpr("path as node")).count() == 2


def test_file_report_holds_the_parts(spark):
    from lodemark.plans import registry

    sf, q = "/root/testdata/sf0.001", registry.queries()
    got = {r["path"]: r for r in q["file_report"](spark, sf).collect()}
    risk = {r["path"]: r for r in q["code_risk"](spark, sf).collect()}
    models = {r["path"]: r for r in q["attribution_posterior"](spark, sf).collect()}
    assert got.keys() == risk.keys()
    for path, r in got.items():
        if r["scanned"]:
            assert (r["risk"], r["indicators"], r["model"]) == (risk[path]["risk"], risk[path]["indicators"], models[path]["model"]) and r["ai"] == pytest.approx(risk[path]["ai"])
        else:
            assert (r["ai"], r["risk"], r["model"], r["functions"], r["critical"]) == (0.0, "LOW", "unknown", 0, 0)
    assert {r["scanned"] for r in got.values()} == {True, False}


@pytest.mark.parametrize("lang", ["python", "typescript", "golang"])
def test_headers_are_searched_in_the_lines_that_can_hold_one(lang, monkeypatch):
    """Prose is not searched, and the same headers are found as in the whole text."""
    parts = ["(", ")", "=>", " a =>", "class A", "\nclass C(B):\n", " function f(", "const x = async ", "def g(", "\n    def z(", "\nfunc (r T) m(", "\n  m(x) {\n", "\n", " ", "x", "é", "{", "}", ";", "\r"]
    rng = random.Random(lang)
    for _ in range(300):
        code = "".join(rng.choices(parts, k=rng.randint(1, 25)))
        begin = rng.randint(0, 3)
        for table, line in ((source._FUNCTIONS, source._FUNCTION_LINE), (source._CLASSES, source._CLASS_LINE)):
            pattern = table.get(lang, table[""])
            assert [m.span() for m in source._headers(pattern, line, code, begin)] == [m.span() for m in pattern.finditer(code, begin)]
    assert list(source._headers(None, source._FUNCTION_LINE, "prose, and more of it;\n" * 9, 0)) == []


def test_blanks_of_regular_expressions_and_prefixed_strings():
    for lang, text, parts in [
        ("typescript", "a = /x\"y/g; b / c / d; e", ["/x\"y/g"]),
        ("typescript", "f( /[/']/ ) + 'q' / 2", ["/[/']/", "'q'"]),
        ("python", "x = rb'y' + url'z' + f\"{k}l\" # it's", ["rb'y'", "'z'", "f\"{", "}l\"", "# it's"]),
    ]:
        left = text
        for part in parts:
            left = left.replace(part, " " * len(part))
        assert source.blanked(text, lang) == left
