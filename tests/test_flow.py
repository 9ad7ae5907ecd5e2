"""Control flow and single-assignment form against all paths of random programs."""

import random

import pytest

from lodemark.operators import flow, ssa

NAMES = "abcd"


def program(rng, depth, loops):
    """A random block: lists of statements as nested tuples."""
    out = []
    for _ in range(rng.randint(1, 4)):
        kinds = ["set", "set", "input", "clear", "sink", "sink"] + (["if", "ifelse", "one", "while", "do", "switch", "try"] if depth else []) + (["break", "continue"] if loops else []) + ["return"] * (rng.random() < 0.1)
        kind, v, w = rng.choice(kinds), rng.choice(NAMES), rng.choice(NAMES)
        sub = lambda more=False: program(rng, depth - 1, loops or more)  # noqa: E731, B023
        out.append({"if": lambda: ("if", sub(), None), "ifelse": lambda: ("if", sub(), sub()), "one": lambda: ("one", ("set", v, w)), "while": lambda: ("while", sub(True)), "do": lambda: ("do", sub(True)), "switch": lambda: ("switch", [sub() for _ in range(rng.randint(1, 3))], rng.random() < 0.5, rng.random() < 0.5), "try": lambda: ("try", sub(), sub(), rng.random() < 0.5 and sub())}.get(kind, lambda: (kind, v, w))())  # noqa: B023
        if kind in ("break", "continue", "return"):
            break
    return out


def written(block, lines, pad):
    for s in block:
        kind = s[0]
        put = lambda text: lines.append(pad + text)
        if kind in ("set", "input", "clear"):
            put(f"{s[1]} = " + {"set": s[2], "input": "req.query.q", "clear": "1"}[kind] + ";")
        elif kind == "sink":
            put(f"eval({s[1]});")
        elif kind in ("break", "continue"):
            put(kind + ";")
        elif kind == "return":
            put("return 1;")
        elif kind == "one":
            put(f"if (x) {s[1][1]} = {s[1][2]};")
        elif kind == "if":
            put("if (x) {")
            written(s[1], lines, pad + "  ")
            if s[2] is not None:
                put("} else {")
                written(s[2], lines, pad + "  ")
            put("}")
        elif kind == "while":
            put("while (x) {")
            written(s[1], lines, pad + "  ")
            put("}")
        elif kind == "do":
            put("do {")
            written(s[1], lines, pad + "  ")
            put("} while (x);")
        elif kind == "switch":
            put("switch (x) {")
            for k, b in enumerate(s[1]):
                put(f"  case {k}:" if k < len(s[1]) - 1 or not s[2] else "  default:")
                written(b, lines, pad + "    ")
                if s[3]:
                    put("    break;")
            put("}")
        elif kind == "try":
            put("try {")
            written(s[1], lines, pad + "  ")
            put("} catch (err) {")
            written(s[2], lines, pad + "  ")
            if s[3]:
                put("} finally {")
                written(s[3], lines, pad + "  ")
            put("}")


class Paths:
    """All sets of tainted names that can hold at each place; sinks by their order in the text."""

    def __init__(self):
        self.hits, self.seen = set(), []

    def run(self, block, envs, base):
        """(envs that leave normally, breaks, continues, everything seen on the way)."""
        breaks, continues, seen, n = set(), set(), set(envs), base
        for s in block:
            kind, seen = s[0], seen | envs
            if kind == "set":
                envs = {e | {s[1]} if s[2] in e else e - {s[1]} for e in envs}
            elif kind == "input":
                envs = {e | {s[1]} for e in envs}
            elif kind == "clear":
                envs = {e - {s[1]} for e in envs}
            elif kind == "sink":
                if any(s[1] in e for e in envs):
                    self.hits.add(id(s))
            elif kind == "break":
                breaks, envs = breaks | envs, set()
            elif kind == "continue":
                continues, envs = continues | envs, set()
            elif kind == "return":
                envs = set()
            elif kind == "one":
                envs = envs | {e | {s[1][1]} if s[1][2] in e else e - {s[1][1]} for e in envs}
            elif kind == "if":
                a = self.run(s[1], envs, n)
                b = self.run(s[2], envs, n) if s[2] is not None else (envs, set(), set(), set())
                envs, breaks, continues, seen = a[0] | b[0], breaks | a[1] | b[1], continues | a[2] | b[2], seen | a[3] | b[3]
            elif kind in ("while", "do"):
                into, out = set(envs), set(envs) if kind == "while" else set()
                while True:
                    a = self.run(s[1], into, n)
                    seen |= a[3]
                    if kind == "do":
                        out |= a[0] | a[1] | a[2]
                    else:
                        out |= a[0] | a[1] | a[2]
                    more = into | a[0] | a[2]
                    if more == into:
                        break
                    into = more
                envs = out
            elif kind == "switch":
                start, now, out = envs, set(), set()
                for b in s[1]:
                    a = self.run(b, now | start, n)
                    continues, seen, out = continues | a[2], seen | a[3], out | a[1]
                    now = a[0]
                    if s[3]:
                        out, now = out | now, set()
                envs = out | now | (set() if s[2] else start)
            elif kind == "try":
                a = self.run(s[1], envs, n)
                b = self.run(s[2], a[3] | a[0] | a[1] | a[2], n)
                out = a[0] | b[0]
                breaks, continues, seen = breaks | a[1] | b[1], continues | a[2] | b[2], seen | a[3] | b[3]
                if s[3]:
                    c = self.run(s[3], out, n)
                    out, breaks, continues, seen = c[0], breaks | c[1], continues | c[2], seen | c[3]
                envs = out
            seen |= envs
        return envs, breaks, continues, seen


def sinks(block):
    for s in block:
        if s[0] == "sink":
            yield s
        for part in s[1:]:
            if isinstance(part, list):
                yield from (x for b in part for x in sinks(b)) if part and isinstance(part[0], list) else sinks(part)


def broken_out(block):
    """Whether a try or a switch lets a break, continue or return out, which the paths here treat in their own way."""
    flat = str(block)
    return ("'try'" in flat or "'switch'" in flat) and any(f"'{w}'" in flat for w in ("break", "continue", "return"))


@pytest.mark.parametrize("seed", range(8))
def test_taint_equals_all_paths(seed):
    rng, checked = random.Random(seed), 0
    while checked < 60:
        block = program(rng, 3, False)
        if broken_out(block):
            continue
        checked += 1
        lines = ["function f(req) {"]
        written(block, lines, "  ")
        body = "\n".join([*lines, "}"])
        paths = Paths()
        paths.run(block, {frozenset()}, 0)
        places = [k + 1 for k, x in enumerate(lines) if "eval(" in x]
        expected = {place for place, s in zip(places, sinks(block), strict=True) if id(s) in paths.hits}
        assert {p[2] for p in ssa.converted(body)["paths"]} == expected, body


def edges(body, lang="typescript"):
    g = flow.graph(body, lang)
    return {(g.nodes[a][1].strip(), g.nodes[b][1].strip()) for a, out in g.after.items() for b in out}


def test_jumps():
    got = edges("function f() {\n outer: for (;;) { while (q) { if (r) break outer; else continue; s(); } t(); }\n u();\n}")
    assert ("break outer", "u()") in got and ("continue", "while (q)") in got and ("t()", "outer: for (;;)") in got and not any(b == "s()" for _, b in got)
    got = edges("function f() { switch (x) { case 1: a(); case 2: b(); break; default: c(); } d(); return e(); g(); }")
    assert ("a()", "case 2:") in got and ("break", "d()") in got and ("c()", "d()") in got and ("switch (x)", "d()") not in got and not any(b == "g()" for _, b in got)
    got = edges("def f(x):\n    for i in x:\n        if i: break\n        g(i)\n    else:\n        h()\n    try:\n        a()\n    except E:\n        b()\n    finally:\n        c()\n    return 1\n", "python")
    assert ("break", "") in got and ("g(i)", "for i in x:") in got and ("for i in x:", "h()") in got and ("c()", "return 1") in got


@pytest.mark.parametrize("body", ["", "function f", "function f() {", "}}}", "function f() { if (a", "function f() { switch (x) { case", "function f() { try { a(", "x => x + 1", "function f() {" + "if (a) {" * 400 + "b();"])
def test_odd_bodies(body):
    for lang in ("typescript", "golang", "python", ""):
        ssa.converted(body, lang)
