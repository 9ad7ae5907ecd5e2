"""Patterns on texts of their own repeated beginnings: no stack overflow, no quadratic scan."""

import re
import time
from re import _constants as C
from re import _parser

import pytest

from lodemark.operators import detectors, matching, patterns, rules

SIZE = 1_000_000
OWN = [*patterns.COMMENT_PHRASING, *patterns.NGRAMS, *patterns.ERROR_PHRASES, *patterns.HALLUCINATED_APIS, *patterns.COPY_PASTE, *(p for p, _ in patterns.BACKDOORS)]
OWN += [r[-1] for r in rules.RULES] + [p for m in rules.MODELS for side in m[3:] for p, _ in side] + [p for p, _ in rules.HUMAN]
JAVA = [p for *_, own in detectors.DETECTORS for p in own] + [p for *_, p in detectors.SECRETS + detectors.GENERIC_SECRETS] + detectors.TIMING + patterns.PROMPT_LEAKS


#: Two ends around braces or a line's rest: quadratic in a line of their own beginnings, some 0.5 s at 30,000 characters.
QUADRATIC = {p for p in OWN + JAVA if p.startswith((r"(?i)\*\s*@(?:param", r"""f["'](?:[^"'\n]*""", "@dataclass", r"(?i)(?:res\.status\s*\([^)]+"))}


def written(items) -> str:
    """A character of a class."""
    kinds = {C.CATEGORY_SPACE: " ", C.CATEGORY_WORD: "a", C.CATEGORY_DIGIT: "1", C.CATEGORY_NOT_SPACE: "a", C.CATEGORY_NOT_WORD: "-"}
    if items[0][0] is C.NEGATE:
        return next(c for c in "a ;x0Z{(-\x01" if not re.match("[" + re.escape("".join(chr(v) for op, v in items[1:] if op is C.LITERAL)) + "\x00]", c))
    op, value = items[0]
    return chr(value if op is C.LITERAL else value[0]) if op in (C.LITERAL, C.RANGE) else kinds.get(value, "a")


def sample(tree, loops, text=""):
    """A text that matches, and in ``loops`` the text before each loop with one turn of it."""
    for op, arg in tree:
        if op is C.LITERAL:
            text += chr(arg)
        elif op in (C.NOT_LITERAL, C.ANY, C.GROUPREF):
            text += "a"
        elif op is C.IN:
            text += written(arg)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, sub = arg
            turn = sample(sub, loops, text)[len(text) :]
            if high > 20 and turn:
                loops.append((text, turn))
            text += turn * max(low, 1)
        elif op is C.SUBPATTERN:
            text = sample(arg[3], loops, text)
        elif op is C.ATOMIC_GROUP:
            text = sample(arg, loops, text)
        elif op is C.BRANCH:
            for other in arg[1][1:]:
                sample(other, loops, text)
            text = sample(arg[1][0], loops, text)
    return text


def units(pattern):
    loops: list = []
    whole = sample(_parser.parse(pattern), loops)
    out = [(before, turn) for before, turn in loops] + [("", before + turn) for before, turn in loops] + [("", before) for before, _ in loops]
    return [u for u in dict.fromkeys([*out, ("", whole), ("", whole[: len(whole) // 2]), ("", whole[:-1])]) if u[1]]


def searched(pattern, text) -> bool:
    exact, wanted = matching.needs(pattern)
    held = text if exact else text.lower()
    return all(any((x if exact else x.lower()) in held for x in w) for w in wanted)


@pytest.mark.parametrize("pattern", [(p, matching.java(matching.tempered(p))) for p in OWN] + [(p, matching.loops(matching.tempered(p))) for p in JAVA], ids=lambda p: p[0][:40])
def test_own_beginnings_repeated(spark, pattern):
    source, form = pattern
    compiled = spark._jvm.java.util.regex.Pattern.compile(form)
    for before, unit in units(source):
        for size, limit in ((300, 0.2), (1000, 1)) if source in QUADRATIC else ((300, 0.2), (3000, 0.2), (30_000, 0.5), (SIZE, 2)):
            text = (before + unit * (size // len(unit) + 1))[:size]
            if searched(source, text):
                began = time.time()
                compiled.matcher(text).find()
                assert time.time() - began < limit, (before, unit, size)


@pytest.mark.parametrize("loop, form", matching.LOOPS)
def test_forms_of_loops_find_the_same(spark, loop, form):
    import random

    table = [p for p in [*OWN, *JAVA, r"except\s+(?:\w+(?:\s*,\s*\w+)*)?\s*(?:as\s+\w+)?:", r"const\s*\{\s*(?:\w+\s*,\s*){4,}\w+\s*\}", r"public\s+(?:(?:static|virtual|override|async)\s+)*\w[\w<>\[\],\s]*\s+\w+\s*[({]", r"\bconst\s+\{\s*\w+(?:\s*,\s*\w+)+\s*\}\s*="] if loop in p]
    compile_ = spark._jvm.java.util.regex.Pattern.compile
    rng = random.Random(len(loop))
    for p in table:
        loops: list = []
        whole = sample(_parser.parse(p), loops)
        parts = [*whole, *(t for _, t in loops), " ", ",", "a", "b", "{", "}", '"', "\n", "static ", "as ", ":", "!"]
        java = p in JAVA
        plain, other = compile_(p if java else p.replace(r"\b", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))")), compile_(matching.loops(p) if java else matching.java(p))
        for _ in range(400):
            at = rng.randint(0, len(whole))
            text = whole[:at] + "".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) + whole[at:]
            if rng.random() < 0.5 and loops:
                before, turn = rng.choice(loops)
                text = before + turn * rng.randint(0, 4) + rng.choice(parts) + whole[len(before) :]
            assert plain.matcher(text).find() == other.matcher(text).find(), (p, text)


def test_tempered_forms_find_the_same(spark):
    import random

    compile_ = spark._jvm.java.util.regex.Pattern.compile
    rng = random.Random(8)
    for p in OWN + JAVA:
        if matching.tempered(p) == p:
            continue
        whole = sample(_parser.parse(p), [])
        plain, other = compile_(p), compile_(matching.tempered(p))
        for _ in range(150):
            i, j = sorted((rng.randint(0, len(whole)), rng.randint(0, len(whole))))
            text = rng.choice([whole[:i] + rng.choice([")", " ", "x", "\n", "+", "'"]) + whole[j:], whole[:j] + whole[i:], whole[:i] + whole, whole + whole[j:], whole[:i] + whole[:j] + ") " + whole[i:]])
            assert plain.matcher(text).find() == other.matcher(text).find(), (p, text)


def test_long_list_of_names(spark):
    from lodemark.operators import authorship

    text = "const { " + "a, " * 6000 + "...x } = y\n"
    rows = spark.createDataFrame([("f.ts", text, "typescript")], "path string, text string, lang string")
    assert authorship.score(rows).select("ai").collect()[0]["ai"] is not None


def test_long_line(spark):
    line = '"' + "select " * 20_000 + '" + x'
    rows = spark.createDataFrame([("f.ts", line)], "path string, content string")
    began = time.time()
    detectors.findings(rows).collect()
    assert time.time() - began < 60
