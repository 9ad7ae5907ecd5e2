"""Tables of patterns in Arrow batches: the same counts as Python's expressions, behind languages and gates."""

import re

import pytest

from lodemark.operators import authorship, matching, rules
from lodemark.plans import registry

TEXTS = [("a", "x = 1\nif (a) y\n\nif (b) z", "js", 4), ("b", "", "js", 1), ("c", "if (ä) if (c)\nno", "py", 2), ("d", "if (a)\n" * 5, "", 6)]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(TEXTS, "path string, text string, lang string, lines int").repartition(2)


def test_matches_and_lines(files):
    asks = [matching.Ask("n", r"if \("), matching.Ask("js", r"if \(", langs=("js",)), matching.Ask("any", "no", matching.ANY), matching.Ask("held", r"if \(|no", matching.LINES)]
    got = {r["path"]: (r["n"], r["js"], r["any"], r["held"]) for r in matching.tallied(files, asks).collect()}
    for path, text, lang, _ in TEXTS:
        n = len(re.findall(r"if \(", text))
        assert got[path] == (n, n if lang == "js" else 0, int("no" in text), sum(bool(re.search(r"if \(|no", x)) for x in text.split("\n"))), path


def test_gates_close_what_lacks_their_sum(files):
    asks = [matching.Ask("n", r"if \("), matching.Ask("z", "[a-z]", gates=((("n",), 2), (("lines",), 3)))]
    got = {r["path"]: r["z"] for r in matching.tallied(files, asks).collect()}
    assert got == {"a": len(re.findall("[a-z]", TEXTS[0][1])), "b": 0, "c": 0, "d": 15}


def test_gates_of_signals_are_parts_of_their_tests():
    for i, s in enumerate(authorship.SIGNALS):
        for names, least in authorship._gates(i, s, list(s.counts)):
            assert any(re.fullmatch(r".+ >=? \d+", part) and int(re.search(r"\d+$", part)[0]) in (least, least - 1) for part in s.value.test.split(" and ")), (s.name, names)


def test_arrow_states_all_but_the_patterns_that_look_around(files):
    every = [p for s in authorship.SIGNALS for p in [*s.counts.values(), *(p for p, _ in s.any_of)]] + [r[-1] for r in rules.RULES]
    own = [p for p in dict.fromkeys(every) if matching.automaton(p)]
    assert len(own) > 200
    matching.tallied(files, [matching.Ask(f"p{n}", p) for n, p in enumerate(own)]).collect()


@pytest.mark.parametrize("name", ["attribution_posterior"])
def test_patterns_of_models_run_in_batches(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "RLIKE" not in plan


@pytest.mark.parametrize("name", ["compliance_controls", "compliance_scores"])
def test_rules_run_in_batches(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # The three rules that look ahead stay columns.
    assert "MapInArrow" in plan and plan.count("RLIKE") <= 3


def test_lines_that_break_rules(spark):
    text = 'password = "secret1" + hash(x)\nx = "http://localhost/"; y = "http://other/"\n\npassword: z\npassword = "secret2"'
    rows = spark.createDataFrame([("a", text), ("b", None), ("c", "plain")], "path string, content string")
    found = {(r["path"], r["control"]): r["findings"] for r in rules.compliance(rows).collect()}
    assert [found["a", c] for c in ("SOC2-CC6.1", "SOC2-CC6.7", "GDPR-Art25", "HIPAA-§164.312(e)", "SOC2-A1.2")] == [2, 1, 2, 1, 1]
    assert all(found[path, "SOC2-CC6.7"] == 0 and found[path, "SOC2-A1.2"] == 1 for path in "bc")


@pytest.mark.parametrize("name", ["signal_likelihood", "authorship_core_signals"])
def test_patterns_of_signals_run_in_batches(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "RegExp" not in plan and "regexp" not in plan.lower()
