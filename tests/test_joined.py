"""Joins over facts of source files deal both sides by key."""

from lodemark.functions.checkpoint import stored
from lodemark.operators import callgraph, modules, source


def test_small_files_of_many_rows_are_joined_by_key(spark):
    """The planner takes facts for small, as their files are; none of their joins may pass through the driver."""
    files = spark.createDataFrame([("src/a.ts", 'import { second } from "./b";\nexport function first(x) { return second(x); }', "typescript"), ("src/b.ts", "export function second(x) { return third(x); }\nfunction third(y) { db.query(y); }", "typescript")], "path string, content string, lang string")
    facts = stored(source.facts(files), "facts")
    found = modules.resolved(facts)
    means = callgraph.callees(facts, modules.uses(facts, found))
    calls = callgraph.edges(facts, means)
    assert sorted(tuple(r) for r in calls.select("caller", "to").collect()) == [("first", "second"), ("second", "third")]
    findings = spark.createDataFrame([("src/b.ts", 2)], "path string, line int")
    frames = [found, means, calls, callgraph.enclosing(findings, facts), modules.cross_file_taint(facts, modules.uses(facts, found)), modules.dead(facts, modules.uses(facts, found))]
    for df in frames:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
