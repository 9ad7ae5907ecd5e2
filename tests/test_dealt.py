"""Lines of scans are dealt over tasks by their number."""

import pytest

from lodemark.plans import registry
from lodemark.sources import governance

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["repo_file_versions", "latest_violation_per_file"])
def test_tasks_grow_with_the_lines_and_not_their_shares(spark, monkeypatch, name):
    run = registry.queries()[name]
    expected = sorted(run(spark, SF).collect())
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    for share in (lines // 10, lines // 40):
        monkeypatch.setattr(governance, "LINES_A_TASK", share)
        tasks = governance.Governance(spark, SF).dealt().tasks
        assert tasks == -(-lines // share) and lines / tasks <= share
        rows = run(spark, SF)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        # One exchange of the lines, by the scan, serves the files of a scan and their join.
        assert plan.count(f", {tasks}), REPARTITION_BY_NUM") == 1 and "_groupingexpression" not in "".join(x for x in plan.split("\n") if "Exchange" in x)
        assert sorted(rows.collect()) == expected


def test_few_lines_are_dealt_over_all_cores(spark):
    assert governance.Governance(spark, SF).dealt().tasks == spark.sparkContext.defaultParallelism
    assert governance.Governance(spark, SF).tasks == 0
