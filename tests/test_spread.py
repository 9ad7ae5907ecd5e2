"""Files of programs that lie in one row group are parsed on all cores."""

from lodemark.plans import modules
from lodemark.sources.governance import Governance


def test_programs_of_one_row_group(spark):
    files = modules.Program(Governance(spark, "/root/testdata/sf0.001")).files
    rows = files.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    assert sum(n > 0 for n in rows) >= spark.sparkContext.defaultParallelism
