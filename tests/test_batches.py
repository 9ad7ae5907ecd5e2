"""Python operators over whole files get few of them at once."""

import pytest
from pyspark.sql import functions as F

from lodemark.functions import batches
from lodemark.operators import authorship, source, structure

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("run", [source.facts, structure.parse, structure.measured, structure.taint_paths, structure.clones, lambda files: authorship.structured(files.withColumnRenamed("content", "text")), lambda files: authorship.function_scores(files.withColumnRenamed("content", "text"))])
def test_batches_are_bounded(spark, run):
    before = spark.conf.get(NAME)
    spark.conf.set(NAME, "10000")
    run(spark.range(1).select(F.lit("a.ts").alias("path"), F.lit("x").alias("content"), F.lit("typescript").alias("lang")))
    held = int(spark.conf.get(NAME))
    spark.conf.set(NAME, before)
    assert held <= 1000


def test_a_file_of_one_row_group_is_dealt_over_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(100).coalesce(1)
    assert batches.spread(one, "id").rdd.getNumPartitions() >= cores
    assert sorted(r.id for r in batches.spread(one, "id").collect()) == list(range(100))
    many = spark.range(100).repartition(cores)
    assert batches.spread(many, "id") is many
