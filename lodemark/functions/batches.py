"""How many rows a Python worker gets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows that Spark hands to a Python worker at once; long texts make a batch of its default, 10,000, heavy.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's rows per Arrow batch; a lower setting stays.

    A batch of whole texts is held by the JVM, outside its heap, and by the worker at once. Spark reads the
    setting when a plan runs, after the operator has returned it, so it cannot be set back here.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` over four tasks a core if it has fewer partitions than cores, else as it is.

    A file is cut at its row groups, so a large one of few groups leaves most cores idle. For steps that take
    far longer than moving their rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 4, key) if df.rdd.getNumPartitions() < cores else df
