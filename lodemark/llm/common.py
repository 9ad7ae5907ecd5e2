"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import BATCH_ROWS, small_batches  # noqa: F401
from ..functions.checkpoint import checkpointed, shared_folder  # noqa: F401

#: Rows of a table that may be broadcast; the callers count before they use it.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return a worker's free memory to the system; an idle worker would keep it while others need it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only one C library has this call
        ctypes.CDLL(None).malloc_trim(0)


def md5_long(*parts):
    """60 bits of the md5 of the parts' text, joined by ``:``; null parts are empty."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) if not isinstance(p, str) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch():
    """A list that fills with the paths of all tables written to the shared folder inside."""
    own: list[str] = []
    _SCRATCH.append(own)
    try:
        yield own
    finally:
        _SCRATCH.remove(own)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for a table that a later step reads again."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for own in _SCRATCH:
        own.append(path)
    return path


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet (zstd) and read again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no plan needs since its lineage was cut.

    They go when the driver's JVM collects its garbage, which a short loop may never cause.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, an action's shuffle files go when it ends, and not when the driver's garbage happens to be collected.

    For actions whose result is written or collected; the session's own setting is restored.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, keep=None) -> DataFrame:
    """At most ``bound`` labelled rows (doc_id, label), those with the least md5 of the id.

    Rows whose id is null or whose label is not 0 or 1 are left out; of repeated ids the smallest label counts.
    ``keep`` is a condition on ``doc_id`` (a fold). Only ids that ``docs`` holds are drawn.
    """
    rows = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).dropna().where(F.col("label").isin(0, 1))
    if keep is not None:
        rows = rows.where(keep(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"))
    rows = rows.join(docs.select("doc_id"), "doc_id", "left_semi")
    return rows.orderBy(md5_long(F.col("doc_id")), "doc_id").limit(bound)


def one_each(docs: DataFrame, sample: DataFrame, *first) -> DataFrame:
    """One row for each id of a bounded ``sample``: of rows that share it the least by ``first``, then by the text's md5.

    Rows combine before they are shuffled, so no more than the sample's bound ever comes together.
    """
    rows = docs.join(F.broadcast(sample), "doc_id")
    rest = [c for c in rows.columns if c != "doc_id"]
    order = F.struct(*first, F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("by_text"))
    return rows.groupBy("doc_id").agg(F.min_by(F.struct(*rest), order).alias("_row")).select("doc_id", "_row.*")


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus
