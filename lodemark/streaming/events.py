"""Structured Streaming over the event log: ingestion, windows, deduplication, state.

Late data: events may come ten minutes late; later ones are dropped. Every function takes and
returns a streaming DataFrame; :func:`run_once` drives one with an available-now trigger.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.checkpoint import shared_folder

LATE = "10 minutes"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, path: str, files: int = 4) -> DataFrame:
    """The event log as a stream, in event time."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


#: What three hosts send of a pull request, as one schema; each fills its own part.
DELIVERY = (
    "action string, pull_request struct<number:int,head:struct<sha:string>>, repository struct<full_name:string>, "
    "object_kind string, object_attributes struct<iid:int,action:string,last_commit:struct<id:string>>, project struct<path_with_namespace:string>, "
    "pullrequest struct<id:int,state:string,source:struct<commit:struct<hash:string>>>"
)


def webhooks(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, repo, pr_number, head_sha, action) of pull-request deliveries of three hosts, and those that cannot be read.

    ``raw`` has a ``payload``; only deliveries that open or change a pull request are good.
    """
    rows = raw.withColumn("body", F.from_json("payload", DELIVERY))
    b = lambda name: F.col(f"body.{name}")
    merge = b("object_kind") == "merge_request"
    host = F.when(b("pull_request.number").isNotNull(), "github").when(merge & b("object_attributes.iid").isNotNull(), "gitlab").when(b("pullrequest.id").isNotNull(), "bitbucket")
    repo = F.coalesce(b("repository.full_name"), b("project.path_with_namespace"))
    number = F.coalesce(b("pull_request.number"), b("object_attributes.iid"), b("pullrequest.id"))
    sha = F.coalesce(b("pull_request.head.sha"), b("object_attributes.last_commit.id"), b("pullrequest.source.commit.hash"))
    action = F.coalesce(b("action"), b("object_attributes.action"), F.lower(b("pullrequest.state")))
    rows = rows.select("*", host.alias("host"), repo.alias("repo"), number.alias("pr_number"), sha.alias("head_sha"), action.alias("action"))
    good = F.col("host").isNotNull() & F.col("repo").isNotNull() & F.col("action").isin("opened", "synchronize", "reopened", "open", "update", "reopen")
    return rows.where(good).select("host", "repo", "pr_number", "head_sha", "action"), rows.where(~F.coalesce(good, F.lit(False))).select("payload")


def of_user(rows: DataFrame, user_id: int) -> DataFrame:
    """The change subscription of one subscriber."""
    return rows.where(F.col("user_id") == user_id)


def pages(rows: DataFrame) -> DataFrame:
    """Errors that wake someone: P1 from 15 on, P2 from 10 on."""
    value = F.col("value")
    level = F.when(value >= 15, "P1").when(value >= 10, "P2")
    return rows.where(F.col("event_type") == "error").select("event_id", level.alias("level")).where("level is not null")


def rate_windows(rows: DataFrame, width: str = "1 hour", limit: int = 5) -> DataFrame:
    """Calls of each user in fixed windows, and whether they pass the limit."""
    counts = rows.withWatermark("ts", LATE).groupBy("user_id", F.window("ts", width)).agg(F.count("*").alias("calls"))
    return counts.select("user_id", F.col("window.start").alias("start"), "calls", (F.col("calls") > limit).alias("limited"))


def sliding_rates(rows: DataFrame, width: str = "1 hour", step: str = "10 minutes") -> DataFrame:
    counts = rows.withWatermark("ts", LATE).groupBy("user_id", F.window("ts", width, step)).agg(F.count("*").alias("calls"))
    return counts.select("user_id", F.col("window.start").alias("start"), "calls")


def presence(rows: DataFrame, gap: str = "5 hours") -> DataFrame:
    """Sessions of each user, ended by a gap without events."""
    found = rows.withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("events"))
    return found.select("user_id", F.col("session_window.start").alias("start"), "events")


def alerts_once(rows: DataFrame) -> DataFrame:
    """The first alert of each key within the watermark; repeats are dropped by state."""
    return rows.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def baselines(rows: DataFrame) -> DataFrame:
    """Each user's running baseline (n, ema), kept as state and emitted as it changes.

    Within a micro-batch events are folded in order of time, then id.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema = state.get if state.exists else (0, 0.0)
        # Only times, ids and values are held, as flat arrays, to put a batch in order.
        parts = [(b["ts"].to_numpy(), b["event_id"].to_numpy(), b["value"].to_numpy()) for b in batches]
        times, ids, values = (np.concatenate(x) for x in zip(*parts, strict=True))
        for value in values[np.lexsort((ids, times))]:
            n += 1
            ema = value if n == 1 else ema + min(0.3, 1.0 / n) * (value - ema)
        state.update((n, float(ema)))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "ema": [float(ema)]})

    return rows.groupBy("user_id").applyInPandasWithState(fold, "user_id long, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)


def fixed_windows(rows: DataFrame, width: float = 3600.0, limit: int = 5) -> DataFrame:
    """(user_id, windows, limited): windows of ``width`` seconds that start at a user's first call after the last one's end.

    The state is the open window's start and count; calls beyond ``limit`` in a window are limited.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count, windows, limited = state.get if state.exists else (-1e18, 0, 0, 0)
        for t in np.sort(np.concatenate([b["ts"].astype("int64").to_numpy() / 1e9 if str(b["ts"].dtype).startswith("datetime64[ns") else b["ts"].to_numpy().astype("datetime64[us]").astype("int64") / 1e6 for b in batches])):
            if t >= start + width:
                start, count, windows = float(t), 0, windows + 1
            count += 1
            limited += count > limit
        state.update((start, count, windows, limited))
        yield pd.DataFrame({"user_id": [key[0]], "windows": [windows], "limited": [limited]})

    return rows.groupBy("user_id").applyInPandasWithState(fold, "user_id long, windows long, limited long", "start double, count long, windows long, limited long", "update", GroupStateTimeout.NoTimeout)


def run_once(rows: DataFrame, mode: str = "append", keys: list[str] | None = None, newest: str | None = None) -> DataFrame:
    """All that the stream gives for what its source holds now, as a batch table.

    Results and the stream's checkpoint go to the shared folder. Updates of a key replace
    each other: with ``keys``, the row with the largest ``newest`` counts.
    """
    spark = rows.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = rows.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    run = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    out = spark.read.schema(schema).parquet(f"{base}/out")
    if keys:
        rest = [c for c in schema.names if c not in keys]
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), newest).alias("_row")).select(*keys, "_row.*")
    return out.select(*schema.names)


def _files(spark: SparkSession, folder: str):
    """The file system of a folder, and a maker of its paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def append_once(rows: DataFrame, batch_id: int, folder: str) -> bool:
    """Append a micro-batch to a table of files exactly once, and say whether it was new.

    The rows are written aside and then renamed to ``batch=<id>``, which is one step where the file system renames
    in one. A batch that is there already is left as it is, so a replay adds nothing; what a crash leaves aside is
    never read, and the replay writes its own.
    """
    spark = rows.sparkSession
    fs, path = _files(spark, folder)
    done = path(f"{folder}/batch={batch_id}")
    if fs.exists(done):
        return False
    aside = f"{folder}/_aside/{batch_id}-{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    if fs.rename(path(aside), done):
        return True
    fs.delete(path(aside), True)  # another attempt was faster
    return False


def appended(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The committed rows of a table that ``append_once`` fills."""
    return spark.read.schema(f"{schema}, batch bigint").option("basePath", folder).parquet(folder).drop("batch")


def append_stream(rows: DataFrame, folder: str) -> None:
    """Append a stream to a table of files to its end; run again, it takes up where it stopped."""
    fs, path = _files(rows.sparkSession, folder)
    fs.mkdirs(path(folder))
    query = rows.writeStream.foreachBatch(lambda df, batch_id: append_once(df, batch_id, folder)).option("checkpointLocation", f"{folder}/_progress").trigger(availableNow=True).start()
    query.awaitTermination()


def split_late(rows: DataFrame, schema: str) -> tuple[DataFrame, int]:
    """The rows of a stream (event_id, ts) that are not late, each event once, and how many came too late.

    A row is late if it is LATE or more behind the latest time that the batches before have seen. The number is
    Spark's own count of rows that it drops by the watermark. Late rows are those of the source that are not in the result.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    fs, path = _files(spark, folder)
    fs.mkdirs(path(folder))
    kept = rows.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])
    query = kept.writeStream.foreachBatch(lambda df, batch_id: append_once(df, batch_id, folder)).option("checkpointLocation", f"{folder}/_progress").trigger(availableNow=True).start()
    query.awaitTermination()
    late = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    return appended(spark, folder, schema), late
