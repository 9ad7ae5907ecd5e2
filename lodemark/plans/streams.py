"""Streams run to their end over the event table, against the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.checkpoint import shared_folder
from ..streaming import events, snooze
from .registry import query


def log(g):
    # As a pattern, for the source takes a single file only so.
    return events.source(g.spark, f"{g.sf_dir}/events.parque[t]")


def plain(df, column="start"):
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))


@query("stream_subscription", "SELECT event_id, event_type FROM events WHERE user_id = 7")
def stream_subscription(g):
    return events.run_once(events.of_user(log(g), 7).select("event_id", "event_type"))


@query("stream_pages", "SELECT event_id, CASE WHEN value >= 15 THEN 'P1' ELSE 'P2' END AS level FROM events WHERE event_type = 'error' AND value >= 10")
def stream_pages(g):
    return events.run_once(events.pages(log(g)))


@query("stream_rate_windows", "SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS calls, count(*) > 5 AS limited FROM events GROUP BY 1, 2")
def stream_rate_windows(g):
    return plain(events.run_once(events.rate_windows(log(g)), "update", ["user_id", "start"], "calls"))


@query("stream_sliding_rates", "SELECT user_id, time_bucket(INTERVAL 10 MINUTE, ts) - k * INTERVAL 10 MINUTE AS start, count(*) AS calls FROM events, (SELECT unnest(range(6)) AS k) GROUP BY 1, 2")
def stream_sliding_rates(g):
    return plain(events.run_once(events.sliding_rates(log(g)), "update", ["user_id", "start"], "calls"))


@query("stream_baselines", "SELECT user_id, count(*) AS n, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x, i: a + least(0.3::DOUBLE, 1.0::DOUBLE / i) * (x - a)), 6) AS ema FROM events GROUP BY 1")
def stream_baselines(g):
    return events.run_once(events.baselines(log(g)), "update", ["user_id"], "n").withColumn("ema", F.round("ema", 6))


@query("stream_alerts_once", "SELECT user_id, event_type FROM events GROUP BY 1, 2")
def stream_alerts_once(g):
    """One alert for each user and kind, however many events of it there are."""
    rows = events.alerts_once(log(g)).select("user_id", "event_type")
    return events.run_once(rows).distinct()


@query("stream_presence", "WITH b AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 5 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM b) SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, k")
def stream_presence(g):
    """Who is there: sessions that end after five hours without an event, as a batch over the same operator."""
    return plain(events.presence(g.table("events").withColumn("ts", F.col("ts").cast("timestamp"))))


@query("stream_fixed_windows", """WITH l AS (SELECT user_id, list(epoch_us(ts) / 1e6 ORDER BY ts, event_id) AS t FROM events GROUP BY 1)
    SELECT user_id, (z.w)::BIGINT AS windows, (z.l)::BIGINT AS limited FROM (SELECT user_id, list_reduce(list_prepend({'s': -1e18::DOUBLE, 'c': 0, 'w': 0, 'l': 0}, list_transform(t, lambda x: {'s': x::DOUBLE, 'c': 0, 'w': 0, 'l': 0})), lambda a, x: {'s': CASE WHEN x.s >= a.s + 3600 THEN x.s ELSE a.s END, 'c': CASE WHEN x.s >= a.s + 3600 THEN 1 ELSE a.c + 1 END, 'w': CASE WHEN x.s >= a.s + 3600 THEN a.w + 1 ELSE a.w END, 'l': CASE WHEN x.s < a.s + 3600 AND a.c + 1 > 5 THEN a.l + 1 ELSE a.l END}) AS z FROM l)""")
def stream_fixed_windows(g):
    """Rate windows that start at a user's first call."""
    return events.run_once(events.fixed_windows(log(g)), "update", ["user_id"], "windows")


@query("webhook_deliveries", """SELECT o_orderkey AS pr_number, ['github', 'gitlab', 'bitbucket'][(o_orderkey % 3)::INT + 1] AS host, 'team/r' || o_custkey % 9 AS repo, sha256(o_orderkey::VARCHAR)[1:8] AS head_sha, ['opened', 'update', 'open'][(o_orderkey % 3)::INT + 1] AS action FROM orders WHERE o_orderkey % 7 <> 0""")
def webhook_deliveries(g):
    """Deliveries of three hosts, each in its own shape; closed ones and odd ones are not read."""
    k, sha = F.col("o_orderkey").cast("string"), F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 8)
    repo, odd = F.concat(F.lit("team/r"), F.col("o_custkey") % 9), F.col("o_orderkey") % 7 == 0
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    one = text('{"action":"', F.when(odd, "closed").otherwise("opened"), '","pull_request":{"number":', k, ',"head":{"sha":"', sha, '"}},"repository":{"full_name":"', repo, '"}}')
    two = text('{"object_kind":"', F.when(odd, "push").otherwise("merge_request"), '","object_attributes":{"iid":', k, ',"action":"update","last_commit":{"id":"', sha, '"}},"project":{"path_with_namespace":"', repo, '"}}')
    three = text('{"pullrequest":{"id":', k, ',"state":"', F.when(odd, "MERGED").otherwise("OPEN"), '","source":{"commit":{"hash":"', sha, '"}}},"repository":{"full_name":"', repo, '"}}')
    which = F.col("o_orderkey") % 3
    good, _ = events.webhooks(g.table("orders").select(F.when(which == 0, one).when(which == 1, two).otherwise(three).alias("payload")))
    return good.select(F.col("pr_number").cast("long").alias("pr_number"), "host", "repo", "head_sha", "action")


@query("scan_appends", "SELECT event_id, user_id, event_type FROM events")
def scan_appends(g):
    """Rows appended by a stream; the second run and the replay of a batch add nothing."""
    folder = f"{shared_folder(g.spark)}/appends-{uuid.uuid4().hex}"
    rows = log(g).select("event_id", "user_id", "event_type")
    for _ in range(2):
        events.append_stream(rows, folder)
    if events.append_once(g.table("events").select("event_id", "user_id", "event_type"), 0, folder):
        raise AssertionError("a batch was committed twice")
    return events.appended(g.spark, folder, "event_id bigint, user_id bigint, event_type string")


@query("stream_late_rows", "WITH m AS (SELECT max(ts) AS top FROM events WHERE event_id % 97 <> 0) SELECT event_id, (SELECT count(*) FROM events, m WHERE event_id % 97 = 0 AND ts < top - INTERVAL 10 MINUTE) AS counted FROM events, m WHERE event_id % 97 = 0 AND ts < top - INTERVAL 10 MINUTE")
def stream_late_rows(g):
    """Events that come after the others and ten minutes or more behind them, set aside, with the stream's count of them."""
    folder = f"{shared_folder(g.spark)}/arrivals-{uuid.uuid4().hex}"
    rows = g.table("events")
    first = rows.where("event_id % 97 <> 0").agg(F.min("event_id")).first()[0]
    # Three arrivals: most, one early event, so that the watermark of the first counts, and those that may be late.
    arrival = F.when(F.col("event_id") == first, 1).when(F.col("event_id") % 97 == 0, 2).otherwise(0)
    for k in range(3):
        rows.where(arrival == k).coalesce(1).write.mode("append").parquet(folder)
    kept, late = events.split_late(events.source(g.spark, folder, 1).select("event_id", "ts"), "event_id bigint, ts timestamp")
    return rows.join(kept, "event_id", "left_anti").select("event_id", F.lit(late).cast("long").alias("counted"))


@query("stream_snoozed_alerts")
def stream_snoozed_alerts(g):
    """Alerts that open, sleep and wake by event-time timers, up to ten minutes before the last event."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = g.spark.conf.get(name)
    try:
        return events.run_once(snooze.alerts(log(g)))
    finally:
        g.spark.conf.set(name, before)
