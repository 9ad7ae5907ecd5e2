"""Alerts with timers against a plain fold, however the log is cut."""

import os
import random

import pytest

from lodemark.streaming import events, snooze


@pytest.mark.parametrize("cuts", [1, 5])
def test_alerts_do_not_depend_on_the_cut(spark, tmp_path, cuts):
    rng = random.Random(1)
    rows = sorted((rng.randint(0, 72 * 3600) * 1000, i, rng.randint(1, 4), rng.choice(["error", "click", "purchase", "view"])) for i in range(120))
    rows.append((100 * 3600 * 1000, 999, 9, "view"))
    size = -(-len(rows) // cuts)
    os.makedirs(tmp_path / "log")
    for k in range(cuts):
        part = rows[k * size : (k + 1) * size]
        frame = spark.createDataFrame([(i, ms, u, t) for ms, i, u, t in part], "event_id long, ms long, user_id long, event_type string")
        frame = frame.selectExpr("event_id", "cast(timestamp_millis(ms) as timestamp_ntz) as ts", "user_id", "event_type", "0D as value", "'' as props")
        frame.toPandas().to_parquet(tmp_path / "log" / f"{k}.parquet", coerce_timestamps="us")
        os.utime(tmp_path / "log" / f"{k}.parquet", (1000 + k, 1000 + k))
    got = {tuple(r) for r in events.run_once(snooze.alerts(events.source(spark, f"file://{tmp_path}/log", 1))).collect()}
    end = rows[-1][0] - 10 * 60 * 1000
    expected = set()
    for user in range(1, 5):
        _, out = snooze.fold(("none", 0), [(ms, i, t) for ms, i, u, t in rows if u == user and ms <= end], end)
        expected |= {(user, at, kind) for at, kind in out}
    assert got == expected and {k for *_, k in got} == {"opened", "snoozed", "reopened", "resolved"}


def test_fold_by_hand():
    hour = 3600 * 1000
    rows = [(0, 1, "error"), (hour, 2, "click"), (2 * hour, 3, "click"), (8 * hour, 4, "error"), (9 * hour, 5, "purchase"), (9 * hour, 6, "purchase")]
    state, out = snooze.fold(("none", 0), rows, 10 * hour)
    assert out == [(0, "opened"), (hour, "snoozed"), (7 * hour, "reopened"), (9 * hour, "resolved")] and state[0] == "none"
    assert snooze.fold(("snoozed", 5), [], 4) == (("snoozed", 5), []) and snooze.fold(("snoozed", 5), [], 5)[1] == [(5, "reopened")]


def test_query(spark):
    from lodemark.plans import registry

    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("unix_micros(cast(ts as timestamp)) div 1000 as ms", "event_id", "user_id", "event_type").collect()
    end = max(r["ms"] for r in rows) - 10 * 60 * 1000
    expected = set()
    for user in {r["user_id"] for r in rows}:
        _, out = snooze.fold(("none", 0), sorted((r["ms"], r["event_id"], r["event_type"]) for r in rows if r["user_id"] == user and r["ms"] <= end), end)
        expected |= {(user, *o) for o in out}
    assert {tuple(r) for r in registry.queries()["stream_snoozed_alerts"](spark, "/root/testdata/sf0.001").collect()} == expected and expected
