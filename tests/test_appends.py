"""The append sink: replays add nothing, crashes leave nothing, late rows are counted."""

from lodemark.streaming import events

ROWS = "event_id bigint, user_id bigint"


def table(spark, ids):
    return spark.createDataFrame([(i, i % 3) for i in ids], ROWS)


def test_a_batch_is_committed_once(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    assert events.append_once(table(spark, range(5)), 0, folder)
    assert not events.append_once(table(spark, range(5)), 0, folder)
    assert events.append_once(table(spark, range(5, 8)), 1, folder)
    assert sorted(r["event_id"] for r in events.appended(spark, folder, ROWS).collect()) == list(range(8))


def test_a_crash_before_the_commit_leaves_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    assert events.append_once(table(spark, [1]), 0, folder)
    table(spark, [2, 3]).write.parquet(f"{folder}/_aside/1-crashed")
    assert [r["event_id"] for r in events.appended(spark, folder, ROWS).collect()] == [1]
    assert events.append_once(table(spark, [2, 3]), 1, folder)
    assert events.appended(spark, folder, ROWS).count() == 3


def test_an_empty_batch(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    assert events.append_once(table(spark, []), 0, folder)
    assert events.appended(spark, folder, ROWS).count() == 0


def test_late_rows_are_counted(spark, tmp_path):
    times = [[(1, "12:00"), (2, "13:00")], [(3, "12:55")], [(4, "12:10"), (5, "12:51"), (2, "13:00"), (6, "12:49")]]
    for k, rows in enumerate(times):
        frame = spark.createDataFrame([(i, f"2001-01-01 {t}:00") for i, t in rows], "event_id long, t string").selectExpr("event_id", "cast(t as timestamp_ntz) as ts", "0L as user_id", "'x' as event_type", "0D as value", "'' as props")
        frame.coalesce(1).write.parquet(f"file://{tmp_path}/in/part{k}")
    import glob
    import os
    import shutil

    os.makedirs(tmp_path / "log")
    for k in range(3):
        (part,) = glob.glob(f"{tmp_path}/in/part{k}/*.parquet")
        shutil.copy(part, tmp_path / "log" / f"{k}.parquet")
        os.utime(tmp_path / "log" / f"{k}.parquet", (1000 + k, 1000 + k))
    kept, late = events.split_late(events.source(spark, f"file://{tmp_path}/log", 1).select("event_id", "ts"), "event_id bigint, ts timestamp")
    assert late == 2 and sorted(r["event_id"] for r in kept.collect()) == [1, 2, 3, 5]
