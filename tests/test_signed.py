"""Signed exports: signatures as the standard library makes them; any change shows."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from lodemark.operators import signed


def documents(spark, rows, valid=True):
    frame = spark.createDataFrame(rows, "org int, id long, text string")
    chains = spark.createDataFrame([(1, valid, None if valid else 7), (1, True, None)], "org int, valid boolean, first_broken long")
    return {r["org"]: r for r in signed.signed_documents(frame, chains, "org", "id", "text", b"secret").collect()}


def root(rows):
    level = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows}
    top = max(level)
    for _ in range(max(signed.LEVELS, next(n for n in range(20) if signed.FAN**n > top))):
        up = {}
        for i in sorted(level):
            up.setdefault(i // signed.FAN, []).append(level[i])
        level = {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in up.items()}
    return level[0]


@pytest.mark.parametrize("ids", [[0], [3, 9, 255, 256, 70_000], [5, 256**4 + 1]])
def test_root_and_signature(spark, ids):
    rows = [(1, i, f"entry {i} é") for i in ids]
    got = documents(spark, rows)[1]
    assert got["rows"] == len(ids) and got["root"] == root([r[1:] for r in rows])
    assert got["signature"] == hmac.new(b"secret", got["document"].encode(), hashlib.sha256).hexdigest()


def test_changes_show(spark):
    rows = [(o, i, f"entry {i}") for o in (1, 2) for i in range(600)]
    before = documents(spark, rows)
    changed = documents(spark, [(o, i, t + "!" if (o, i) == (1, 300) else t) for o, i, t in rows])
    assert before[1]["signature"] != changed[1]["signature"] and before[2]["signature"] == changed[2]["signature"]
    assert documents(spark, rows[1:])[1]["signature"] != before[1]["signature"]
    broken = documents(spark, rows, valid=False)[1]
    assert not broken["chain_valid"] and broken["broken_at"] == 7 and broken["signature"] != before[1]["signature"]


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"y" * 100])
def test_keys_of_any_length(spark, key):
    got = spark.range(1).select(signed.hmac_sha256(F.lit("text"), key).alias("h")).first()["h"]
    assert got == hmac.new(key, b"text", hashlib.sha256).hexdigest()
