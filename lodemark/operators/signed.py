"""Signed exports of any size: a tree of digests over the rows, and one signature over its root.

A row's digest is that of its canonical text. FAN neighbours by id are digested together, and so on up to one
root, so no task holds more than FAN digests and any part can be verified by itself. Ids may have gaps.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN, LEVELS = 256, 4


def hmac_sha256(text: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a text, from two digests."""
    padded = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in padded).hex() for p in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner)), text.cast("binary")), 256))
    return F.sha2(F.concat(F.unhex(F.lit(outer)), first), 256)


def tree_root(rows: DataFrame, key: str, id: str, text: str) -> DataFrame:
    """(key, rows, root): the root of each key's tree; LEVELS deep, more where ids ask for it."""
    top = rows.agg(F.max(id)).first()[0] or 0
    levels = LEVELS
    while FAN**levels <= top:
        levels += 1
    out = rows.select(key, F.col(id).cast("long").alias("_id"), F.sha2(F.col(text).cast("binary"), 256).alias("_hash"), F.lit(1).cast("long").alias("_n"))
    for _ in range(levels):
        part = F.array_sort(F.collect_list(F.struct("_id", "_hash", "_n")))
        out = out.groupBy(key, F.expr(f"_id div {FAN}").alias("_up")).agg(part.alias("p"))
        out = out.select(key, F.col("_up").alias("_id"), F.sha2(F.array_join(F.transform("p", lambda x: x["_hash"]), "\n"), 256).alias("_hash"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["_n"]).alias("_n"))
    return out.select(key, F.col("_n").alias("rows"), F.col("_hash").alias("root"))


def signed_documents(rows: DataFrame, chains: DataFrame, key: str, id: str, text: str, secret: bytes) -> DataFrame:
    """(key, rows, root, chain_valid, broken_at, document, signature) for each key.

    ``chains`` has the key with ``valid`` and ``first_broken`` of each of its chains; one broken chain makes the verdict.
    """
    verdict = chains.groupBy(key).agg(F.min("valid").alias("chain_valid"), F.min("first_broken").alias("broken_at"))
    out = tree_root(rows, key, id, text).join(verdict, key, "left").withColumn("chain_valid", F.coalesce("chain_valid", F.lit(True)))
    document = F.to_json(F.struct(F.col(key), F.col("rows").alias("event_count"), "chain_valid", "broken_at", "root"))
    return out.withColumn("document", document).withColumn("signature", hmac_sha256(F.col("document"), secret))
