"""Sharding by a permutation-filled lookup table: shards take turns claiming slots of a prime-sized table, each in its own order of preference.

The table has `slots` entries whatever the data, so the broadcast side has a fixed size and a key is placed by one probe of a hash table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = 64


def preference(name: str, slots: int) -> tuple[int, int]:
    """Where a shard's permutation of the slots begins, and its step (never 0, so in a prime-sized table it reaches every slot)."""
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the position of its shard in shards; every shard has floor or ceil of slots / shards of them."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards: one to `slots` different names")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime")
    prefer = [preference(s, slots) for s in shards]
    at, owner, taken = [start for start, _ in prefer], [-1] * slots, 0
    while True:
        for k, (_, step) in enumerate(prefer):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step) % slots
            owner[at[k]] = k
            taken += 1
            if taken == slots:
                return owner


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The table as (slot, shard). It travels as one binary literal, two bytes a slot."""
    packed = b"".join(k.to_bytes(2, "big") for k in lookup_table(shards, slots))
    entry = F.conv(F.hex(F.substring(F.lit(packed), (F.col("id") * 2 + 1).cast("int"), F.lit(2))), 16, 10).cast("int")
    return spark.range(slots).select(F.col("id").alias("slot"), entry.alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 8 hex digits of the key's MD5 modulo slots; a null key hashes as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % slots


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int | list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """All columns of df, then slot (long) and shard (int), which replace columns of those names.

    Equal keys, repeated rows and null keys each land in one shard. No exchange: the table is broadcast (slots rows).
    """
    names = [f"shard-{k:05d}" for k in range(shards)] if isinstance(shards, int) else list(shards)
    rows = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(f"`{key}`"), slots))
    return rows.join(F.broadcast(table_frame(df.sparkSession, names, slots)), "slot").select(*[F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")], "slot", "shard")


def oracle_sql(shards: int = SHARDS, slots: int = SLOTS) -> str:
    """Placement in SQL over the table as a literal (tests hold the table against its definition)."""
    packed = "".join(f"{k:04x}" for k in lookup_table([f"shard-{k:05d}" for k in range(shards)], slots))
    return (
        f"WITH t AS (SELECT '{packed}' AS packed), d AS (SELECT doc_id, source, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % {slots} AS slot FROM documents) "
        "SELECT doc_id, source, slot, CAST(('0x' || substr(packed, CAST(slot * 4 + 1 AS INTEGER), 4))::BIGINT AS INTEGER) AS shard FROM d, t"
    )
