"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: (offset + j * skip) mod size, both from a hash of its
name. Shards take turns, each claiming its next free slot, until the table is full. A row's key hashes to a slot and goes to the slot's
shard. Shares differ by one slot at most, and a shard that leaves moves few keys besides its own.

The table is a setting of bounded size, filled once on the driver. Rows are placed by DataFrame functions and a broadcast join with it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots and shards of the registered query. The table should hold a hundred slots or more for each shard.
SLOTS, SHARDS = 4099, 32
#: The largest table that is broadcast: 8 MB of integers.
MOST_SLOTS = 2_000_003


def _hash(kind: str, name: str) -> int:
    return int(hashlib.md5(f"{kind}:{name}".encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(names: Sequence[str], slots: int) -> list[int]:
    """The shard (position in names) of each slot. Names are unique, slots a prime of at least as many."""
    if not names or len(set(names)) < len(names) or not is_prime(slots) or not len(names) <= slots <= MOST_SLOTS:
        raise ValueError("the table needs unique names and a prime number of slots, from the number of names to MOST_SLOTS")
    table, left, turn = [-1] * slots, slots, 0
    at = [_hash("offset", x) % slots for x in names]
    skip = [_hash("skip", x) % (slots - 1) + 1 for x in names]
    while left:
        k = turn % len(names)
        while table[at[k]] >= 0:
            at[k] = (at[k] + skip[k]) % slots
        table[at[k]] = k
        turn, left = turn + 1, left - 1
    return table


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: the first 60 bits of its MD5, modulo the table's size. A null key counts as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % slots


def place(rows: DataFrame, key: str, names: Sequence[str], slots: int) -> DataFrame:
    """The rows with the columns slot and shard (position in names) added, or replaced where they exist. Repeated keys share a shard, null keys
    too; no rows give none. No shuffle: the table is broadcast, and its size is bounded by MOST_SLOTS."""
    table = rows.sparkSession.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(fill(names, slots))), "array<int>")).alias("slot", "shard"))
    table = table.select(F.col("slot").cast("long").alias("slot"), F.col("shard").cast("long").alias("shard"))
    own = rows.drop("slot", "shard") if key not in ("slot", "shard") else rows.withColumnRenamed(key, "_key").drop("slot", "shard").withColumnRenamed("_key", f"{key}_key")
    key = f"{key}_key" if key in ("slot", "shard") else key
    return own.withColumn("slot", slot_of(F.col(f"`{key}`"), slots)).join(F.broadcast(table), "slot")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return place(docs.select("doc_id"), "doc_id", [f"shard-{k}" for k in range(SHARDS)], SLOTS).select("doc_id", "slot", "shard")


OP4_SQL = f"""
WITH RECURSIVE prefs AS (
  SELECT list(('0x' || substr(md5('offset:shard-' || i), 1, 15))::BIGINT % {SLOTS} ORDER BY i) AS o,
         list(('0x' || substr(md5('skip:shard-' || i), 1, 15))::BIGINT % {SLOTS - 1} + 1 ORDER BY i) AS k
  FROM range({SHARDS}) r(i)),
fill(t, tab) AS (
  SELECT 0, list_transform(range({SLOTS}), lambda x: -1)
  UNION ALL
  SELECT t + 1, tab[1:s] || [t % {SHARDS}] || tab[s + 2:]
  FROM (SELECT t, tab, list_filter(list_transform(range({SLOTS}), lambda j: (o[t % {SHARDS} + 1] + j * k[t % {SHARDS} + 1]) % {SLOTS}), lambda p: tab[p + 1] = -1)[1] AS s
        FROM fill, prefs WHERE t < {SLOTS}) u),
full_table AS (SELECT tab FROM fill WHERE t = {SLOTS}),
d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents)
SELECT doc_id, slot, tab[slot + 1]::BIGINT AS shard FROM d, full_table"""
