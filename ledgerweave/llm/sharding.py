"""Placement of keys on shards by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size. The shards take turns, each
claiming the first slot in its order that is still free, until all are taken: shares differ by one slot at most,
and a shard that comes or goes moves few other slots. The table is built once, from the shards' names alone, and its
size is a parameter, so it is broadcast; a key's place is one hash and one lookup.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import absent, named

#: A prime well over a hundred times the number of shards; the table then takes under 2 MB.
SLOTS = 65_537
SHARDS = tuple(f"shard-{k:03d}" for k in range(128))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot the number of its shard in shards."""
    if not shards or len({*shards}) != len(shards):
        raise ValueError("shards must be distinct, and one at least")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime that is no less than the number of shards")
    start, step = [], []
    for name in shards:
        h = hashlib.sha256(name.encode()).digest()
        start.append(int.from_bytes(h[:8], "big") % slots)
        step.append(int.from_bytes(h[8:16], "big") % max(slots - 1, 1) + 1)
    table, turn = [-1] * slots, 0
    for _ in range(slots):
        k = turn % len(shards)
        while table[start[k]] >= 0:
            start[k] = (start[k] + step[k]) % slots
        table[start[k]] = k
        turn += 1
    return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of its MD5, which every SQL engine has; a null key is an empty one."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots


def table_frame(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) from one literal."""
    numbers = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",")
    named = F.element_at(F.split(F.lit("\n".join(shards)), "\n"), F.col("k").cast("int") + 1)
    return spark.range(1).select(F.posexplode(numbers).alias("slot", "k")).select(F.col("slot").cast("long").alias("slot"), F.col("k").cast("int").alias("shard"), named.alias("shard_name"))


def place(rows: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """rows with slot, shard (its number) and shard_name. Equal keys go together; a null key is placed as an empty string.

    Other columns of rows with these names are replaced; the key never is: if it has one of them, the new column has an underscore
    before it. Repeated rows stay; no rows give none.
    """
    names = absent([key], "slot", "shard", "shard_name")
    inner = absent(rows.columns, *names)
    table = table_frame(rows.sparkSession, shards, slots).toDF(*inner)
    placed = rows.withColumn(inner[0], slot(named(key), slots)).join(F.broadcast(table), inner[0])
    new = {n.lower() for n in names}
    return placed.select(*[named(c) for c in rows.columns if c.lower() not in new], *[F.col(i).alias(n) for i, n in zip(inner, names)])
