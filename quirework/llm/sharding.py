"""Sharding by a permutation-filled lookup table.

Each shard walks the prime-sized table in its own preference order (offset and
skip from its name); shards take turns to claim their next free slot. A key's slot
is its hash modulo the table's size, so placement is one broadcast lookup; the
table has exactly ``table_size`` rows whatever the input is.

Defined results: a null key is placed as the empty string; repeated keys go to one
shard; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
SHARDS = 64
#: The largest table that is broadcast (rows).
MAX_TABLE = 5_000_000


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    if size < 2 or size > MAX_TABLE or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size is to be a prime of at most 5,000,000")
    if not 0 < len(shards) <= size:
        raise ValueError("there are to be from one to as many shards as slots")

    def number(name: str, what: str) -> int:
        return int.from_bytes(hashlib.sha256(f"{what}:{name}".encode()).digest()[:8], "big")

    at = [number(s, "offset") % size for s in shards]
    skip = [number(s, "skip") % (size - 1) + 1 for s in shards]
    owner, filled = [-1] * size, 0
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            owner[at[i]] = i
            filled += 1
            if filled == size:
                return np.array(owner, dtype=np.int32)


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def assign(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, table_size: int = TABLE_SIZE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns to keep, slot, shard) for every row."""
    owner = lookup_table(shard_names(shards), table_size)
    table = docs.sparkSession.createDataFrame([(i, int(s)) for i, s in enumerate(owner)], "slot_ int, shard int")
    keyed = docs.select(F.col(key), *keep, slot_of(F.col(key), table_size).alias("slot"))
    return keyed.join(F.broadcast(table), keyed["slot"] == table["slot_"]).select(key, *keep, "slot", "shard")
