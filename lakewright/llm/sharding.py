"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table, from an
offset and a skip drawn from two hashes of its name.  Shards take turns, each claiming
the first slot of its order that is free, until the table is full.  A row's slot is a
hash of its key modulo the table size, its shard the slot's owner: constant time, even
loads, and a shard that leaves moves little besides its own slots.

The table has SIZE slots whatever the input, so it is safe to broadcast.

Defined cases: a null key counts as the empty text; equal keys share a shard; an empty
table gives an empty result; a column named slot or shard is replaced, others pass
through, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from .common import own_name

SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def fill(shards: tuple[str, ...] | list[str], size: int = SIZE) -> list[int]:
    """Owner (index into shards) of every slot; size is prime and at least len(shards)."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if size < len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be a prime, no less than the number of shards")
    at = [_hash(s, "offset") % size for s in shards]
    skip = [_hash(s, "skip") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    owner, free = [-1] * size, size
    while True:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            owner[at[k]] = k
            free -= 1
            if not free:
                return owner


def slot(key: Column, size: int = SIZE) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long") % size


def place(df: DataFrame, key: str = "doc_id", shards: tuple[str, ...] | list[str] = SHARDS, size: int = SIZE) -> DataFrame:
    """df with slot and shard."""
    spark = df.sparkSession
    at = own_name(df, "slot")
    table = spark.createDataFrame([(i, shards[k]) for i, k in enumerate(fill(shards, size))], f"{at} long, shard string")
    own = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    keyed = df.select(*own, slot(F.col(f"`{key}`"), size).alias("slot"))
    return keyed.join(F.broadcast(table), F.col("slot") == F.col(at)).drop(at)


def write(df: DataFrame, path: str, key: str = "doc_id", shards: tuple[str, ...] | list[str] = SHARDS, size: int = SIZE) -> None:
    """Write df as one folder of Parquet files a shard."""
    place(df, key, shards, size).write.partitionBy("shard").parquet(path)
