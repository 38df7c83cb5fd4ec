"""Shard placement by a permutation-filled lookup table.

Every shard orders the slots of a prime-sized table by its own permutation; the shards take turns, each claiming its
next unclaimed slot, until the table is full. A row goes to the shard of slot hash(key) mod size. The table depends on
the shards only, so it is bounded by `slots`, whatever the data; when a shard goes, few other keys move.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime of at least 100 slots a shard keeps shard sizes within about 1 %.
SLOTS = 5003
MAX_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Slot -> index of the shard. Shard k prefers (offset + j * skip) mod slots for j = 0, 1, ..., both from its name's md5."""
    if not _is_prime(slots) or slots > MAX_SLOTS:
        raise ValueError(f"slots must be a prime up to {MAX_SLOTS}")
    if not shards or len(shards) > slots or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct names, one at least and as many as slots at most")
    first, step = [], []
    for name in shards:
        h = hashlib.md5(name.encode()).hexdigest()
        first.append(int(h[:15], 16) % slots)
        step.append(int(h[15:30], 16) % (slots - 1) + 1)
    owner, at, free = [-1] * slots, first[:], slots
    while True:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                return owner


def key_slot(key: Column, slots: int) -> Column:
    """md5 of the key as text, its first 60 bits modulo the table's size; a null key counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """df with `slot` and `shard`.

    Every row stays, repeated rows and ties of the key go to the same shard, an empty table stays empty, a null key is
    placed as the empty text, a long one by its whole text. Columns of df named slot or shard are replaced, also where one
    of them is the key; all others stay. The join side that is broadcast has `slots` rows, MAX_SLOTS at most; the rows of
    df are not shuffled.
    """
    spark = df.sparkSession
    own = _free(df, "slot_number")
    filled = ",".join(map(str, lookup_table(shards, slots)))
    names = F.array(*[F.lit(x) for x in shards])
    slot_of = spark.range(1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("at", "k")).select(F.col("at").cast("long").alias(own), F.element_at(names, F.col("k").cast("int") + 1).alias("shard"))
    placed = df.withColumn(own, key_slot(F.col("`" + key.replace("`", "``") + "`"), slots)).drop("slot", "shard")
    return placed.join(F.broadcast(slot_of), own, "left").withColumnRenamed(own, "slot")


def _free(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, slots: int = SLOTS, files: int = 8) -> None:
    """One folder for each shard; a hash of the row's number deals its rows to `files` writers, so no shard is one task.

    Rows are placed as by place(): null keys as the empty text, repeated rows all, further columns kept. Long texts are
    written whole. An empty table writes no shard. The path must not exist."""
    placed = place(df, key, shards, slots)
    deal = _free(placed, "deal")
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files))
    placed.withColumn(deal, number).repartition("shard", deal).drop(deal).write.partitionBy("shard").parquet(path)
