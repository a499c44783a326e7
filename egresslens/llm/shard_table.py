"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size (an offset and a
skip from two hashes of its name). Shards take turns, each claiming its most preferred free slot,
until the table is full; so shards differ by one slot at most, and a shard that leaves or joins moves
little else. A row's key is hashed to a slot, and the slot names the shard.

The table depends on the shard names alone. Its size is checked before it is broadcast.

Defined results: a null key has its own fixed slot; equal keys share a slot; an empty table gives no
rows. Shard names must differ; their order has no influence.
"""

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLOTS = 65_537
#: A broadcast table has at most this many slots (a few MB).
MOST_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def fill(names: list[str], slots: int = SLOTS) -> list[str]:
    """The shard of each slot."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be given and differ")
    if not _is_prime(slots) or not len(names) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    names = sorted(names)
    starts, skips = [], []
    for name in names:
        digest = hashlib.sha256(name.encode()).digest()
        starts.append(int.from_bytes(digest[:8], "big") % slots)
        skips.append(int.from_bytes(digest[8:16], "big") % (slots - 1) + 1)
    owner: list[str | None] = [None] * slots
    free = slots
    while True:
        for i, name in enumerate(names):
            slot = starts[i]
            while owner[slot] is not None:
                slot = (slot + skips[i]) % slots
            owner[slot] = name
            starts[i] = (slot + skips[i]) % slots
            free -= 1
            if not free:
                return owner


def slot_of(key: str, slots: int = SLOTS) -> Column:
    """Slot of a key, from the first 32 bits of its text's md5."""
    return (F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long")
            % slots).cast("int")


def lookup(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) of the filled table."""
    return spark.createDataFrame(list(enumerate(fill(names, slots))), "slot int, shard string")


def place(rows: DataFrame, names: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """Add ``slot`` and ``shard``; columns of those names are replaced."""
    table = lookup(rows.sparkSession, names, slots)
    return rows.drop("slot", "shard").withColumn("slot", slot_of(key, slots)).join(F.broadcast(table), "slot")
