"""Pieces that the corpus operators share."""

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Texts in one Arrow batch; a batch of long texts must fit beside the model in a Python worker.
TEXTS_PER_BATCH = 1000
#: Entries of a memo in a Python worker; a full memo is emptied, which costs time and no results.
MEMO_ENTRIES = 400_000
#: Entries of each half of a ``Memo``.
HALF_MEMO = 60_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(folds: int, key: str = "doc_id") -> Column:
    """True where crc32 of the key as text is a multiple of ``folds``; a null key is held out, so never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(True))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """``mapInArrow`` with batches short enough for whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = df.sparkSession
    if int(spark.conf.get(key)) > TEXTS_PER_BATCH:
        spark.conf.set(key, str(TEXTS_PER_BATCH))
    return df.mapInArrow(fn, schema)


class Memo(dict):
    """Key to what ``make`` gives for it (never None), remembered for the keys asked for lately.

    A full memo becomes the older half, from which keys that are asked for again are taken over; the older half before
    it is dropped. Frequent keys stay so, and a worker holds twice ``HALF_MEMO`` entries at most.
    """

    def __init__(self, make: Callable) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= HALF_MEMO:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class HashMemo(Memo):
    """Token to 64-bit hash."""

    def __init__(self) -> None:
        super().__init__(xxhash.xxh64_intdigest)
