"""Joins on keys that may hold any share of the rows."""

from pyspark.sql import DataFrame, functions as F

from egresslens.session import materialize

ROWS_PER_TASK = 100_000


def spread_hot_keys(left: DataFrame, right: DataFrame, keys: list[str],
                    rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, DataFrame]:
    """Add a ``salt`` to both sides so that no key and salt bring more than about ``rows_per_task`` rows a side.

    Only keys above the bound are cut. Rows of either side are cut by a hash of the row and repeated
    for every cut of the other side, so each pair of rows meets once. The hot keys are written first:
    there can be no more than ``rows / rows_per_task`` of them, and their file size lets Spark decide
    on a broadcast.
    """
    rows = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    cuts = lambda name: F.greatest(F.ceil(F.col(name) / rows_per_task), F.lit(1)).cast("int")
    hot = materialize(
        rows.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
        .filter(F.greatest("l", "r") > rows_per_task)
        .select(*keys, cuts("l").alias("__left_cuts"), cuts("r").alias("__right_cuts")), "hot-keys")
    by_left, by_right = (F.coalesce(c, F.lit(1)) for c in ("__left_cuts", "__right_cuts"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda side, n: F.pmod(F.xxhash64(*side.columns), n).cast("int")
    salted = left.join(hot, keys, "left").withColumn("__other", every(by_right)).withColumn(
        "salt", own(left, by_left) * by_right + F.col("__other"))
    repeated = right.join(hot, keys, "left").withColumn("__other", every(by_left)).withColumn(
        "salt", F.col("__other") * by_right + own(right, by_right))
    return tuple(df.drop("__left_cuts", "__right_cuts", "__other") for df in (salted, repeated))
