"""Feature encoding: splits, scaling, target and label encoding, class balance."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from egresslens import constants as C
from egresslens.session import materialize

STATELESS_SPLIT = {"train": 0.7, "val": 0.2, "test": 0.1}
STATEFUL_SPLIT = {"train": 0.6, "val": 0.2, "test": 0.2}


def hash_share(key: Column, seed: int | str = 42) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    digest = F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def split_name(key: Column, shares: dict[str, float], seed: int | str = 42) -> Column:
    """Split of a row by its hash; every class splits alike and no row moves."""
    value, upto, out = hash_share(key, seed), 1.0, None
    for name, share in reversed(shares.items()):
        upto -= share
        out = F.lit(name) if out is None else F.when(value < limit, name).otherwise(out)
        limit = upto
    return out


def seeded_order(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def sequential_slices(key: Column, sizes: dict[str, int], seed: int | str = 42) -> Column:
    """Cut rows into slices in the proportion of ``sizes``."""
    total = sum(sizes.values())
    return split_name(key, {n: s / total for n, s in sizes.items()}, seed)


def dedup_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def fold_of(key: str, folds: int) -> Column:
    return F.floor(hash_share(F.col(key), "fold") * folds).cast("int")


@dataclass
class Scaler:
    """Means and population deviations as one row."""

    columns: list[str]
    moments: DataFrame

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> "Scaler":
        return cls(columns, df.agg(
            *[F.avg(c).alias(f"{c}__mean") for c in columns],
            *[F.stddev_pop(c).alias(f"{c}__sd") for c in columns]))

    def transform(self, df: DataFrame) -> DataFrame:
        """Subtract the mean and divide by the deviation (by 1 where it is 0)."""
        row = self.moments.select(F.struct("*").alias("m")).scalar()
        held = df.withColumn("__m", row)
        sd = lambda c: F.when(F.col(f"__m.{c}__sd") == 0, 1.0).otherwise(F.col(f"__m.{c}__sd"))
        return held.withColumns({c: (F.col(c) - F.col(f"__m.{c}__mean")) / sd(c) for c in self.columns}).drop("__m")


@dataclass
class TargetEncoder:
    """Smoothed label means per category, with out-of-fold values for the training rows."""

    column: str
    stats: DataFrame
    smoothing: float = C.TARGET_ENCODING_SMOOTHING

    @classmethod
    def fit(cls, df: DataFrame, column: str, label: str, key: str, folds: int = 5,
            smoothing: float = C.TARGET_ENCODING_SMOOTHING) -> "TargetEncoder":
        stats = df.groupBy(F.col(column).cast("string").alias("category"), fold_of(key, folds).alias("fold")).agg(
            F.sum(F.col(label).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
        encoder = cls(column, stats, smoothing)
        encoder.key, encoder.folds = key, folds
        return encoder

    def _overall(self, stats: DataFrame) -> Column:
        return stats.agg((F.sum("s") / F.sum("n")).alias("m")).scalar()

    def _value(self, s: Column, n: Column, mean: Column) -> Column:
        known = (s + self.smoothing * mean) / (n + self.smoothing)
        return F.coalesce(known, mean)

    def _attach(self, df: DataFrame, table: DataFrame, keys: list[str], out: str, mean: Column) -> DataFrame:
        marked = df.withColumn("category", F.col(self.column).cast("string"))
        joined = marked.join(table, keys, "left").withColumn("__mean", mean)
        return joined.withColumn(out, self._value(F.col("s"), F.col("n"), F.col("__mean"))).drop(
            "category", "fold", "s", "n", "__mean")

    def transform(self, df: DataFrame, out: str | None = None) -> DataFrame:
        """Encode with all training rows; unseen categories get the overall mean."""
        whole = self.stats.groupBy("category").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        return self._attach(df, whole, ["category"], out or self.column, self._overall(self.stats))

    def transform_training(self, df: DataFrame, out: str | None = None) -> DataFrame:
        """Encode training rows from the other folds only: totals minus the own fold."""
        per_category = self.stats.groupBy("category").agg(
            F.sum("s").alias("ts"), F.sum("n").alias("tn"),
            F.map_from_entries(F.collect_list(F.struct("fold", F.struct("s", "n")))).alias("own"))
        fold = fold_of(self.key, self.folds)
        per_fold = self.stats.groupBy("fold").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        # One entry per fold: the overall mean of the other folds.
        total = self.stats.agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        means = per_fold.select("fold", F.try_divide(
            total.select("s").scalar() - F.col("s"), total.select("n").scalar() - F.col("n")).alias("m"))
        table = means.agg(F.map_from_entries(F.collect_list(F.struct("fold", "m"))).alias("m")).scalar()
        joined = df.withColumn("category", F.col(self.column).cast("string")).withColumn("fold", fold).join(
            per_category, "category", "left").withColumn("__mean", F.try_element_at(table, F.col("fold")))
        own = F.try_element_at("own", F.col("fold"))
        s, n = F.col("ts") - own["s"], F.col("tn") - own["n"]
        return joined.withColumn(out or self.column, self._value(s, n, F.col("__mean"))).drop(
            "category", "fold", "ts", "tn", "own", "__mean")


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Distinct labels with their rank from 0.

    Labels are dealt by ranges of their order and ranked within each; the ranges' sizes are added up in order, one row a
    range, so any number of labels is ranked side by side.
    """
    labels = df.select(column).dropna().distinct().repartitionByRange(column).withColumn("__part", F.spark_partition_id())
    labels = materialize(labels, "labels")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = labels.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).select(
        "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__shift"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(column)) - 1
    return labels.withColumn("__rank", rank).join(shift, "__part").select(
        (F.col("__rank") + F.col("__shift")).cast("int").alias("code"), column)


def encode_labels(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Replace labels by their rank in sorted order; NULL stays NULL."""
    codes = label_codes(df, column).select(F.col(column).alias("__label"), F.col("code").alias("__code"))
    joined = df.join(codes, F.col(column) == F.col("__label"), "left").drop("__label")
    return joined.withColumn(out or column, F.col("__code").cast("int")).drop("__code")


def cast_categories(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns if c in df.columns})


def weighted(df: DataFrame, label: str = "class", out: str = "weight") -> DataFrame:
    """Weight of a row: negatives per positive for positives, 1 otherwise."""
    ratio = df.agg((F.count_if(F.col(label) == 0) / F.nullif(
        F.count_if(F.col(label) == 1), F.lit(0))).alias("r")).scalar()
    held = df.withColumn("__r", ratio)
    return held.withColumn(out, F.when(F.col(label) == 1, F.col("__r")).otherwise(F.lit(1.0))).drop("__r")


def synthetic_rows(minority: DataFrame, numeric: list[str], size: int, key: str, seed: int = 42,
                   scale: float = 0.1) -> DataFrame:
    """A smoothed bootstrap of about ``size`` rows: copies of real rows, numbers jittered.

    Each row is repeated a hash-drawn number of times with the right mean, so no row moves. The
    jitter is uniform with ``scale`` standard deviations.
    """
    rate = F.lit(float(size)) / minority.agg(F.count(F.lit(1)).alias("n")).scalar()
    held = minority.withColumn("__rate", rate)
    extra = hash_share(F.col(key), f"{seed}-copies") < F.col("__rate") - F.floor("__rate")
    copies = F.floor("__rate").cast("int") + extra.cast("int")
    spread = minority.agg(F.struct(*[F.stddev_pop(c).alias(c) for c in numeric]).alias("sd")).scalar()
    repeated = held.withColumn("__sd", spread).withColumn("copy_no", F.explode(
        F.filter(F.sequence(F.lit(0), copies), lambda i: i > 0)))
    name = F.concat_ws(":", F.col(key).cast("string"), F.col("copy_no").cast("string"))
    noise = lambda c: (hash_share(name, f"{seed}-{c}") - 0.5) * 2 * scale * F.coalesce(F.col(f"__sd.{c}"), F.lit(0.0))
    return repeated.withColumns({c: F.col(c).cast("double") + noise(c) for c in numeric}).drop("__rate", "__sd")
