"""Distributions, column profiles and classifier evaluation as DataFrames."""

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType, StringType

from egresslens.session import materialize


def class_distribution(df: DataFrame, column: str = "class") -> DataFrame:
    """Rows per class; NULL is a class of its own."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).dropna().distinct()


def column_profile(df: DataFrame) -> DataFrame:
    """Non-NULL count and kind of every column, from one aggregate row."""
    def kind(data_type) -> str:
        if isinstance(data_type, NumericType):
            return "numeric"
        return "categorical" if isinstance(data_type, StringType) else "other"

    counts = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields])
    rows = F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.lit(kind(f.dataType)).alias("kind"),
                 F.col(f"`{f.name}`").alias("non_null")) for f in df.schema.fields])
    return counts.select(F.inline(rows))


def probability_summary(scores: DataFrame, column: str) -> DataFrame:
    value = F.col(column).cast("double")
    usable = F.when(~F.isnan(value), value)
    infinite = F.abs(usable) == float("inf")
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return scores.agg(
        F.min(usable).alias("min_p"), F.max(usable).alias("max_p"), F.avg(usable).alias("mean_p"),
        flag(F.isnan(value)).alias("any_nan"), flag(infinite).alias("any_inf"))


def class_weight(df: DataFrame, label: str = "y") -> DataFrame:
    """Negatives per positive; NULL without positives."""
    return df.agg((F.count_if(F.col(label) == 0) / F.nullif(
        F.count_if(F.col(label) == 1), F.lit(0))).alias("weight"))


def roc_counts(scores: DataFrame, score: str = "p", label: str = "y", stretches: int | None = None) -> DataFrame:
    """Positives and negatives at, and at or above, each distinct score.

    Scores are first reduced to distinct ones, then cut into ranges (by default as many as a shuffle
    has partitions) and written with the number of their range, so that no task sorts more than its
    share. Where the cuts fall does not change the result.
    """
    per_score = scores.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    falling = [F.desc("threshold")]
    ranged = per_score.repartitionByRange(*([stretches] if stretches else []), *falling)
    placed = materialize(ranged.withColumn("stretch", F.spark_partition_id()), "roc-ranges")
    sums = placed.groupBy("stretch").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    # At most one row per stretch from here on.
    above = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("stretch", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}0") for c in ("p", "n")])
    inside = Window.partitionBy("stretch").orderBy(F.desc("threshold")).rowsBetween(
        Window.unboundedPreceding, 0)
    local = placed.withColumns({"tp": F.sum("pos").over(inside), "fp": F.sum("neg").over(inside)})
    return local.join(base, "stretch").select(
        "threshold", "pos", "neg", (F.col("tp") + F.col("p0")).alias("tp"), (F.col("fp") + F.col("n0")).alias("fp"))


def roc_curve(counts: DataFrame) -> DataFrame:
    """``(threshold, tpr, fpr, j)`` for each distinct score of ``roc_counts``; a rate over no rows is NULL."""
    whole = lambda c: counts.agg(F.sum(c).alias("t")).scalar()
    tpr, fpr = F.try_divide("tp", whole("pos")), F.try_divide("fp", whole("neg"))
    return counts.select("threshold", tpr.alias("tpr"), fpr.alias("fpr"), (tpr - fpr).alias("j"))


def youden_threshold(roc: DataFrame) -> DataFrame:
    """The point of largest ``j``; of equal ones the highest threshold."""
    best = F.max_by(F.struct("threshold", "tpr", "fpr", "j"), F.struct("j", "threshold"))
    return roc.agg(best.alias("b")).select("b.*")


def roc_auc(counts: DataFrame) -> DataFrame:
    """Share of positive-negative pairs ranked right, ties counting half."""
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2))
    return counts.agg((wins / F.sum("pos") / F.sum("neg")).alias("auc"))


def predicted(score: Column, threshold) -> Column:
    return (score >= threshold).cast("int")


def confusion(df: DataFrame, label: str = "y", prediction: str = "pred") -> DataFrame:
    cell = lambda y, p: F.count_if((F.col(label) == y) & (F.col(prediction) == p))
    return df.agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))


def accuracy(df: DataFrame, label: str = "y", prediction: str = "pred") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def classification_report(df: DataFrame, label: str = "y", prediction: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted means."""
    cells = df.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    # A row counts for its true and for its predicted class.
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("y").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("right")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called"),
                 F.lit(0).cast("bigint").alias("right")))))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per_class = sides.groupBy("cls").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("right").alias("right")
    ).select(F.col("cls").cast("string").alias("label"), ratio(F.col("right"), F.col("called")).alias("precision"),
             ratio(F.col("right"), F.col("support")).alias("recall"), "support")
    pr, rc = F.col("precision"), F.col("recall")
    per_class = per_class.withColumn("f1", ratio(2 * pr * rc, pr + rc))
    names = ["precision", "recall", "f1"]
    means = per_class.agg(
        F.sum("support").alias("support"), *[F.avg(n).alias(f"m_{n}") for n in names],
        *[(F.sum(F.col(n) * F.col("support")) / F.sum("support")).alias(f"w_{n}") for n in names])
    averages = means.select(F.inline(F.array(*[
        F.struct(F.lit(title).alias("label"), *[F.col(f"{p}_{n}").alias(n) for n in names], F.col("support"))
        for title, p in (("macro avg", "m"), ("weighted avg", "w"))])))
    return per_class.select("label", *names, "support").unionByName(averages)
