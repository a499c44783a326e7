"""Two-stage classifier on ``pyspark.ml``: training, scoring, thresholds, verdicts."""

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from egresslens import constants as C
from egresslens.functions.times import encode_cyclic
from egresslens.operators import encode, stats
from egresslens.operators.detect import finding
from egresslens.operators.ordered import left_join_on, running
from egresslens.session import materialize


@dataclass
class Preprocessor:
    """Scaling and target encoding fitted on training rows alone."""

    numeric: list[str]
    categorical: list[str]
    passthrough: list[str] = field(default_factory=list)
    scaler: encode.Scaler | None = None
    encoders: list[encode.TargetEncoder] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return self.numeric + self.categorical + self.passthrough

    def fit(self, train: DataFrame, label: str, key: str) -> "Preprocessor":
        self.scaler = encode.Scaler.fit(train, self.numeric)
        self.encoders = [encode.TargetEncoder.fit(train, c, label, key) for c in self.categorical]
        return self

    def materialized(self) -> "Preprocessor":
        """The same with its statistics written to tables, so that they are computed once."""
        self.scaler.moments = materialize(self.scaler.moments, "scaler")
        for encoder in self.encoders:
            encoder.stats = materialize(encoder.stats, "encoder")
        return self

    def transform(self, df: DataFrame, training: bool = False) -> DataFrame:
        out = self.scaler.transform(df)
        for encoder in self.encoders:
            out = encoder.transform_training(out) if training else encoder.transform(out)
        return out


def stateless_preprocessor() -> Preprocessor:
    cyclic = [f"{p}_{f}" for p in ("hour", "minute", "second", "ms", "dow", "month") for f in ("sin", "cos")]
    return Preprocessor(list(C.STATELESS_NUMERIC), list(C.STATELESS_CATEGORICAL), cyclic)


def stateful_preprocessor() -> Preprocessor:
    return Preprocessor(list(C.STATEFUL_NUMERIC), list(C.STATEFUL_CATEGORICAL))


def first_stage(features: list[str], label: str = "class", epochs: int = 100, seed: int = 42) -> Pipeline:
    """Feed-forward net on the lexical features."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
        MultilayerPerceptronClassifier(layers=[len(features), 64, 32, 2], labelCol=label,
                                       maxIter=epochs, seed=seed)])


def second_stage(features: list[str], label: str = "class", weight: str = "weight",
                 validation: str = "is_val", rounds: int = 100, seed: int = 42, tolerance: float = 0.01) -> Pipeline:
    """Boosted trees on the response features; training stops when the loss on validation rows gains less than ``tolerance``.

    A negative tolerance trains all rounds, so that the area under the ROC curve alone decides how many count.
    """
    pipeline = Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
        GBTClassifier(labelCol=label, weightCol=weight, validationIndicatorCol=validation,
                      maxIter=rounds, maxDepth=8, subsamplingRate=0.8, featureSubsetStrategy="0.8",
                      minInstancesPerNode=50, stepSize=0.1, seed=seed, validationTol=max(tolerance, 0.0))])
    if tolerance < 0:
        boosted = pipeline.getStages()[-1]
        boosted.clear(boosted.validationIndicatorCol)
    return pipeline


def positive_probability(column: str = "probability") -> Column:
    return F.element_at(vector_to_array(F.col(column)), 2)


def _tree_values(model: PipelineModel, features: DataFrame, rounds: int | None = None) -> tuple[DataFrame, list[str], list[Column]]:
    """Rows with a column for each of the first ``rounds`` boosted trees; the names of the columns and their weighted values."""
    boosted = model.stages[-1]
    rows = model.stages[0].transform(features)
    trees, weights = boosted.trees[:rounds], boosted.treeWeights[:rounds]
    names = [f"__tree{i}" for i in range(len(trees))]
    for name, tree in zip(names, trees):
        rows = tree.copy().setPredictionCol(name).transform(rows)
    return rows, names, [F.col(name) * F.lit(float(weight)) for name, weight in zip(names, weights)]


@F.arrow_udf(ArrayType(DoubleType()))
def _running_sums(each: pa.Array) -> pa.Array:
    """The sums of the first numbers of every list, added in their order; lists are of one length and hold no null."""
    flat = each.flatten().to_numpy(zero_copy_only=False)
    sums = flat.reshape(len(each), len(flat) // max(len(each), 1)).cumsum(axis=1)
    ends = np.arange(len(each) + 1, dtype=np.int32) * sums.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.ravel(), pa.float64()))


def staged_margins(model: PipelineModel, features: DataFrame, out: str = "margins") -> DataFrame:
    """Add the margins of boosted trees after each round, in one pass: every tree is a column, each added once to the last sum.

    The sums are made by batch: an expression that grows a list copies it for every round.
    """
    rows, names, each = _tree_values(model, features)
    return rows.withColumn(out, _running_sums(F.array(*each))).drop(*names)


def score(model: PipelineModel, features: DataFrame, keep, out: str, rounds: int | None = None) -> DataFrame:
    """Probability of the positive class; works on batch and stream alike. ``rounds`` uses so many boosted trees only."""
    if rounds is None:
        return model.transform(features).select(*keep, positive_probability().alias(out))
    rows, _, each = _tree_values(model, features, rounds)
    margin = reduce(lambda a, x: a + x, each, F.lit(0.0))
    return rows.select(*keep, (1 / (1 + F.exp(-2 * margin))).alias(out))


#: Steps of the probability by which the margins of a round are cut for the rank sums.
AUC_STEPS = 4096


def staged_auc(margins: DataFrame, label: str = "class") -> DataFrame:
    """(round, auc) from ``(margins, label)`` rows: rank sums of all rounds from one sorted aggregate, ties by half.

    The margins of a round are cut into steps of their probability; negatives below a step are added up over the steps,
    those below a margin inside its step. A round over rows of one class has no area.
    """
    rows = margins.select(F.col(label).cast("bigint").alias("y"), F.posexplode("margins").alias("place", "margin"))
    counts = rows.groupBy((F.col("place") + 1).alias("round"), "margin").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    step = F.floor(AUC_STEPS / (1 + F.exp(-2 * F.col("margin"))))
    # The running sums read them twice, and each time all trees would be asked again.
    counts = materialize(counts.withColumn("step", step), "margin-counts")
    ranked = running(counts, ["round"], ["step", "margin"], sums={"below": F.col("neg")}, width=1,
                     inclusive=False)
    area = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return ranked.groupBy("round").agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("auc"))


def best_round(curve: DataFrame) -> int | None:
    """The first round of the largest area, or None where no round has one."""
    row = curve.filter("auc is not null").agg(F.max_by("round", F.struct("auc", -F.col("round"))).alias("round")).first()
    return row["round"]


def learning_curve(model: PipelineModel, df: DataFrame, train: DataFrame | None = None, label: str = "class") -> DataFrame:
    """Loss and area under the ROC curve after each boosting round, on ``df``, and the loss on ``train`` where it is given."""
    spark, boosted = df.sparkSession, model.stages[-1]
    losses = lambda rows: [float(v) for v in boosted.evaluateEachIteration(model.stages[0].transform(rows))]
    own = losses(df)
    seen = losses(train) if train is not None else [None] * len(own)
    rows = spark.createDataFrame([(i + 1, v, t) for i, (v, t) in enumerate(zip(own, seen))],
                                 "round int, loss double, train_loss double")
    return rows.join(staged_auc(staged_margins(model, df), label), "round", "left")


def cyclic_lexical(features: DataFrame) -> DataFrame:
    """Lexical features with the timestamp as cyclic columns, ready for the preprocessor."""
    return encode.cast_categories(encode_cyclic(features, "timestamp"), C.STATELESS_CATEGORICAL)


def choose_threshold(scores: DataFrame, score_col: str = "p", label: str = "y") -> DataFrame:
    return stats.youden_threshold(stats.roc_curve(stats.roc_counts(scores, score_col, label)))


def packet_key(*tables: DataFrame) -> list[str]:
    """The columns that tell packets apart in all of the tables."""
    return [*(["capture_id"] if all("capture_id" in t.columns for t in tables) else []), "frame_no"]


def pair_scores(first: DataFrame, second: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Both scores of a packet side by side; the second may be missing."""
    return left_join_on(first, second, keys or packet_key(first, second))


def is_exfiltration(t1, t2, margin: float = C.UNCERTAINTY_MARGIN) -> Column:
    """Near the first threshold the second score decides when there is one."""
    t1, t2 = (t if isinstance(t, Column) else F.lit(float(t)) for t in (t1, t2))
    unsure = (F.abs(F.col("p1") - t1) <= margin) & F.col("p2").isNotNull()
    return F.when(unsure, F.col("p2") >= t2).otherwise(F.col("p1") >= t1)


def verdicts(scores: DataFrame, t1, t2, margin: float = C.UNCERTAINTY_MARGIN) -> DataFrame:
    return scores.withColumn("classification", F.when(
        is_exfiltration(t1, t2, margin), "exfiltration").otherwise("benign"))


def verdict_findings(judged: DataFrame) -> DataFrame:
    """Findings of the packets judged as exfiltration."""
    extra = lambda name: F.col(name) if name in judged.columns else F.lit(None)
    return judged.filter(F.col("classification") == "exfiltration").select(finding(
        proto=F.lit("DNS"), classification=F.col("classification"), p1=F.round("p1", 4),
        p2=F.round("p2", 4), subdomain=extra("subdomain"), entropy=extra("entropy"),
        note=F.lit(C.NOTE_DNS_MODEL), capture_id=extra("capture_id"), frame_no=F.col("frame_no"),
    ).alias("f")).select("f.*")


def save_thresholds(t1: float, t2: float, spark, path: str) -> None:
    spark.createDataFrame([(float(t1), float(t2))], "t1 double, t2 double").write.mode("overwrite").parquet(path)


def load_thresholds(spark, path: str) -> DataFrame:
    return spark.read.schema("t1 double, t2 double").parquet(path)
