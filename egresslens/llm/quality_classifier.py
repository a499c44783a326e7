"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text is lower-cased and cut into words and single marks. A token that repeats the one before it
becomes one fixed token, so that stuttering looks the same whatever the word. One- and two-token
n-grams are hashed into ``2 ** bits`` buckets; a text is the vector of ``log(1 + count)`` of its
buckets at length 1, and its score the logistic function of one sparse dot product.

Defined results: a null text counts as empty; an empty text scores the bias alone; without any
labelled row every score is 0.5. Repeated rows and ids are scored row by row. Rows keep their order
of no meaning; other columns are passed through untouched.
"""

from dataclasses import dataclass
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from egresslens.llm.common import HashMemo, map_batches
from egresslens.session import materialize

TOKEN = re.compile(r"\w+|[^\w\s]")
REPEATED = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Params:
    """``sample`` bounds the labelled documents that the model is fitted on."""

    bits: int = 18
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.1
    epochs: int = 3
    sample: int = 6000


class Features:
    def __init__(self, bits: int) -> None:
        self.shift = np.uint64(64 - bits)
        self.ids = HashMemo()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and values of a text."""
        tokens = TOKEN.findall(text.lower())
        if not tokens:
            return np.empty(0, np.int64), np.empty(0)
        one = np.fromiter(map(self.ids.__getitem__, tokens), np.uint64, len(tokens))
        one[1:][one[1:] == one[:-1]] = REPEATED
        two = (one[:-1] * MIX + (one[1:] ^ (one[1:] >> np.uint64(31)))) * MIX
        buckets, counts = np.unique(np.concatenate([one * MIX, two]) >> self.shift, return_counts=True)
        values = np.log1p(counts)
        return buckets.astype(np.int64), values / np.sqrt(values @ values)


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], params: Params) -> np.ndarray:
    """Weights of all buckets and, last, the bias; the examples are taken in the given order."""
    size = 2 ** params.bits + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        zs = z[at]
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - params.l1, 0)
        return -shrunk / ((params.beta + np.sqrt(n[at])) / params.alpha + params.l2)

    for _ in range(params.epochs):
        for buckets, values, label in examples:
            at, x = np.append(buckets, size - 1), np.append(values, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            n_new = n[at] + g * g
            z[at] += g - (np.sqrt(n_new) - np.sqrt(n[at])) / params.alpha * w
            n[at] = n_new
    return weights(np.arange(size)).astype(np.float32)


def train(labelled: DataFrame, params: Params = Params()) -> np.ndarray:
    """Fit on rows (doc_id, text, label), at most ``params.sample`` of them, in the order of a hash of the id."""
    def run(batches):
        features, examples = Features(params.bits), []
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                examples.append((*features(text), label))
        yield pa.RecordBatch.from_pydict({"weights": [fit(examples, params).tobytes()]})

    ordered = (labelled.select(F.coalesce("text", F.lit("")).alias("text"), "label", "doc_id")
               .repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").select("text", "label"))
    row = map_batches(ordered, run, "weights binary").first()
    return np.frombuffer(row["weights"], np.float32) if row else fit([], params)


def labelled_sample(documents: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, text, label) of at most ``params.sample`` labelled ids, the first by a hash of the id.

    Labels that disagree are averaged; null ids and labels are left out.
    """
    chosen = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
              .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.sample))
    return documents.select("doc_id", "text").join(materialize(chosen, "labelled"), "doc_id")


def score(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """Add ``score`` (0 to 1) to every row, in place of any column of that name. The weights have a fixed size and travel as a broadcast variable."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)
    bits = (len(weights) - 1).bit_length() - 1
    name = "score"
    documents = documents.drop(name)
    place = documents.columns.index("text")

    def run(batches):
        w, features = shared.value, Features(bits)
        bias = float(w[-1])
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(place).to_pylist()):
                buckets, values = features(text or "")
                scores[i] = bias + float(w[buckets] @ values)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(1 / (1 + np.exp(-scores)))], names=[*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return map_batches(documents, run, f"{fields}, {name} double")
