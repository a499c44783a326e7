"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased; letters stay, every run of anything else becomes one blank, and both ends
are padded. Each language gets an interpolated Kneser-Ney model of four-character grams. A gram is a
64-bit number of four code units (code points beyond 16 bits share one), which is a hash without
collisions. The grams of all languages lie in one sorted array per order beside the log probability
in every language, so one binary search serves all languages; a gram that no language knows falls
back to its context's weight and its suffix, found the same way.

The language with the lowest cross-entropy per character wins. ``score`` is the share of the winner
when the entropies, weighted by the temperature that fits the calibration texts best, are taken as
evidence. ``rejected`` marks texts without a letter and texts whose entropy lies beyond what the
calibration texts of the language make likely at that length.

Defined results: a null text and a text without letters give ``und`` with score 0. Without training
rows all texts are ``und``. Ties go to the language first in order of its name. Repeated rows are
judged row by row; other columns pass through.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from egresslens.llm.common import map_batches
from egresslens.session import materialize

ORDER = 4
UNIT, BLANK, OTHER = 16, 32, 0xFFFF
#: Characters of a text that are scored in one go, and of the texts that are scored together.
CHUNK, TOGETHER = 500_000, 100_000
UNKNOWN = "und"
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)


@dataclass(frozen=True)
class Params:
    """``sample`` bounds (in expectation) the training texts of one language; one in ``calibrate`` of
    them is kept for calibration. ``deviations`` sets how unlikely a text must be to be rejected."""

    sample: int = 1000
    calibrate: int = 5
    deviations: float = 8.0


def _letters() -> np.ndarray:
    """Code unit by code point: letters as they are, all else blank."""
    points = np.arange(0x10000, dtype=np.uint16)
    keep = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)
    return np.where(keep, points, BLANK).astype(np.uint64)


class Cutter:
    """Text to code units."""

    def __init__(self) -> None:
        self.units = _letters()

    def __call__(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        units = self.units[np.minimum(points, 0xFFFF)]
        if points.size and points.max() > 0xFFFF:
            wide = np.flatnonzero(points > 0xFFFF)
            units[wide] = [OTHER if chr(points[i]).isalpha() else BLANK for i in wide]
        blank = units == BLANK
        units = units[~(blank & np.append(True, blank[:-1]))] if units.size else units
        return units[:-1] if units.size and units[-1] == BLANK else units

    def padded(self, text: str) -> np.ndarray:
        """With blanks before and one behind; empty where there is no letter."""
        units = self(text)
        return np.concatenate([np.full(ORDER - 1, BLANK, np.uint64), units, [np.uint64(BLANK)]]) if units.size else units


def grams(padded: np.ndarray) -> np.ndarray:
    out = padded[ORDER - 1:].copy()
    for back in range(1, ORDER):
        out |= padded[ORDER - 1 - back:len(padded) - back] << np.uint64(UNIT * back)
    return out


def suffix(keys: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` units."""
    return keys & np.uint64(2 ** (UNIT * order) - 1)


class Model:
    """Sorted gram arrays with log probabilities, sorted context arrays with back-off weights."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        """counts: per language the distinct grams of the full order and how often each was seen."""
        self.languages = sorted(counts)
        self.cutoffs: dict[str, tuple[float, float, float]] = {}
        self.temperature = 8.0
        by_order: dict[int, dict[str, tuple[np.ndarray, np.ndarray]]] = {ORDER: counts}
        for order in range(ORDER - 1, 0, -1):  # how many different units stand before a gram
            by_order[order] = {lang: np.unique(suffix(keys, order), return_counts=True)
                               for lang, (keys, _) in by_order[order + 1].items()}
        alphabet = 1 + len(np.unique(np.concatenate([k for k, _ in by_order[1].values()]))) if counts else 1
        self.floor = float(-np.log(alphabet))
        self.keys, self.logs, self.contexts, self.weights = {}, {}, {}, {}
        for order in range(1, ORDER + 1):
            self._level(order, by_order[order])

    def _level(self, order: int, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        union = np.unique(np.concatenate([k for k, _ in counts.values()])) if counts else np.empty(0, np.uint64)
        heads = np.unique(union >> np.uint64(UNIT))
        head_of = np.searchsorted(heads, union >> np.uint64(UNIT))
        lower = self.log_probabilities(suffix(union, order - 1), order - 1)
        logs = np.empty((len(union), len(self.languages)), np.float32)
        weights = np.empty((len(heads), len(self.languages)), np.float32)
        for column, lang in enumerate(self.languages):
            keys, seen = counts[lang]
            full = np.zeros(len(union))
            full[np.searchsorted(union, keys)] = seen
            once, twice = (seen == 1).sum(), (seen == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            total = np.bincount(head_of, full, len(heads))
            kinds = np.bincount(head_of, full > 0, len(heads))
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            main = np.where(full > 0, (full - discount) / np.maximum(total[head_of], 1), 0.0)
            logs[:, column] = np.log(main + weight[head_of] * np.exp(lower[:, column]))
            weights[:, column] = np.log(weight)
        self.keys[order], self.logs[order], self.contexts[order], self.weights[order] = union, logs, heads, weights

    def log_probabilities(self, keys: np.ndarray, order: int) -> np.ndarray:
        """One row per gram, one column per language."""
        if order == 0:
            return np.full((len(keys), len(self.languages)), self.floor, np.float32)
        known = self.keys[order]
        if not len(known):
            return self.log_probabilities(suffix(keys, order - 1), order - 1)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        out = self.logs[order][at]
        miss = np.flatnonzero(known[at] != keys)
        if miss.size:
            rest = keys[miss]
            below = self.log_probabilities(suffix(rest, order - 1), order - 1)
            heads, head = self.contexts[order], rest >> np.uint64(UNIT)
            at = np.minimum(np.searchsorted(heads, head), len(heads) - 1)
            out[miss] = below + np.where((heads[at] == head)[:, None], self.weights[order][at], 0)
        return out

    def entropies(self, texts: list[str], cut: Cutter) -> tuple[np.ndarray, np.ndarray]:
        """Characters of every text and its cross-entropy (nats a character) in every language."""
        lengths, sums = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)))
        held, size = [], 0

        def flush():
            logs = self.log_probabilities(np.concatenate([g for _, g in held]), ORDER)
            starts = np.cumsum([0, *(len(g) for _, g in held[:-1])])
            np.add.at(sums, [i for i, _ in held], np.add.reduceat(logs, starts, axis=0, dtype=np.float64))

        for i, text in enumerate(texts):
            padded = cut.padded(text or "")
            lengths[i] = max(0, len(padded) - ORDER + 1)
            for start in range(0, lengths[i], CHUNK):
                piece = grams(padded[start:start + CHUNK + ORDER - 1])
                held.append((i, piece))
                size += len(piece)
                if size >= TOGETHER:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return lengths, -sums / np.maximum(lengths, 1)[:, None]

    def shares(self, lengths: np.ndarray, entropies: np.ndarray, temperature: float) -> np.ndarray:
        """Posterior share of each language; evidence grows with the length up to 50 characters."""
        evidence = -entropies * (temperature * np.minimum(lengths, 50) / 50)[:, None]
        evidence = np.exp(evidence - evidence.max(axis=1, keepdims=True))
        return evidence / evidence.sum(axis=1, keepdims=True)


def _sampled(documents: DataFrame, params: Params) -> DataFrame:
    """(lang, text, calibrating) of about ``params.sample`` texts of each language, by a hash of the id."""
    rows = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    # written first, so that Spark knows its size and need not deal the texts out by language
    sizes = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("__n")), "languages")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    return (rows.select("lang", "text", draw.alias("__draw")).join(sizes, "lang")
            .filter(F.col("__draw") < params.sample / F.col("__n"))
            .select("lang", "text", (F.pmod(F.xxhash64("text"), F.lit(params.calibrate)) == 0).alias("calibrating")))


def train(documents: DataFrame, params: Params = Params()) -> Model:
    """Fit on (doc_id, text, lang) rows. Counting runs on the executors; the driver gets distinct grams
    of the bounded sample and a few figures of each language."""
    spark = documents.sparkSession
    sample = _sampled(documents, params).persist()

    def count(batches):
        cut = Cutter()
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                padded = cut.padded(text)
                if padded.size:
                    by_lang.setdefault(lang, []).append(grams(padded))
            for lang, pieces in by_lang.items():
                keys, seen = np.unique(np.concatenate(pieces), return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "lang": [lang] * len(keys), "gram": keys.view(np.int64), "seen": seen})

    counted = (map_batches(sample.filter(~F.col("calibrating")).select("lang", "text"), count,
                           "lang string, gram long, seen long")
               .groupBy("lang", "gram").agg(F.sum("seen").alias("seen"))).toArrow()
    counts = {}
    langs = np.array(counted.column("lang").to_pylist(), object)
    keys, seen = counted.column("gram").to_numpy().view(np.uint64), counted.column("seen").to_numpy()
    for lang in sorted(set(langs)):
        mine = langs == lang
        order = np.argsort(keys[mine])
        counts[lang] = keys[mine][order], seen[mine][order]
    model = Model(counts)
    shared = spark.sparkContext.broadcast(model)

    def measure(batches):
        cut, m = Cutter(), shared.value
        places = {lang: i for i, lang in enumerate(m.languages)}
        for batch in batches:
            lengths, h = m.entropies(batch.column(1).to_pylist(), cut)
            at = np.array([places.get(x, -1) for x in batch.column(0).to_pylist()])
            use = np.flatnonzero((at >= 0) & (lengths > 0))
            own = h[use, at[use]]
            fits = {f"t{i}": -np.log(np.maximum(m.shares(lengths[use], h[use], t)[np.arange(len(use)), at[use]], 1e-12))
                    for i, t in enumerate(TEMPERATURES)}
            yield pa.RecordBatch.from_pydict({
                "lang": [m.languages[a] for a in at[use]], "length": lengths[use].astype(np.int64), "own": own, **fits})

    if counts:
        fits = [f"t{i}" for i in range(len(TEMPERATURES))]
        measured = map_batches(sample.filter("calibrating").select("lang", "text"), measure,
                               "lang string, length long, own double, " + ", ".join(f"{t} double" for t in fits))
        rows = measured.groupBy("lang").agg(
            F.count(F.lit(1)).alias("n"), F.avg("own").alias("mean"),
            F.coalesce(F.stddev("own"), F.lit(0.0)).alias("spread"),
            *[F.sum(t).alias(t) for t in fits]).collect()
        model.cutoffs = {r["lang"]: (r["mean"], r["spread"], params.deviations) for r in rows}
        if rows:
            model.temperature = TEMPERATURES[int(np.argmin([sum(r[t] for r in rows) for t in fits]))]
    sample.unpersist()
    return model


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``, in place of any columns of these names."""
    documents = documents.drop("lang_pred", "score", "cross_entropy", "rejected")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index("text")

    def run(batches):
        cut, m = Cutter(), shared.value
        limits = np.array([m.cutoffs.get(lang, (0.0, np.inf, 1.0)) for lang in m.languages]).reshape(-1, 3)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            lengths, h = m.entropies(texts, cut)
            if m.languages:
                best = h.argmin(axis=1)
                shares = m.shares(lengths, h, m.temperature)[np.arange(len(texts)), best]
                mean, spread, deviations = limits[best].T
                # a short text strays by about 2.5 nats over the square root of its length by chance alone
                allowed = deviations * (spread + 2.5 / np.sqrt(np.maximum(lengths, 1)))
                own = h[np.arange(len(texts)), best]
                far = own > mean + allowed
            else:
                best, shares, own = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
                far = np.ones(len(texts), bool)
            none = (lengths == 0) | (not m.languages)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns,
                 pa.array([UNKNOWN if e else m.languages[b] for e, b in zip(none, best)], pa.string()),
                 pa.array(np.where(none, 0.0, shares)), pa.array(np.where(none, 0.0, own)), pa.array(none | far)],
                names=[*batch.schema.names, "lang_pred", "score", "cross_entropy", "rejected"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return map_batches(documents, run, f"{fields}, lang_pred string, score double, cross_entropy double, rejected boolean")
