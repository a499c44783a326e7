"""Language-model scores from a gated recurrent network in numpy.

Tokens are lower-cased words and one end. Every word belongs to one output class: the most frequent
words ("heads") to classes of ``width`` words by rank, all others to classes by their last bytes. The
network predicts the class from its state by one softmax, a head by a second softmax within its
class, and another word by its smoothed share of the class's counts. With 1,024 heads or more the
probabilities of all words seen in training and of one unseen word a tail class add up to one; with fewer,
classes without a word keep what little the softmax gives them.

A document's state starts at zero and is carried from window to window to its end; nothing is cut.
Documents run side by side in lanes, one after the other within a lane.

Counts cover all training documents, and the network is fitted on all of them, dealt into shards of
about ``shard`` bytes: first on one shard by truncated backpropagation, then from there one pass
over every shard at once, and the weights are averaged. The rule is the same at every size.

Words beyond the ``known`` most frequent are looked up by a join, so what is broadcast has a fixed size.

Defined results: a null text counts as empty and has the end as its only token. Without training
documents counts are zero and the network is untrained. Repeated rows are scored row by row.
"""

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from egresslens.llm.common import map_batches
from egresslens.session import materialize

END = b"\n"
SMOOTH = 0.1
#: Words held before a partial count is passed on; tokens scored in one go.
COUNTED, SCORED = 2_000_000, 2_000_000
#: How far below the shift of a softmax a value may lie; its exponential and its neighbours keep their digits.
SHIFT = 40
FIELDS = ("inputs", "state", "classes", "class_bias", "heads", "head_bias")


@dataclass(frozen=True)
class Params:
    state: int = 16
    heads: int = 1024
    width: int = 32
    tails: int = 32
    known: int = 262_144
    #: Bytes of text to a shard; documents are dealt whole.
    shard: int = 24 << 20
    lanes: int = 256
    window: int = 16
    rate: float = 0.01
    epochs: int = 3
    seed: int = 7

    def __post_init__(self) -> None:
        if self.heads % self.width:
            raise ValueError("heads must fill their classes")

    @property
    def head_classes(self) -> int:
        return self.heads // self.width


def tokens(text: str | None) -> list[bytes]:
    out = (text or "").encode("utf-8", "replace").lower().split()
    out.append(END)
    return out


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row and how many each text has: ``tokens`` without the ends."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null("")))
    parts = pc.ascii_split_whitespace(texts)
    words, sizes = parts.flatten().cast(pa.binary()), parts.value_lengths().to_numpy()
    none = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    if none.any():  # their only part is empty
        words = words.filter(pc.greater(pc.binary_length(words), 0))
    return words, sizes - none


def tail_class(word: bytes, tails: int) -> int:
    return zlib.crc32(word[-3:]) % tails


def count_words(documents: DataFrame, params: Params) -> DataFrame:
    """(word, tail, n) over all texts; partial counts are made before the shuffle."""
    def run(batches):
        held, size, texts = [], 0, 0

        def passed():
            words, n = pc.value_counts(pa.chunked_array(held, pa.binary())).flatten()
            words = [*words.to_pylist(), END]
            return pa.RecordBatch.from_pydict({
                "word": pa.array(words, pa.binary()),
                "tail": pa.array([tail_class(w, params.tails) for w in words], pa.int32()),
                "n": pa.array([*n.to_pylist(), texts], pa.int64())})

        for batch in batches:
            words, sizes = split_words(batch.column(0))
            held.append(words)
            size += len(words)
            texts += len(sizes)
            if size >= COUNTED:
                yield passed()
                held, size, texts = [], 0, 0
        if texts:
            yield passed()

    return (map_batches(documents.select("text"), run, "word binary, tail int, n long")
            .groupBy("word", "tail").agg(F.sum("n").alias("n")))


class Lexicon:
    """The known words by rank, their classes and counts, and the totals of all words."""

    def __init__(self, words: list[bytes], counts: np.ndarray, tails: np.ndarray, total: int, distinct: int,
                 tail_counts: np.ndarray, tail_kinds: np.ndarray, params: Params) -> None:
        """tail_counts, tail_kinds: tokens and distinct words of each tail class, heads included."""
        self.words, self.total, self.distinct, self.params = words, total, distinct, params
        self.size = min(params.heads, len(words))
        rank = np.arange(len(words))
        head = rank < self.size
        self.symbol = np.where(head, rank, params.heads + tails).astype(np.int32)
        tail_counts = tail_counts - np.bincount(tails[:self.size], counts[:self.size], params.tails)
        tail_kinds = tail_kinds - np.bincount(tails[:self.size], minlength=params.tails)
        self.log_count = np.log10(counts + SMOOTH)
        self.tail_total = np.log10(tail_counts + SMOOTH * (tail_kinds + 1))
        self.base_total = float(np.log10(total + SMOOTH * (distinct + 1)))

    def places(self) -> "Places":
        return Places(self)

    def symbols(self, ranks: np.ndarray) -> np.ndarray:
        known = self.symbol[ranks] if len(self.words) else 0
        return np.where(ranks >= 0, known, self.params.heads - 1 - ranks).astype(np.int32)


class Places(dict):
    """Word to its rank, or to -1 - tail class where the word is not among the known."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__(zip(lexicon.words, range(len(lexicon.words))))
        self.tails, self.words = lexicon.params.tails, pa.array(lexicon.words, pa.binary())

    def __missing__(self, word: bytes) -> int:
        return -1 - tail_class(word, self.tails)

    def ranks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
        """The numbers of all tokens of the texts in a row, how many each text has, and the words that are not known."""
        words, sizes = split_words(texts)
        found = pc.index_in(words, value_set=self.words)
        ranks, unknown = found.fill_null(-1).to_numpy().astype(np.int64), found.is_null()
        others = words.filter(unknown).dictionary_encode()
        numbers = np.array([self[w] for w in others.dictionary.to_pylist()], np.int64)
        ranks[unknown.to_numpy(zero_copy_only=False)] = numbers[others.indices.to_numpy()]
        return np.insert(ranks, np.cumsum(sizes), self[END]), sizes + 1, others


def lexicon(counts: DataFrame, params: Params) -> Lexicon:
    """From written counts; the driver gets ``known`` words and a row per tail class."""
    top = counts.orderBy(F.desc("n"), "word").limit(params.known).toArrow()
    sums = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()
    tail_counts, tail_kinds = np.zeros(params.tails), np.zeros(params.tails)
    for row in sums:
        tail_counts[row["tail"]], tail_kinds[row["tail"]] = row["n"], row["kinds"]
    return Lexicon(top.column("word").to_pylist(), top.column("n").to_numpy().astype(np.int64),
                   top.column("tail").to_numpy().astype(np.int64), int(tail_counts.sum()), int(tail_kinds.sum()),
                   tail_counts, tail_kinds, params)


def fresh_weights(params: Params) -> dict[str, np.ndarray]:
    draw, h = np.random.default_rng(params.seed), params.state
    symbols, classes = params.heads + params.tails + 1, params.head_classes + params.tails
    sizes = {"inputs": (symbols, 3 * h), "state": (h, 3 * h), "classes": (h, classes), "class_bias": (classes,),
             "heads": (params.heads, h), "head_bias": (params.heads,)}
    return {k: (draw.normal(0, 0.1, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in sizes.items()}


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in FIELDS])


def views(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Arrays of the shapes of ``like`` in the memory of ``values``, in the order of ``flat``."""
    out, at = {}, 0
    for key in FIELDS:
        out[key] = values[at:at + like[key].size].reshape(like[key].shape)
        at += like[key].size
    return out


def unflat(values: np.ndarray, params: Params) -> dict[str, np.ndarray]:
    return views(np.array(values, np.float32), fresh_weights(params))


class Lanes:
    """Documents side by side: inputs, targets, starts and document numbers as (time, lane) arrays.

    The longest lanes stand first, so the lanes still running are always a prefix.
    """

    def __init__(self, docs: list[np.ndarray], most: int, params: Params) -> None:
        sizes = np.array([len(d) for d in docs])
        lanes = int(max(1, min(most, sizes.sum() // sizes.max())))
        held, filled = [[] for _ in range(lanes)], np.zeros(lanes, np.int64)
        for i in np.argsort(-sizes, kind="stable"):
            lane = int(filled.argmin())
            held[lane].append(i)
            filled[lane] += sizes[i]
        order = np.argsort(-filled, kind="stable")
        self.lengths = filled[order]
        shape = int(self.lengths[0]), lanes
        first = params.heads + params.tails
        self.targets, self.inputs = np.zeros(shape, np.int32), np.full(shape, first, np.int32)
        self.doc, self.starts = np.zeros(shape, np.int32), np.zeros(shape, bool)
        for column, lane in enumerate(order):
            at = 0
            for i in held[lane]:
                end = at + len(docs[i])
                self.targets[at:end, column] = docs[i]
                self.inputs[at + 1:end, column] = docs[i][:-1]
                self.doc[at:end, column] = i
                self.starts[at, column] = True
                at = end

    def windows(self, size: int):
        for at in range(0, len(self.targets), size):
            end = min(at + size, len(self.targets))
            running = int((self.lengths > at).sum())
            valid = np.arange(at, end)[:, None] < self.lengths[None, :running]
            cut = slice(at, end), slice(0, running)
            yield self.inputs[cut], self.targets[cut], self.starts[cut], self.doc[cut], valid


def _sigmoid_of_negative(x: np.ndarray) -> None:
    """The sigmoid of ``-x`` in place."""
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _by_gate(state: np.ndarray) -> np.ndarray:
    """The recurrent weights as (gate, from, to)."""
    h = len(state)
    return np.ascontiguousarray(state.reshape(h, 3, h).transpose(1, 0, 2))


def run_window(w: dict, inputs, starts, state, keep: bool = False):
    """States after each step of a window, and what the way back needs: both gates and the new value, per step the
    state before and the recurrent part of the new value. Each is one stretch of memory a step."""
    steps, lanes = inputs.shape
    h = state.shape[1]
    states = np.empty((steps, lanes, h), np.float32)
    pulled = np.empty((steps if keep else 1, lanes, h), np.float32)
    sign = np.repeat(np.array([-1, -1, 1], np.float32), h)
    given, recurrent = (w["inputs"] * sign).reshape(-1, h), _by_gate(w["state"] * sign)
    gates = np.take(given, 3 * inputs + np.arange(3, dtype=inputs.dtype)[:, None, None], axis=0)
    fresh = starts.any(axis=1)
    begun, sums, part = state, np.empty((2, lanes, h), np.float32), np.empty((lanes, h), np.float32)
    for t in range(steps):
        if fresh[t]:
            state = state * ~starts[t][:, None]
        zr, n, gn = gates[:2, t], gates[2, t], pulled[t if keep else 0]
        zr += np.matmul(state, recurrent[:2], out=sums)
        _sigmoid_of_negative(zr)
        np.matmul(state, recurrent[2], out=gn)
        n += np.multiply(zr[1], gn, out=part)
        np.tanh(n, out=n)
        np.subtract(state, n, out=part)
        part *= zr[0]
        state = np.add(n, part, out=states[t])
    if not keep:
        return states, None
    before = np.concatenate([begun[None], states[:-1]])
    for t in np.flatnonzero(fresh):
        before[t] *= ~starts[t][:, None]
    return states, (gates, before, pulled)


def class_of(targets: np.ndarray, params: Params) -> np.ndarray:
    return np.where(targets < params.heads, targets // params.width, params.head_classes + targets - params.heads)


def _exponents(x: np.ndarray, own):
    """Exponentials in place of ``x``, their sum in each row, and the logarithm of the share at ``own``.

    One shift serves all rows where none lies far below it; a row's largest value is at least its own one."""
    found = x[own]
    top = x.max(initial=0)
    if top - found.min(initial=0) > SHIFT:
        top = x.max(axis=1, keepdims=True)
    x -= top
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], np.float32)
    return x, total, found - np.ravel(top) - np.log(total)


def _sorting(symbols: np.ndarray, params: Params) -> np.ndarray:
    """The order of symbols; short numbers are sorted by digits."""
    return np.argsort(symbols.astype(np.min_scalar_type(params.heads + params.tails)), kind="stable")


class HeadTargets:
    """The targets that are heads, sorted, with the exponentials of each within its class, their sum and the log of its own share."""

    def __init__(self, w: dict, states: np.ndarray, targets: np.ndarray, size: int, params: Params) -> None:
        self.params = params
        places = np.flatnonzero(targets < params.heads)
        self.places = places = places[_sorting(targets[places], params)]
        words, self.states = targets[places], states[places]
        kinds = words // params.width
        self.own = np.arange(len(places)), words - kinds * params.width
        self.begins = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))[:len(places)]
        self.kinds = kinds[self.begins]
        self.parts = list(zip(self.kinds.tolist(), self.begins.tolist(), [*self.begins[1:].tolist(), len(places)]))
        logits = np.empty((len(places), params.width), np.float32)
        for k, begin, end in self.parts:
            rows = slice(k * params.width, (k + 1) * params.width)
            np.matmul(self.states[begin:end], w["heads"][rows].T, out=logits[begin:end])
            if (k + 1) * params.width > size:  # words that do not exist
                logits[begin:end, size - k * params.width:] = -np.inf
        logits += w["head_bias"].reshape(-1, params.width)[kinds]
        self.shares, self.total, self.found = _exponents(logits, self.own)

    def back(self, w: dict, g: dict, dh: np.ndarray, n: int) -> None:
        """Add the gradients of the weights and of the states."""
        pull = self.shares
        pull *= (1 / (n * self.total))[:, None]
        pull[self.own] -= np.float32(1 / n)
        down = np.empty_like(self.states)
        for k, begin, end in self.parts:
            rows = slice(k * self.params.width, (k + 1) * self.params.width)
            np.matmul(pull[begin:end].T, self.states[begin:end], out=g["heads"][rows])
            np.matmul(pull[begin:end], w["heads"][rows], out=down[begin:end])
        if len(self.places):
            g["head_bias"].reshape(-1, self.params.width)[self.kinds] = np.add.reduceat(pull, self.begins)
        dh[self.places] += down


def log_likelihoods(w: dict, states: np.ndarray, targets: np.ndarray, size: int, params: Params) -> np.ndarray:
    """Natural log of class and, for heads, of the word in its class. size: heads that exist."""
    logits = states @ w["classes"]
    logits += w["class_bias"]
    _, _, out = _exponents(logits, (np.arange(len(targets)), class_of(targets, params)))
    heads = HeadTargets(w, states, targets, size, params)
    out[heads.places] += heads.found
    return out


def gradients(w: dict, inputs, targets, starts, valid, state, size: int, params: Params):
    """Loss (nats a token), gradients and last state of one window of truncated backpropagation."""
    steps, lanes = inputs.shape
    h = params.state
    states, (gates, before, gn) = run_window(w, inputs, starts, state, keep=True)
    g = views(np.zeros(sum(v.size for v in w.values()), np.float32), w)
    every = bool(valid.all())
    at = slice(None) if every else valid.ravel()
    hs, ys = states.reshape(-1, h)[at], targets.ravel()[at]
    n = max(1, len(ys))
    logits = hs @ w["classes"]
    logits += w["class_bias"]
    own = np.arange(len(ys)), class_of(ys, params)
    push, total, found = _exponents(logits, own)
    loss = -found.sum()
    push *= (1 / (n * total))[:, None]
    push[own] -= np.float32(1 / n)
    np.matmul(hs.T, push, out=g["classes"])
    np.matmul(np.ones(len(ys), np.float32), push, out=g["class_bias"])
    dh = push @ w["classes"].T
    heads = HeadTargets(w, hs, ys, size, params)
    loss -= heads.found.sum()
    heads.back(w, g, dh, n)
    outer = dh
    if not every:
        outer = np.zeros((steps * lanes, h), np.float32)
        outer[at] = dh
    outer = outer.reshape(steps, lanes, h)
    z, r, new = gates
    # What does not depend on the way back is worked out for all steps at once.
    to_n, to_z, to_r = (1 - z) * (1 - new * new), (before - new) * z * (1 - z), gn * r * (1 - r)
    turned, fresh = np.ascontiguousarray(_by_gate(w["state"]).transpose(0, 2, 1)), starts.any(axis=1)
    d_inputs, d_pulled = np.empty((3, steps, lanes, h), np.float32), np.empty((steps, lanes, h), np.float32)
    back, sums = np.zeros((lanes, h), np.float32), np.empty((3, lanes, h), np.float32)
    for t in range(steps - 1, -1, -1):
        d = outer[t]
        d += back
        da, dg = d_inputs[:, t], d_pulled[t]
        np.multiply(d, to_n[t], out=da[2])
        np.multiply(d, to_z[t], out=da[0])
        np.multiply(da[2], to_r[t], out=da[1])
        np.multiply(da[2], r[t], out=dg)
        np.matmul(da[:2], turned[:2], out=sums[:2])
        np.matmul(dg, turned[2], out=sums[2])
        np.multiply(d, z[t], out=back)
        for part in sums:
            back += part
        if fresh[t]:
            back *= ~starts[t][:, None]
    for k, part in enumerate((d_inputs[0], d_inputs[1], d_pulled)):
        g["state"][:, k * h:(k + 1) * h] = before.reshape(-1, h).T @ part.reshape(-1, h)
    symbols = inputs.ravel()
    order = _sorting(symbols, params)
    symbols = symbols[order]
    begins = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
    by_symbol = d_inputs.reshape(3, -1, h).transpose(1, 0, 2).reshape(-1, 3 * h)[order]
    g["inputs"][symbols[begins]] = np.add.reduceat(by_symbol, begins)
    return float(loss) / n, g, states[-1]


def fit(docs: list[np.ndarray], size: int, params: Params, weights: dict | None = None, epochs: int | None = None,
        rate: float | None = None) -> dict[str, np.ndarray]:
    """Adam over windows; the state is carried on between windows, gradients are not."""
    begun = weights or fresh_weights(params)
    values = flat(begun)
    w = views(values, begun)
    if not docs:
        return w
    first, second, change, root = (np.zeros_like(values) for _ in range(4))
    step, rate = 0, rate or params.rate
    lanes = Lanes(docs, params.lanes, params)
    for _ in range(epochs or params.epochs):
        state = np.zeros((lanes.targets.shape[1], params.state), np.float32)
        for inputs, targets, starts, _doc, valid in lanes.windows(params.window):
            _, g, last = gradients(w, inputs, targets, starts, valid, state[:inputs.shape[1]], size, params)
            state, g = last, flat(g)
            step += 1
            scale = np.float32(rate * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step))
            np.subtract(g, first, out=change)
            change *= np.float32(0.1)
            first += change
            np.multiply(g, g, out=change)
            change -= second
            change *= np.float32(0.001)
            second += change
            np.sqrt(second, out=root)
            root += np.float32(1e-8)
            np.multiply(first, scale, out=change)
            change /= root
            values -= change
    return w


def train(documents: DataFrame, lex: Lexicon, params: Params) -> np.ndarray:
    """Weights fitted on all texts (doc_id, text)."""
    nbytes = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-nbytes // params.shard))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    dealt = materialize(documents.select("text", draw.alias("draw")).select(
        "text", "draw", F.least(F.floor(F.col("draw") * shards), F.lit(shards - 1)).cast("int").alias("shard")),
        "lm-shards")
    context = documents.sparkSession.sparkContext
    shared = context.broadcast(lex)

    def fitted(texts: list[pa.Array], start: np.ndarray | None) -> np.ndarray:
        known = shared.value
        places, docs = known.places(), []
        for part in texts:
            ranks, sizes, _ = places.ranks(part)
            docs += np.split(known.symbols(ranks), np.cumsum(sizes))[:-1]
        if start is None:
            return flat(fit(docs, known.size, params))
        return flat(fit(docs, known.size, params, unflat(start, params), 1, params.rate / 3))

    def base(batches):
        texts = [b.column(0) for b in batches]
        yield pa.RecordBatch.from_pydict({"w": [fitted(texts, None).tobytes()]})

    one = dealt.filter("shard = 0").repartition(1).sortWithinPartitions("draw").select("text")
    row = map_batches(one, base, "w binary").first()
    weights = np.frombuffer(row["w"], np.float32) if row else flat(fresh_weights(params))
    begun = context.broadcast(weights)

    def refine(group: pa.Table) -> pa.Table:
        texts = group.sort_by("draw").column("text").chunks
        return pa.table({"w": pa.array([fitted(texts, begun.value)], pa.list_(pa.float32()))})

    averaged = (dealt.groupBy("shard").applyInArrow(refine, "w array<float>")
                .select(F.posexplode("w").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).toArrow())
    out = weights.copy()
    out[averaged.column("i").to_numpy()] = averaged.column("x").to_numpy()
    return out


def document_scores(texts: list | pa.Array, places: Places, lex: Lexicon, w: dict, params: Params):
    """Per text: tokens, known tokens, log10 of their smoothed counts, network part, and the other words by number."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    ranks, sizes, others = places.ranks(texts)
    begins, row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    found, symbols = ranks >= 0, lex.symbols(ranks)
    logs = np.zeros(len(ranks))
    logs[found] = lex.log_count[ranks[found]]
    base, known = np.add.reduceat(logs, begins), np.add.reduceat(found, begins, dtype=np.int64)
    tail = symbols >= params.heads
    logs[~tail] = 0
    logs[tail] -= lex.tail_total[symbols[tail] - params.heads]
    part = np.add.reduceat(logs, begins)
    # Each word that is not known stands once a text, with how often it occurs in it.
    found[begins + sizes - 1] = True
    kinds = max(1, len(others.dictionary))
    keys, times = np.unique(row[~found] * kinds + others.indices.to_numpy(), return_counts=True)
    words, times = others.dictionary.take(pa.array(keys % kinds)).to_pylist(), times.tolist()
    cuts = np.searchsorted(keys // kinds, np.arange(len(sizes) + 1)).tolist()
    rare = [Counter(dict(zip(words[i:j], times[i:j]))) for i, j in zip(cuts, cuts[1:])]
    if places[END] < 0:
        for each in rare:
            each[END] = 1
    docs = np.split(symbols, begins[1:])
    lanes = Lanes(docs, 256, params)
    state = np.zeros((lanes.targets.shape[1], params.state), np.float32)
    for inputs, targets, starts, doc, valid in lanes.windows(64):
        states, _ = run_window(w, inputs, starts, state[:inputs.shape[1]])
        state = states[-1]
        at = valid.ravel()
        logs = log_likelihoods(w, states.reshape(-1, params.state)[at], targets.ravel()[at], lex.size, params)
        part += np.bincount(doc.ravel()[at], logs.astype(np.float64), len(texts)) / np.log(10)
    return sizes.tolist(), known.tolist(), base, part, rare


def score(documents: DataFrame, counts: DataFrame, lex: Lexicon, weights: np.ndarray, held: Column,
          params: Params) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast((lex, weights))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known, values = shared.value
        places, w = known.places(), unflat(values, params)
        held_rows, texts, size = [], [], 0

        def passed():
            n, found, base, part, rare = document_scores(pa.concat_arrays(texts), places, known, w, params)
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([b.column(i) for b in held_rows]) for i in range(3)]
                + [pa.array(n, pa.int64()), pa.array(found, pa.int64()), pa.array(base), pa.array(part),
                   pa.array([list(x) for x in rare], pa.list_(pa.binary())),
                   pa.array([list(x.values()) for x in rare], pa.list_(pa.int64()))],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "part", "rare", "times"])

        for batch in batches:
            held_rows.append(batch)
            texts.append(batch.column(3))
            size += batch.column(3).nbytes
            if size >= 6 * SCORED:
                yield passed()
                held_rows, texts, size = [], [], 0
        if texts:
            yield passed()

    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", held.alias("held_out"), "text")
    scored = materialize(map_batches(rows, run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, "
                                                "base double, part double, rare array<binary>, times array<long>"), "lm-scores")
    # A word stands once a text here, however often it occurs in it.
    rare = (scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
            .select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
            .join(counts.select("word", "n"), "word", "left")
            .groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("more"),
                                F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("logs")))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.drop("rare", "times").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * lex.base_total).alias("base_score"),
        (F.col("part") + logs).alias("score"))


def language_model_scores(documents: DataFrame, held: Column, params: Params = Params()) -> DataFrame:
    """Count and fit on rows that are not held out, score every row."""
    learned = documents.select("doc_id", "text").filter(~held)
    counts = materialize(count_words(learned, params), "word-counts")
    lex = lexicon(counts, params)
    return score(documents, counts, lex, train(learned, lex, params), held, params)
