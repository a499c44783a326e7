"""Chat formatting in budgeted windows.

A turn is its text between the marks of its role; control strings inside texts get a backslash after
their first character, one more where they have some already, so reading back takes one away.
Prefix sums of the tokens of formatted turns choose spans of whole turns up to a budget. A later
window starts with the system turn (when the first turn is one and fits in half the budget) and with
the last ``history`` turns before its span as far as they fit in a quarter; both are repeats and stay
outside the loss mask, so every assistant text is a target once. A turn that does not fit beside its
history stands without it; one beyond the budget alone is a window of its own, whole and marked ``over``.

A conversation of more than ``stretch`` bytes is cut at turns by prefix sums of bytes: its turns are dealt
by ranges of their order, summed per range, and shifted by the sums of the ranges before. A stretch is a task's work; the turns that the first
window of a stretch repeats come along as copies. Only the digest of a whole conversation, which the
query asks for, is a sequence by nature: it is read in order with a state of fixed size.

Defined results: null texts and roles count as empty; any other role than system, user and assistant
is written out. Turns stand in order of turn (null first), then role, then text; repeated rows are turns
of their own. A null conv_id is a conversation. No rows give no windows. Other columns play no part.
"""

from dataclasses import dataclass
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from egresslens.llm.byte_bpe import Codec, read_ranks
from egresslens.llm.common import map_batches
from egresslens.session import materialize

#: Fixed marks: role to what stands before and behind a text; the mark of any other role holds its name.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
NAME, NAME_END, OTHER_END = "[ROLE]", "[/ROLE]", "</s>"
ESCAPE = re.compile(r"\[(?=\\*/?(?:SYS|INST|ROLE)\])|<(?=\\*/?s>)")
UNESCAPE = re.compile(r"(\[(?=\\+/?(?:SYS|INST|ROLE)\])|<(?=\\+/?s>))\\")
TURN = re.compile(r"\[SYS\](?P<system>.*?)\[/SYS\]|\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>"
                  r"|\[ROLE\](?P<name>.*?)\[/ROLE\](?P<other>.*?)</s>", re.DOTALL)
SYSTEM_COPY, HISTORY_COPY, OWN = 0, 1, 2


@dataclass(frozen=True)
class Params:
    budget: int = 1024
    history: int = 2
    #: Bytes of turns in a stretch, each turn counted with ``mark`` bytes more.
    stretch: int = 1 << 20
    mark: int = 16


def escape(text: str) -> str:
    return ESCAPE.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn with its marks, and where its escaped text starts and ends."""
    before, behind = MARKS.get(role) or (NAME + escape(role) + NAME_END, OTHER_END)
    inner = escape(text)
    return before + inner + behind, len(before), len(before) + len(inner)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; raises ValueError where the text is not a sequence of turns."""
    out, at = [], 0
    for match in TURN.finditer(formatted):
        if match.start() != at:
            break
        kind = match.lastgroup
        out.append((unescape(match["name"]) if kind == "other" else kind, unescape(match[kind])))
        at = match.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return out


def spans(costs: np.ndarray, first: int, system: int | None, params: Params) -> list[tuple[bool, int, int, int]]:
    """(repeat the system turn, first repeated turn, first new turn, end) of the windows over turns with these costs.

    Turns before ``first`` are copies that may be repeated only; ``system`` is the place of the system turn.
    """
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(costs)])
    n, at, out = len(costs), first, []
    lowest = 0 if system is None else system + 1
    while at < n:
        again = system is not None and system < at and 2 * costs[system] <= params.budget
        room = params.budget - (costs[system] if again else 0)
        low = max(lowest, at - params.history, int(np.searchsorted(upto, upto[at] - params.budget // 4)))
        end = int(np.searchsorted(upto, upto[min(low, at)] + room, "right")) - 1
        if end <= at:
            low, end = at, max(at + 1, int(np.searchsorted(upto, upto[at] + room, "right")) - 1)
        out.append((bool(again), min(low, at), at, end))
        at = end
    return out


def _big(turns: DataFrame, params: Params) -> DataFrame:
    """Turns of conversations beyond one stretch, cut into stretches, with copies of what their first windows repeat."""
    names = ["key", "turn", "role", "text"]
    ranged = turns.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("part", F.spark_partition_id())
    kinds = {f.name: f.dataType.simpleString() for f in ranged.schema}

    def number(batches):
        key, rows, size = None, 0, 0
        for batch in batches:
            numbers, before = [], []
            for now, nbytes in zip(batch.column("key").to_pylist(), batch.column("nbytes").to_pylist()):
                if now != key:
                    key, rows, size = now, 0, 0
                numbers.append(rows)
                before.append(size)
                rows, size = rows + 1, size + nbytes
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array(before, pa.int64())],
                                             names=[*batch.schema.names, "number", "before"])

    fields = ", ".join(f"{n} {t}" for n, t in kinds.items())
    ranged = materialize(map_batches(ranged, number, f"{fields}, number long, before long"), "ranged-turns")
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (ranged.groupBy("key", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("nbytes").alias("size"))
             .select("key", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows"),
                     F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("size")))
    placed = ranged.join(shift, ["key", "part"]).select(
        "conv_id", "key", "turn", "role", "text", (F.col("number") + F.col("rows")).alias("index"),
        F.floor((F.col("before") + F.col("size")) / params.stretch).alias("stretch"))
    placed = materialize(placed, "stretches")
    begins = placed.groupBy("key", "stretch").agg(F.min("index").alias("begin")).filter("begin > 0")
    system = F.col("index").eqNullSafe(F.lit(0)) & (F.col("role") == "system")
    back = begins.select("key", F.col("stretch").alias("to"), F.explode(F.expr(
        f"transform(sequence(1, {params.history}), i -> begin - i)")).alias("index"))
    columns = ["conv_id", "key", "turn", "role", "text", "stretch", "kind"]
    own = placed.withColumn("kind", F.lit(OWN))
    history = (placed.filter(~system).drop("stretch").join(back, ["key", "index"]).withColumnRenamed("to", "stretch")
               .withColumn("kind", F.lit(HISTORY_COPY)))
    first = (placed.filter(system).drop("stretch").join(begins.select("key", "stretch"), "key")
             .withColumn("kind", F.lit(SYSTEM_COPY)))
    parts = [own, first] + ([history] if params.history > 0 else [])
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.union(part.select(*columns))
    return out.withColumn("split", F.lit(True))


def stretches(conversations: DataFrame, params: Params) -> DataFrame:
    """(conv_id, key, turn, role, text, stretch, kind, split) of all turns and of the copies."""
    key = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    turns = conversations.select("conv_id", key.alias("key"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                                 F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("nbytes", F.octet_length("text") + F.octet_length("role") + params.mark)
    big = materialize(turns.groupBy("key").agg(F.sum("nbytes").alias("size")).filter(F.col("size") > params.stretch)
                      .select("key"), "long-conversations")
    small = turns.join(big, "key", "left_anti").select(
        "conv_id", "key", "turn", "role", "text", F.lit(0).cast("long").alias("stretch"), F.lit(OWN).alias("kind"),
        F.lit(False).alias("split"))
    return small.union(_big(turns.join(big, "key", "left_semi"), params)) if not big.isEmpty() else small


WINDOW_FIELDS = ("conv_id", "key", "stretch", "split", "window", "n_repeated", "n_tokens", "over", "formatted", "loss")


def windows(conversations: DataFrame, vocabulary: bytes, pattern: str, params: Params = Params()) -> DataFrame:
    """One row per window: conv_id, key, stretch, split, window, n_repeated, n_tokens, over, formatted, loss.

    ``window`` counts within a stretch, ``n_repeated`` the turns at its head that earlier windows hold, ``loss``
    lists where targets start and end in ``formatted``, in characters. Windows of a stretch follow each other.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    order = ["key", "stretch", "turn", "role", "text", "kind"]
    rows = (stretches(conversations, params).repartition("key", "stretch").sortWithinPartitions(*order)
            .select("conv_id", "key", "stretch", "split", "role", "text", "kind"))
    shared = conversations.sparkSession.sparkContext.broadcast(vocabulary)
    loss_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def of_stretch(codec, head, turns):
        """Rows of the windows of one stretch."""
        formatted = [format_turn(role, text) for role, text, _ in turns]
        costs = np.array([len(codec.encode(x)) for x, _, _ in formatted], np.int64)
        first = next(i for i, t in enumerate(turns) if t[2] == OWN)
        starts_with_system = turns[0][2] == SYSTEM_COPY or (head[2] == 0 and turns[0][0] == "system")
        for window, (again, low, at, end) in enumerate(spans(costs, first, 0 if starts_with_system else None, params)):
            held = ([0] if again else []) + list(range(low, end))
            text, loss, n = [], [], 0
            for i in held:
                whole, start, stop = formatted[i]
                if i >= at and turns[i][0] == "assistant":
                    loss.append({"start": n + start, "end": n + stop})
                text.append(whole)
                n += len(whole)
            cost = int(costs[held].sum())
            yield (*head, window, len(held) - (end - at), cost, cost > params.budget, "".join(text), loss)

    def run(batches):
        codec = Codec(read_ranks(shared.value), pattern)
        head, turns, out, size = None, [], [], 0
        conv_type = None

        def passed():
            columns = list(zip(*out))
            types = [conv_type, pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(),
                     pa.string(), loss_type]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=list(WINDOW_FIELDS))

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for conv_id, key, stretch, split, role, text, copy in zip(*(c.to_pylist() for c in batch.columns)):
                if head is None or head[1:3] != (key, stretch):
                    if head:
                        out += of_stretch(codec, head, turns)
                        size += sum(len(t[1]) for t in turns)
                    head, turns = (conv_id, key, stretch, split), []
                    if size >= params.stretch:
                        yield passed()
                        out, size = [], 0
                turns.append((role, text, copy))
        if head:
            out += of_stretch(codec, head, turns)
            yield passed()

    return map_batches(rows, run, f"conv_id {kind}, key string, stretch long, split boolean, window long, n_repeated long, "
                                  "n_tokens long, over boolean, formatted string, loss array<struct<start: long, end: long>>")


def read_window(formatted: str, n_repeated: int, loss: list[dict]) -> tuple[list[tuple[str, str]], str]:
    """The new turns of a window and its unescaped text under the loss mask."""
    turns = parse_turns(formatted)[n_repeated:]
    return turns, "".join(unescape(formatted[x["start"]:x["end"]]) for x in loss)


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, n_turns: int, turns: str, loss: str, chars: int) -> None:
        self.turns.update(turns.encode())
        self.loss.update(loss.encode())
        self.n_turns += n_turns
        self.loss_chars += len(loss)
        self.formatted_chars += chars


DIGEST_SCHEMA = ("split boolean, key string, stretch long, window long, turns string, loss string, n_turns long, "
                 "turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digests(found: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from windows.

    ``found`` is the result of ``windows`` itself, in whose tasks the windows of a stretch follow each other. A
    conversation of one stretch is done there; of others the texts go on, sorted, to be digested in order.
    """
    kind = found.schema["conv_id"].dataType.simpleString()

    def table(rows, conv_type):
        names = ["conv_id", *(f.split(" ")[0] for f in DIGEST_SCHEMA.split(", "))]
        types = [conv_type, pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(),
                 pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    def finished(conv_id, d):
        return (conv_id, False, None, None, None, None, None, d.n_turns, d.turns.hexdigest(), d.loss_chars,
                d.loss.hexdigest(), d.formatted_chars)

    def fold(pieces):
        """pieces: (conv_id, key, split, stretch, window, n_turns, turns, loss, chars, type) in order."""
        held, key, digest, rows, size, conv_type = None, None, None, [], 0, None
        for conv_id, now, split, stretch, window, n_turns, turns, loss, chars, conv_type in pieces:
            if digest and now != key:
                rows.append(finished(held, digest))
                digest = None
            if split:
                rows.append((conv_id, True, now, stretch, window, turns, loss, n_turns, None, None, None, chars))
                size += len(turns)
            else:
                digest = digest or _Digest()
                digest.add(n_turns, turns, loss, chars)
            held, key = conv_id, now
            if len(rows) >= 10_000 or size > 1 << 22:
                yield table(rows, conv_type)
                rows, size = [], 0
        if digest:
            rows.append(finished(held, digest))
        if rows:
            yield table(rows, conv_type)

    def read(batches):
        def pieces():
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                for conv_id, key, stretch, split, window, n_repeated, formatted, loss in zip(
                        *(c.to_pylist() for c in batch.columns)):
                    turns, target = read_window(formatted, n_repeated, loss)
                    yield (conv_id, key, split, stretch, window, len(turns),
                           "".join(f"{role}\n{text}\n" for role, text in turns), target, len(formatted), kind)
        return fold(pieces())

    def join(batches):
        def pieces():
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                for conv_id, key, stretch, window, n_turns, turns, loss, chars in zip(*(c.to_pylist() for c in batch.columns)):
                    yield conv_id, key, False, stretch, window, n_turns, turns, loss, chars, kind
        return fold(pieces())

    schema = f"conv_id {kind}, {DIGEST_SCHEMA}"
    first = materialize(map_batches(found.select("conv_id", "key", "stretch", "split", "window", "n_repeated", "formatted", "loss"),
                                    read, schema), "chat-digests")
    rest = (first.filter("split").select("conv_id", "key", "stretch", "window", "n_turns", "turns", "loss", "formatted_chars")
            .repartition("key").sortWithinPartitions("key", "stretch", "window"))
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return first.filter(~F.col("split")).select(*columns).union(map_batches(rest, join, schema).select(*columns))
