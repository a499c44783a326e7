"""Alignment of two tokenizers by coalescing token intervals.

Tokenizer A is a byte-level BPE, B a piece model with byte fallback that puts a space before the
text; A encodes a space and the text. Tokens are intervals of the same bytes. All tokens of a slice
of documents are sorted by start, and the running maximum of their ends tells where groups break: at
a start that reaches it, nothing before lies across. Inside a group every A token overlaps or
neighbours every B token; the occurrences expand to id pairs per document, each once with its number of times.

How many documents hold a pair is counted over all documents: in the tasks first, then by a shuffle
on the pair. The counts go back to the documents by broadcast in blocks of at most ``block`` pairs, one pass
over the written pairs for each block, so what is broadcast has a fixed size however many pairs there are.

Defined results: a null or empty text, and one whose bytes a tokenizer does not give back (the piece
model reads U+2581 as a space, for example), have no tokens: zeros and empty lists. Repeated rows
count as documents of their own. Other columns play no part, whatever their names.
"""

from array import array
from itertools import chain
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
import sentencepiece
import tiktoken

from egresslens.llm.common import MEMO_ENTRIES, map_batches
from egresslens.session import materialize

#: Bytes of text whose tokens are held at once; a longer text is held alone.
SLICE = 2_000_000
#: Token pairs expanded at once, and pairs of one group beyond which its ids are made distinct first.
EXPANDED, LARGE = 4_000_000, 65_536
#: How the piece model writes a space; a place where neither tokenizer joins what stands before and behind it.
SPACE, BORDER = "\u2581", re.compile(r"(?<=\S)(?= )")


def _byte_symbols() -> dict[str, int]:
    """Character of a byte-level vocabulary to its byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def read_byte_level(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level BPE file in JSON; ids must follow the order of the merges."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    symbols = _byte_symbols()
    special = [t for t in model["vocab"] if not all(c in symbols for c in t)]
    made = [left + right for left, right in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
    order = sorted((i, t) for t, i in model["vocab"].items() if t not in special)
    tokens = [bytes(symbols[c] for c in t) for _, t in order]
    known = [t for _, t in order]
    if [i for i, _ in order] != list(range(len(order))) or known[256:256 + len(made)] != made:
        raise ValueError("ids must count from 0 in the order of the merges")
    return tokens[:256 + len(made)]


class Sides:
    """Both tokenizers in one Python worker, and the bytes and the written id of every token.

    Neither makes a token across a border between something else than white space and a space (pieces of B that would
    are looked for), so texts are encoded stretch by stretch between such borders, and short stretches are remembered.
    """

    def __init__(self, tokens: list[bytes], pattern: str, model: bytes) -> None:
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)},
                                   special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.b.get_piece_size())
        names = list(map(self.b.id_to_piece, ids))
        pieces = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                  for i, p in zip(ids, names)]
        self.bytes = tokens, pieces
        self.sizes = tuple(np.array([len(t) for t in side], np.int64) for side in self.bytes)
        self.cut = BORDER.split if not any(SPACE in p.lstrip(SPACE) for p in names) else lambda text: [text]
        self.known = Stretches(self)

        def written(ends):
            return [np.array([f"{i}{end}" for i in range(len(side))], object) for side, end in zip(self.bytes, ends)]
        self.inner, self.last = written(",,"), written("|;")

    def stretch(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of a stretch, which starts with a space; None where the joined bytes are not its own."""
        whole = text.encode()
        a = self.a.encode_ordinary(text)
        b = self.b.encode(text[1:], out_type=int) if text != " " else [self.b.piece_to_id(SPACE)]
        same = all(b"".join(map(side.__getitem__, ids)) == whole for side, ids in zip(self.bytes, (a, b)))
        return (a, b) if same else None

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per side: numbers of tokens of the texts, and the ids end to end; no tokens where bytes are not given back."""
        self.known.make_room()
        cut = [self.cut(" " + t) if t else [] for t in texts]
        of_text = np.repeat(np.arange(len(texts)), list(map(len, cut)))
        rows = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, len(of_text))
        bad = np.zeros(len(texts), bool)
        bad[of_text[rows < 0]] = True
        good = ~bad[of_text]
        of_text, rows = of_text[good], rows[good]
        counts, ids = [], []
        for flat, ends in zip(self.known.ids, self.known.ends):
            ends = np.array(ends, np.int64)
            starts, sizes = ends[rows], ends[rows + 1] - ends[rows]
            before = np.cumsum(sizes) - sizes
            ids.append(np.array(flat, np.int64)[np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)])
            counts.append(np.bincount(of_text, sizes, len(texts)).astype(np.int64))
        return counts, ids


class Stretches(dict):
    """Stretch to its row in two tables of ids, one a side; -1 where bytes are not given back."""

    def __init__(self, sides: "Sides") -> None:
        super().__init__()
        self.sides = sides
        self.make_room(0)

    def make_room(self, most: int = MEMO_ENTRIES) -> None:
        if most == 0 or len(self) >= most or any(len(x) >= 8 * most for x in self.ids):
            self.clear()
            self.ids, self.ends = (array("i"), array("i")), (array("q", [0]), array("q", [0]))

    def __missing__(self, text: str) -> int:
        found = self.sides.stretch(text)
        self[text] = row = len(self.ends[0]) - 1 if found else -1
        for ids, ends, new in zip(self.ids, self.ends, found or ()):
            ids.extend(new)
            ends.append(len(ids))
        return row


def coalesce(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of every A and every B token, from their sizes in bytes over the same text."""
    sizes = np.concatenate([sizes_a, sizes_b])
    ends = np.concatenate([np.cumsum(sizes_a), np.cumsum(sizes_b)])
    starts = ends - sizes
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    fresh = np.append(True, starts[order][1:] >= reach[:-1])[:len(order)]
    groups = np.empty(len(order), np.int64)
    groups[order] = np.cumsum(fresh) - 1
    return groups[:len(sizes_a)], groups[len(sizes_a):]


def expand(ids_a: np.ndarray, ids_b: np.ndarray, groups_a: np.ndarray, groups_b: np.ndarray, docs: np.ndarray,
           width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, a, b) as one number, in order, and how often each is linked. docs: document of each group."""
    n = len(docs)
    in_a, in_b = np.bincount(groups_a, minlength=n), np.bincount(groups_b, minlength=n)
    from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    span = np.int64(width) << 32
    keys, times = [], []

    def passed(key, count=None):
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        keys.append(key[at])
        times.append(np.diff(np.append(at, len(key))) if count is None else np.add.reduceat(count[order], at))

    def doc_key(group):
        return docs[group] * span

    usual = in_a * in_b <= LARGE
    tokens = np.flatnonzero(usual[groups_a])
    repeats = in_b[groups_a[tokens]]
    upto = np.cumsum(repeats)
    at = 0
    while at < len(tokens):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + EXPANDED, "right")))
        part, times_b = tokens[at:end], repeats[at:end]
        group = np.repeat(groups_a[part], times_b)
        step = np.arange(len(group)) - np.repeat(np.cumsum(times_b) - times_b, times_b)
        passed(doc_key(group) + np.repeat(ids_a[part], times_b) * np.int64(width) + ids_b[from_b[group] + step])
        at = end
    for g in np.flatnonzero(~usual):
        a, many_a = np.unique(ids_a[from_a[g]:from_a[g] + in_a[g]], return_counts=True)
        b, many_b = np.unique(ids_b[from_b[g]:from_b[g] + in_b[g]], return_counts=True)
        step = max(1, EXPANDED // len(b))
        for at in range(0, len(a), step):
            part = a[at:at + step].astype(np.int64)
            passed((docs[g] * span + part[:, None] * width + b).ravel(),
                   (many_a[at:at + step, None] * many_b).ravel())
    if len(keys) != 1:
        key = np.concatenate([np.empty(0, np.int64), *keys])
        count = np.concatenate([np.empty(0, np.int64), *times])
        keys, times = [], []
        passed(key, count if len(count) else None)
    return keys[0], times[0]


def group_texts(sides: Sides, ids: tuple, groups: tuple, counts: list[int], docs: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of every document: ids of A and B, group by group."""
    n = len(docs)
    held = [np.bincount(g, minlength=n) for g in groups]
    upto = [np.cumsum(h) for h in held]
    out = np.empty(len(ids[0]) + len(ids[1]), object)
    for side in (0, 1):
        last = np.append(groups[side][1:] != groups[side][:-1], True)[:len(ids[side])]
        words = np.where(last, sides.last[side][ids[side]], sides.inner[side][ids[side]])
        before = (upto[1] - held[1])[groups[0]] if side == 0 else upto[0][groups[1]]
        out[np.arange(len(words)) + before] = words
    texts, at = [], 0
    for size in counts:
        texts.append("".join(out[at:at + size])[:-1])
        at += size
    return texts


def _aligned(sides: Sides, texts: list[str | None]) -> dict[str, pa.Array]:
    counts, ids = sides.encode(texts)
    groups = coalesce(*(sides.sizes[side][ids[side]] for side in (0, 1)))
    of_token = np.repeat(np.arange(len(texts)), counts[0])
    n_groups = int(groups[0][-1]) + 1 if len(groups[0]) else 0
    docs = np.zeros(n_groups, np.int64)
    docs[groups[0]] = of_token
    width = len(sides.bytes[1])
    keys, times = expand(*ids, *groups, docs, width)
    of_pair, pair = keys // (np.int64(width) << 32), keys % (np.int64(width) << 32)
    offsets = np.searchsorted(of_pair, np.arange(len(texts) + 1)).astype(np.int32)
    links = np.bincount(groups[0], minlength=n_groups) * np.bincount(groups[1], minlength=n_groups)
    linked = np.zeros(len(texts), np.int64)
    np.add.at(linked, docs, links)

    def listed(values, kind):
        return pa.ListArray.from_arrays(offsets, pa.array(values.astype(kind)))
    return {"n_a": pa.array(counts[0]), "n_b": pa.array(counts[1]),
            "n_groups": pa.array(np.bincount(docs, minlength=len(texts)).astype(np.int64)), "n_links": pa.array(linked),
            "groups": pa.array(group_texts(sides, ids, groups, (counts[0] + counts[1]).tolist(), docs), pa.string()),
            "a": listed(pair // width, np.int32), "b": listed(pair % width, np.int32), "times": listed(times, np.int64)}


_sides: dict[int, Sides] = {}


def align(documents: DataFrame, tokens: list[bytes], pattern: str, model: bytes) -> DataFrame:
    """One row per document: row, doc_id, n_a, n_b, n_groups, n_links, groups, and its distinct linked ids
    ``a``, ``b`` with their number of ``times`` (three lists of one length, in order of a and b).

    ``groups`` is text: ids of A, a bar, ids of B, group after group. Both tokenizers are files of fixed size.
    """
    shared = documents.sparkSession.sparkContext.broadcast((tokens, pattern, model))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        sides = _sides.get(0) or _sides.setdefault(0, Sides(*shared.value))
        for batch in batches:
            texts = batch.column(2).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= SLICE):
                    size += len(texts[end] or "")
                    end += 1
                found = _aligned(sides, texts[at:end])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at:end], batch.column(1)[at:end], *found.values()], names=["row", "doc_id", *found])
                at = end

    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return map_batches(rows, run, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, "
                                  "groups string, a array<int>, b array<int>, times array<long>")


def _flat(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sizes of the lists of a batch, and their values end to end."""
    lists = [batch.column(batch.schema.get_field_index(n)) for n in names]
    sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]


def pair_counts(aligned: DataFrame, held: int = EXPANDED) -> DataFrame:
    """(a, b, n): documents that hold a pair linked; counted in the tasks before the shuffle."""
    def run(batches):
        keys, waiting = [], 0

        def passed():
            key, n = np.unique(np.concatenate([np.empty(0, np.int64), *keys]), return_counts=True)
            return pa.RecordBatch.from_pydict({"a": pa.array((key >> 32).astype(np.int32)),
                                               "b": pa.array((key & 0xFFFFFFFF).astype(np.int32)), "n": pa.array(n.astype(np.int64))})

        for batch in batches:
            _, (a, b) = _flat(batch, "a", "b")
            keys.append(a << 32 | b)
            waiting += len(a)
            if waiting >= held:
                yield passed()
                keys, waiting = [], 0
        yield passed()

    return (map_batches(aligned.select("a", "b"), run, "a int, b int, n long")
            .groupBy("a", "b").agg(F.sum("n").alias("n")))


def with_counts(aligned: DataFrame, counts: DataFrame, block: int = EXPANDED) -> DataFrame:
    """``aligned`` without its lists, with ``n_best`` (links whose count is the highest of their A id) and
    ``count_sum`` (counts added up over links). Both tables should be written ones."""
    blocks = max(1, -(-counts.count() // block))
    kept = [c for c in aligned.columns if c not in ("a", "b", "times", "n_best", "count_sum")]
    fields = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in kept)
    context, parts = aligned.sparkSession.sparkContext, []
    for k in range(blocks):
        mine = counts.filter(F.pmod(F.xxhash64("a"), F.lit(blocks)) == k).select("a", "b", "n").toArrow()
        a, b, n = (mine.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n"))
        order = np.argsort(a << 32 | b)
        a, b, n = a[order], b[order], n[order]
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.empty(0, np.int64)
        most = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(a)))) if len(a) else n
        shared = context.broadcast((a << 32 | b, n, n == most))

        def run(batches, shared=shared):
            key, n, best = shared.value
            for batch in batches:
                sizes, (a, b, times) = _flat(batch, "a", "b", "times")
                wanted = a << 32 | b
                at = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
                found = (key[at] == wanted) if len(key) else np.zeros(len(wanted), bool)
                times = np.where(found, times, 0)
                row = np.repeat(np.arange(len(sizes)), sizes)
                sums = [np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)]
                if len(key):
                    np.add.at(sums[0], row, times * best[at])
                    np.add.at(sums[1], row, times * n[at])
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *map(pa.array, sums)],
                                                 names=[*kept, "n_best", "count_sum"])

        parts.append(map_batches(aligned.select(*kept, "a", "b", "times"), run, f"{fields}, n_best long, count_sum long"))
    if blocks == 1:
        return parts[0]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole.groupBy(*kept).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def link_statistics(documents: DataFrame, tokens: list[bytes], pattern: str, model: bytes,
                    block: int = EXPANDED) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of every row.

    The digest stands for ``groups`` so that the written table is small; it is empty without tokens.
    """
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows = materialize(align(documents, tokens, pattern, model).select(
        "row", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "a", "b", "times"), "aligned")
    counts = materialize(pair_counts(rows), "pair-counts")
    return with_counts(rows, counts, block)
