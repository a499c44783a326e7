"""Byte-level BPE by backtracking over longest matches.

Bytes are mapped to Latin-1 characters so that a string automaton can search them. One pass of the
automaton gives the longest token that starts at each byte. The encoder walks forward with the
longest token and, where it may not follow the token before it, takes the next shorter token that is
its prefix, or steps back and marks the place as dead; a place is tried once per token, so the work
is linear. Two tokens may stand side by side if merging their joined bytes would give just these
two, which is decided by undoing merges from the border outwards and remembered per pair.

A piece that is a token as a whole is that token, as in the common encoders.
"""

import base64
from functools import cached_property
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
import regex

from egresslens.llm.common import Memo, map_batches


def read_ranks(data: bytes) -> list[bytes]:
    """Tokens in order of rank, from a rank file: base64 token and rank on each line."""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, data.splitlines()) if token)
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must count from 0 without gaps")
    return [token for _, token in pairs]


class Vocabulary:
    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.rank = {token: i for i, token in enumerate(tokens)}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("every byte must be a token")
        self.fits = Memo(lambda key: self._border_holds(key >> 32, key & 0xFFFFFFFF))

    @cached_property
    def halves(self) -> list[tuple[int, int] | None]:
        """The last merge that makes each token; None for single bytes and for tokens no merge reaches."""
        return [self._last_merge(token) for token in self.tokens]

    @cached_property
    def merged(self) -> dict[tuple[int, int], int]:
        return {pair: i for i, pair in enumerate(self.halves) if pair}

    @cached_property
    def shorter(self) -> list[int]:
        """The next shorter token that starts each token, -1 if none."""
        out = []
        for token in self.tokens:
            cut = len(token) - 1
            while cut and token[:cut] not in self.rank:
                cut -= 1
            out.append(self.rank[token[:cut]] if cut else -1)
        return out

    @cached_property
    def automaton(self):
        search = ahocorasick.Automaton()
        for i, token in enumerate(self.tokens):
            search.add_word(token.decode("latin-1"), (i, len(token)))
        search.make_automaton()
        return search

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranks = [self.rank.get(parts[i] + parts[i + 1], len(self.tokens)) for i in range(len(parts) - 1)]
            at = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[at] >= self.rank[token]:
                return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None

    def neighbours(self, left: int, right: int) -> bool:
        """Whether merging leaves a border between the two tokens."""
        return self.fits[left << 32 | right]

    def _border_holds(self, left: int, right: int) -> bool:
        # Undo the younger of the two merges at the border; a pair that could have merged before its
        # parts were taken by others breaks the border.
        limit = len(self.tokens)
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            undo_left, undo_right = self.halves[left], self.halves[right]
            if undo_left is None and undo_right is None:
                return True
            if undo_right is None or (undo_left is not None and left > right):
                limit, left = left, undo_left[1]
            else:
                limit, right = right + 1, undo_right[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        longest = [0] * size
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length + 1] = token  # ends grow, so the last token found at a start is the longest
        tokens, shorter, halves = self.tokens, self.shorter, self.halves
        alive = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            end = at + len(tokens[token])
            reachable = halves[token] is not None or len(tokens[token]) == 1
            if reachable and alive[end] and (not out or self.neighbours(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < size else 0
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                alive[at] = 0
                token = out.pop()
                at -= len(tokens[token])
        return out


class PieceMemo(Memo):
    """Piece of text to its ids, as 32-bit numbers in bytes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__(lambda piece: np.array(vocabulary.encode_piece(piece.encode()), np.int32).tobytes())

    def __missing__(self, piece: str) -> bytes:
        return super().__missing__(piece) if len(piece) < 64 else self.make(piece)  # long pieces hardly come back


class Codec:
    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.vocabulary = Vocabulary(tokens)
        self.pieces = regex.compile(pattern).findall
        self.memo = PieceMemo(self.vocabulary)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.pieces(text))), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids.tolist()))


_codecs: dict[tuple[str, int], Codec] = {}


def _codec(data: bytes, pattern: str) -> Codec:
    """Built once per Python worker and vocabulary."""
    key = pattern, hash(data)
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(data), pattern)
    return _codecs[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(documents: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """Add ``ids`` (array of int) to every row. A null text counts as empty and gives no ids.

    The vocabulary is a file of fixed size that the driver reads; executors get it by broadcast.
    """
    def ids_of(codec, texts):
        found = [codec.encode(text or "") for text in texts]
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return [("ids", pa.ListArray.from_arrays(offsets, np.concatenate(found) if found else np.empty(0, np.int32)))]
    return _per_text(documents, vocabulary, pattern, ids_of, "ids array<int>")


def decode(encoded: DataFrame, vocabulary: bytes) -> DataFrame:
    """Add ``decoded`` (binary) to rows with ``ids``; null ids count as none."""
    def bytes_of(codec, ids):
        return [("decoded", pa.array([codec.decode(np.array(x or [], np.int32)) for x in ids], pa.binary()))]
    return _per_text(encoded, vocabulary, "", bytes_of, "decoded binary", "ids")


def round_trip(documents: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """Encode and decode in one pass and keep digests only: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""
    def digests_of(codec, texts):
        counts, ids_hash, bytes_hash = [], [], []
        names = [str(i) for i in range(len(codec.vocabulary.tokens))]
        for text in texts:
            ids = codec.encode(text or "")
            counts.append(len(ids))
            ids_hash.append(hashlib.sha256(",".join(map(names.__getitem__, ids.tolist())).encode()).hexdigest())
            bytes_hash.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return [("n_tokens", pa.array(counts, pa.int64())), ("ids_sha256", pa.array(ids_hash, pa.string())),
                ("decoded_sha256", pa.array(bytes_hash, pa.string()))]
    return _per_text(documents, vocabulary, pattern, digests_of,
                     "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _per_text(df: DataFrame, vocabulary: bytes, pattern: str, fn, schema: str, column: str = "text") -> DataFrame:
    """``fn`` adds the columns of ``schema``, in place of any of the same names."""
    spark: SparkSession = df.sparkSession
    df = df.drop(*(field.split(" ")[0] for field in schema.split(", ")))
    shared = spark.sparkContext.broadcast(vocabulary)
    place = df.columns.index(column)

    def run(batches):
        codec = _codec(shared.value, pattern)
        for batch in batches:
            added = fn(codec, batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(x for _, x in added)],
                                             names=[*batch.schema.names, *(n for n, _ in added)])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_batches(df, run, f"{fields}, {schema}")
