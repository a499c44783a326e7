"""Similarity digests of whole contents, computed with numpy over each content.

``ctph_digest`` is the context triggered piecewise hash (J. Kornblum, 2006); ``locality_digest``
the trend locality sensitive hash (J. Oliver, C. Cheng, Y. Chen, 2013). Both are small helpers of
Arrow UDFs; comparing digests is left to Spark expressions and ``indel_score``.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType

# Fixed values of the piecewise hash.
B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, MIN_BLOCK, DIGEST_CHARS = 7, 3, 64
PIECE_START, PIECE_PRIME = 0x28021967, 0x01000193


def _rolling(data: np.ndarray) -> np.ndarray:
    """Rolling hash after each byte: window sum, weighted sum and shifted xor."""
    total = np.zeros(len(data), dtype=np.uint64)
    shifted = np.zeros(len(data), dtype=np.uint64)
    for age in range(min(WINDOW, len(data))):
        past = np.zeros(len(data), dtype=np.uint64)
        past[age:] = data[: len(data) - age]
        total += past * np.uint64(1 + WINDOW - age)
        shifted ^= past << np.uint64(5 * age)
    return (total + (shifted & np.uint64(0xFFFFFFFF))) & np.uint64(0xFFFFFFFF)


class _PieceHash:
    """Low six bits of the piece hash of any slice, from one pass per bit.

    A step is ``state * prime ^ byte``. With an odd prime, bit k of the product is bit k of the
    state flipped by a function of the lower bits, so each bit is a running xor once the lower
    bits are known.
    """

    def __init__(self, data: np.ndarray):
        self.data = data

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each [start, end); the slices are disjoint and ascending."""
        if not len(starts):
            return np.zeros(0, dtype=np.int64)
        sizes = ends - starts
        filled = sizes > 0
        out = np.full(len(starts), PIECE_START & 63, dtype=np.int64)
        if not filled.any():
            return out
        starts, ends, sizes = starts[filled], ends[filled], sizes[filled]
        body = np.concatenate([self.data[s:e] for s, e in zip(starts, ends)]).astype(np.int64) & 63
        last = np.cumsum(sizes) - 1
        first = last - sizes + 1
        before = np.zeros(len(body), dtype=np.int64)
        before[first] = PIECE_START & 63
        after = np.zeros(len(body), dtype=np.int64)
        inner = np.ones(len(body), dtype=bool)
        inner[first] = False
        inside = np.flatnonzero(inner)
        for bit in range(6):
            known = (before * PIECE_PRIME) >> bit & 1
            known[first] ^= (before[first] >> bit) & 1
            start_bit = (PIECE_START >> bit) & 1
            flips = known ^ (body >> bit & 1)
            run = np.cumsum(flips) & 1
            base = np.zeros(len(first), dtype=np.int64)
            base[1:] = run[first[1:] - 1]
            value = run ^ np.repeat(base, sizes) ^ start_bit
            after |= value << bit
            before[inside] |= value[inside - 1] << bit
        out[filled] = after[last]
        return out


def _pieces(marks: np.ndarray, size: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Slices between the first ``limit`` marks and the slice that is left."""
    used = marks[:limit] + 1
    return np.concatenate([[0], used]), np.concatenate([used, [size]])


def _signature(pieces: _PieceHash, marks: np.ndarray, size: int, limit: int, open_end: bool) -> str:
    codes = pieces.slices(*_pieces(marks, size, limit))
    text = "".join(B64[c] for c in codes[:-1])
    if open_end:
        return text + B64[codes[-1]]
    if len(marks) > limit:
        end = np.array([marks[-1] + 1])
        return text + B64[pieces.slices(np.array([marks[limit - 1] + 1]), end)[0]]
    return text


def ctph_digest(content: bytes) -> str:
    """``blocksize:signature:signature of the doubled block size``."""
    data = np.frombuffer(content, dtype=np.uint8)
    size = len(data)
    roll = _rolling(data.astype(np.uint64))
    block = MIN_BLOCK
    while block * DIGEST_CHARS < size:
        block *= 2
    marks = lambda b: np.flatnonzero(roll % np.uint64(b) == np.uint64(b - 1))
    while block > MIN_BLOCK and len(marks(block)) < DIGEST_CHARS // 2:
        block //= 2
    pieces = _PieceHash(data)
    open_end = size > 0 and roll[-1] != 0
    first = _signature(pieces, marks(block), size, DIGEST_CHARS - 1, open_end)
    second = _signature(pieces, marks(block * 2), size, DIGEST_CHARS // 2 - 1, open_end)
    return f"{block}:{first}:{second}"


# Fixed values of the locality hash: salt and lags of each of the six trigrams of a 5-byte window.
LOCALITY_WINDOW = 5
TRIGRAMS = [(2, 1, 2), (3, 1, 3), (5, 2, 3), (7, 2, 4), (11, 1, 4), (13, 3, 4)]
LOCALITY_MIN_BYTES = 50
BUCKETS = 128


def pearson_table(seed: int = 1990) -> np.ndarray:
    """A permutation of 0..255 made by a shuffle with a linear congruential generator.

    Digests of different tables are not comparable. To compare with digests made elsewhere,
    pass that tool's table.
    """
    table, state = list(range(256)), seed
    for i in range(255, 0, -1):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        j = (state >> 33) % (i + 1)
        table[i], table[j] = table[j], table[i]
    return np.array(table, dtype=np.uint8)


def _length_code(size: int) -> int:
    if size <= 656:
        code = math.floor(math.log(size) / math.log(1.5))
    elif size <= 3199:
        code = math.floor(math.log(size) / math.log(1.3) - 8.72777)
    else:
        code = math.floor(math.log(size) / math.log(1.1) - 62.5472)
    return code & 0xFF


def _swap(byte: int) -> int:
    return (byte & 0x0F) << 4 | byte >> 4


def locality_digest(content: bytes, table: np.ndarray) -> str | None:
    """70 hex digits: checksum, length, quartile ratios, 128 two-bit codes; NULL when too plain."""
    data = np.frombuffer(content, dtype=np.uint8)
    size = len(data)
    if size < LOCALITY_MIN_BYTES:
        return None
    at = lambda lag: data[LOCALITY_WINDOW - 1 - lag: size - lag]
    counts = np.zeros(256, dtype=np.int64)
    for salt, lag1, lag2 in TRIGRAMS:
        key = table[table[table[table[salt] ^ at(0)] ^ at(lag1)] ^ at(lag2)]
        counts += np.bincount(key, minlength=256)
    counts = counts[:BUCKETS]
    if np.count_nonzero(counts) <= BUCKETS // 2:
        return None
    ranked = np.sort(counts)
    q1, q2, q3 = (int(ranked[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    checksum, step = 0, table.tolist()
    for value in table[table[table[0] ^ at(0)] ^ at(1)].tolist():
        checksum = step[value ^ checksum]
    ratios = (q1 * 100 // q3) % 16 | (q2 * 100 // q3) % 16 << 4
    codes = (counts > q1).astype(np.int64) + (counts > q2) + (counts > q3)
    packed = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6])).sum(axis=1)[::-1]
    head = [_swap(checksum), _swap(_length_code(size)), _swap(ratios)]
    return "".join(f"{int(b):02X}" for b in head + packed.tolist())


def _over(fn, minimum: int):
    @pandas_udf(StringType())
    def digest(content: pd.Series) -> pd.Series:
        return content.map(lambda b: fn(bytes(b)) if b is not None and len(b) >= minimum else None)
    return digest


def ctph(content: Column, minimum: int = 1) -> Column:
    """Piecewise digest of a binary column; contents below ``minimum`` bytes get NULL."""
    return _over(ctph_digest, minimum)(content)


def locality(content: Column, table: np.ndarray, minimum: int = 1) -> Column:
    """Locality digest of a binary column; contents below ``minimum`` bytes get NULL.

    ``table`` is the permutation of the tool whose digests these are compared with.
    """
    permutation = np.asarray(table, dtype=np.uint8)
    if sorted(permutation.tolist()) != list(range(256)):
        raise ValueError("the table must be a permutation of 0..255")
    return _over(lambda b: locality_digest(b, permutation), minimum)(content)


def _codes(texts: pd.Series, fill: int) -> np.ndarray:
    grid = np.full((len(texts), DIGEST_CHARS), fill, dtype=np.uint8)
    for row, text in enumerate(texts):
        raw = np.frombuffer(text.encode("ascii"), dtype=np.uint8)
        if len(raw) > DIGEST_CHARS:
            raise ValueError("a signature has at most 64 characters")
        grid[row, : len(raw)] = raw
    return grid


def common_subsequence(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Longest common subsequence lengths of texts up to 64 characters, for all pairs at once.

    Row updates of the dynamic program are held as the bits of one word per pair.
    """
    a, b = _codes(left, 0), _codes(right, 1)
    bit = np.uint64(1) << np.arange(DIGEST_CHARS, dtype=np.uint64)
    row = np.full(len(left), np.uint64(2**64 - 1))
    for j in range(DIGEST_CHARS):
        match = np.where(a == b[:, j:j + 1], bit, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        hit = row & match
        row = (row + hit) | (row - hit)
    return np.bitwise_count(~row).astype(np.int64)


@pandas_udf(LongType())
def indel_score(left: pd.Series, right: pd.Series, block: pd.Series) -> pd.Series:
    """Score 0..100 of two signatures by insertions and deletions, bounded for small blocks."""
    len_a, len_b = left.str.len().to_numpy(np.int64), right.str.len().to_numpy(np.int64)
    total = np.maximum(len_a + len_b, 1)
    edits = len_a + len_b - 2 * common_subsequence(left, right)
    score = 100 - 100 * (edits * DIGEST_CHARS // total) // DIGEST_CHARS
    size = block.to_numpy(np.int64)
    bound = size // MIN_BLOCK * np.minimum(len_a, len_b)
    small = size < (99 + WINDOW) // WINDOW * MIN_BLOCK
    return pd.Series(np.where(small, np.minimum(score, bound), score))
