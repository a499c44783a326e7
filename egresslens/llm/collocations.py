"""Phrase collocations by Rabin-Karp fingerprints.

Texts become one long row of word numbers per flush, with a border between pieces. Prefix sums of
word hash times a power of an odd base, in 64 bits, give the fingerprint of any run of words as a
difference of two prefixes; language and length are mixed in. Levels prune each other: a pair can be
frequent only if both words are, a run of three or four only if its pairs are. Each level is counted by
the upper 40 bits of its fingerprints, in the tasks and after a shuffle, in which a task sends the sorted
fingerprints of a range as one block of differences and counts. The frequent ones set bits in a
table of fixed size that goes to the next level by broadcast. Fingerprints that fall together and a
full table only prune less and change no result.

The last pass looks at runs whose fingerprint is marked: within a flush the words of all
occurrences of a fingerprint are compared, so a pointer (document and word place) stands for one
phrase; its text is read at the pointer, and a shuffle of compressed blocks, one a range of fingerprints, adds up counts
by text and keeps a pointer. The fingerprint only picks the range and is not sent: two phrases of one fingerprint part by
their text, and one that is rare after all is dropped. Only such phrases become text. A task adds up what it has before it
sends it; a block is written column by column, numbers as byte planes.

Scores are cut points of a phrase: 2,000,000 * a / (l + r), rounded down, in decimals of 38 digits.

Defined results: a null text has no words, a null language is ``und``. Repeated rows count each.
Ties are broken as stated in ``scored`` and ``top``. Empty tables give no rows. Other columns play no part.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
import xxhash

from egresslens.llm.common import map_batches
from egresslens.session import materialize

#: Fixed values of the contract: what ends a piece, what stands between words.
PIECE_ENDS, BLANKS = ".,;:!?\n\x0b\x0c\r", "\t "
BORDER = b"."
CLEANED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PIECE_ENDS.encode() + BLANKS.encode(),
                          b"abcdefghijklmnopqrstuvwxyz" + BORDER * len(PIECE_ENDS) + b" " * len(BLANKS))
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
NO_LANG = "und"
#: Bits of a 64-bit fingerprint that the levels leave out; ranges of the rest at least, so that differences fit 32 bits.
DROPPED, RANGES = 24, 256
PACKER = pa.Codec("zstd")
#: Parts in which the phrases of a language are ranked before they are ranked together.
SALTS = 64


@dataclass(frozen=True)
class Params:
    longest: int = 4
    least: int = 30
    #: A phrase goes when a longer one has this share of its occurrences, in hundredths.
    covered: int = 80
    scale: int = 2_000_000
    top: int = 2000
    #: Words of a flush; a longer text is a flush of its own. Bits of the table of a level.
    flush: int = 250_000
    bits: int = 1 << 26
    #: Fingerprints, and phrases, gathered in a task before they are sent; bytes of text to a range of them.
    gathered: int = 3_000_000
    gathered_phrases: int = 1_200_000
    spread: int = 1 << 22


class Numbers(dict):
    """Word to its number in a flush; 0 is the border."""

    def __init__(self) -> None:
        super().__init__({BORDER: 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def pieces_and_words(text: str) -> list[bytes]:
    """Words of the pieces of a text, with borders between pieces."""
    return text.encode().translate(CLEANED).replace(BORDER, b" . ").split()


class Flush:
    """Word numbers of many texts, the prefixes of their polynomial, and the language of every place."""

    def __init__(self, texts: list[list[bytes]], langs: list[str]) -> None:
        numbers = Numbers()
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        words = np.zeros(int(sizes.sum()), np.int32)
        self.begins = np.cumsum(sizes) - sizes
        for at, text in zip(self.begins.tolist(), texts):
            words[at:at + len(text)] = np.fromiter(map(numbers.__getitem__, text), np.int32, len(text))
        self.texts, self.langs, self.words = texts, langs, words
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        kinds = {x: i for i, x in enumerate(dict.fromkeys(langs))}
        self.lang = np.repeat(np.array([kinds[x] for x in langs], np.int32), sizes)
        seeds = np.array([xxhash.xxh64_intdigest(x.encode(), 1) for x in kinds], np.uint64)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
        self.seeds = seeds[self.lang]
        powers = np.full(len(words), BASE)
        powers[:1] = 1
        np.multiply.accumulate(powers, out=powers)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(hashes[words] * powers)])
        back = np.full(len(words), BACK)
        back[:1] = 1
        self.back = np.multiply.accumulate(back, out=back)
        self.borders = np.concatenate([np.zeros(1, np.int64), np.cumsum(words == 0)])

    def fingerprints(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the run of ``size`` words at every place, and whether the run lies in one piece."""
        n = max(0, len(self.words) - size + 1)
        keys = (self.prefix[size:] - self.prefix[:n]) * self.back[:n] + self.seeds[:n] + np.uint64(size * int(MIX) % (1 << 64))
        keys = (keys ^ (keys >> np.uint64(31))) * MIX
        return keys ^ (keys >> np.uint64(29)), self.borders[size:] == self.borders[:n]

    def phrases(self, size: int, keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place of every phrase among ``places`` and how many there are; equal keys are compared word by word."""
        order = places[np.argsort(keys[places], kind="stable")]
        fresh = np.ones(len(order), bool)
        fresh[1:] = keys[order[1:]] != keys[order[:-1]]
        for j in range(size):
            fresh[1:] |= self.words[order[1:] + j] != self.words[order[:-1] + j]
        fresh[1:] |= self.lang[order[1:]] != self.lang[order[:-1]]
        starts = np.flatnonzero(fresh)
        return order[starts], np.diff(np.append(starts, len(order)))


def _marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = (keys >> np.uint64(DROPPED)) & np.uint64(64 * len(table) - 1)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def _flushes(batches, params: Params):
    """(flush, doc_ids) over Arrow batches of (doc_id, text, lang)."""
    texts, langs, ids, size = [], [], [], 0
    for batch in batches:
        for doc, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
            words = pieces_and_words(text or "")
            if texts and size + len(words) > params.flush:
                yield Flush(texts, langs), ids
                texts, langs, ids, size = [], [], [], 0
            texts.append(words)
            langs.append(lang)
            ids.append(doc)
            size += len(words)
    if texts:
        yield Flush(texts, langs), ids


def candidate_runs(flush: Flush, below: tuple[int, np.ndarray] | None, sizes: tuple[int, ...]):
    """(keys, places) of each size: runs whose parts are all marked. below: size of the parts and their table."""
    for size in sizes:
        keys, whole = flush.fingerprints(size)
        if below:
            part, table = below
            parts, ok = flush.fingerprints(part)
            ok &= _marked(table, parts)
            for j in range(size - part + 1):
                whole = whole & ok[j:j + len(whole)]
        yield keys, np.flatnonzero(whole)


def _capped(n: np.ndarray) -> np.ndarray:
    return np.minimum(n, 255).astype(np.uint8)


def _packed(held: list[tuple[np.ndarray, np.ndarray]], ranges: int) -> pa.RecordBatch:
    """(range, block) rows: first key, differences by byte plane, and counts up to 255 of the keys of each range."""
    keys, n = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    keys, n = keys[at], _capped(np.add.reduceat(n, at, dtype=np.int64))
    width = np.uint64(64 - DROPPED - ranges.bit_length() + 1)
    place = (keys >> width).astype(np.int32)
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    steps = np.diff(keys, prepend=keys[:1]).astype(np.uint32)
    blocks = []
    for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
        own = steps[begin:end].copy()
        own[0] = 0
        blocks.append(keys[begin].tobytes() + np.uint32(end - begin).tobytes() + PACKER.compress(
            own.view(np.uint8).reshape(-1, 4).T.tobytes() + n[begin:end].tobytes(), asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(place[starts]), pa.array(blocks, pa.binary())], names=["place", "block"])


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int(np.frombuffer(block, np.uint32, 1, 8)[0])
    plain = PACKER.decompress(block[12:], 5 * size)
    planes = np.frombuffer(plain, np.uint8, 4 * size).reshape(4, size)
    steps = np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.uint64)
    return np.frombuffer(block, np.uint64, 1) + np.cumsum(steps), np.frombuffer(plain, np.uint8, size, 4 * size)


def frequent_keys(rows: DataFrame, shared, sizes: tuple[int, ...], ranges: int, params: Params) -> DataFrame:
    """Upper bits of fingerprints of runs of these sizes that occur often enough, with those that rare phrases share."""
    def run(batches):
        held, waiting = [], 0
        for flush, _ in _flushes(batches, params):
            for keys, places in candidate_runs(flush, shared.value, sizes):
                if len(places):
                    found, n = np.unique(keys[places] >> np.uint64(DROPPED), return_counts=True)
                    held.append((found, _capped(n)))
                    waiting += len(found)
            if waiting >= params.gathered:
                yield _packed(held, ranges)
                held, waiting = [], 0
        if held:
            yield _packed(held, ranges)

    def added(group: pa.Table) -> pa.Table:
        keys, n = (np.concatenate(x) for x in zip(*map(_unpacked, group.column("block").to_pylist())))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order].astype(np.int64)
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return pa.table({"key": pa.array(keys[at][np.add.reduceat(n, at) >= params.least].astype(np.int64))})

    return map_batches(rows, run, "place int, block binary").groupBy("place").applyInArrow(added, "key long")


def bit_table(keys: DataFrame, bits: int) -> np.ndarray:
    """Bits set at the keys; the driver gets at most ``bits / 64`` numbers, whatever the keys."""
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    found = (keys.groupBy(F.shiftright(place, 6).alias("at"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("set")).toArrow())
    table = np.zeros(bits // 64, np.int64)
    table[found.column("at").to_numpy()] = found.column("set").to_numpy()
    return table.view(np.uint64)


def counted_phrases(documents: DataFrame, params: Params = Params()) -> DataFrame:
    """(lang, size, phrase, n, doc_id, place) of every frequent run of up to ``longest`` words; size 0 is the count
    of all words of a language. doc_id and place point to an occurrence: the word with that number in the text."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG))
    rows = documents.select("doc_id", "text", lang.alias("lang"))
    context, tables = documents.sparkSession.sparkContext, []
    nbytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    ranges = max(RANGES, 1 << (int(nbytes) // params.spread).bit_length())
    for sizes in [(1,), (2,), tuple(range(3, params.longest + 1))]:
        below = context.broadcast((len(tables), tables[-1]) if tables else None)
        found = frequent_keys(rows, below, sizes, ranges, params)
        tables.append(bit_table(found, params.bits))
    shared = context.broadcast(tables)
    kind = documents.schema["doc_id"].dataType.simpleString()
    fields = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()),
                        ("doc_id", to_arrow_type(documents.schema["doc_id"].dataType)), ("place", pa.int64())])

    def run(batches):
        held, waiting = [], 0
        for flush, ids in _flushes(batches, params):
            held.append(pa.table(_pointed(flush, ids, shared.value, ranges, params), fields))
            waiting += len(held[-1])
            if waiting >= params.gathered_phrases:
                held = [_added(held)]
                if 2 * len(held[0]) >= params.gathered_phrases:
                    yield _blocks(held.pop())
                waiting = sum(map(len, held))
        if held:
            yield _blocks(_added(held))

    def whole(group: pa.Table) -> pa.Table:
        place = group.column("place")[0].as_py()
        table = _added([_rows(place, block, fields) for block in group.column("block").to_pylist()])
        total = pc.equal(table["phrase"], "")
        table = table.filter(pc.or_(pc.greater_equal(table["n"], params.least), total))
        size = pc.if_else(pc.equal(table["phrase"], ""), 0, pc.add(pc.count_substring(table["phrase"], " "), 1))
        return table.append_column("size", size.cast(pa.int32())).select(["lang", "size", "phrase", "n", "doc_id", "place"])

    return map_batches(rows, run, "place int, block binary").groupBy("place").applyInArrow(
        whole, f"lang string, size int, phrase string, n long, doc_id {kind}, place long")


def _pointed(flush: Flush, ids: list, tables: list[np.ndarray], ranges: int, params: Params) -> dict[str, list]:
    """Marked phrases of a flush with their number and a pointer, and the number of words of each language with no phrase."""
    number = np.cumsum(flush.words != 0) - 1
    first = number[flush.begins] + (flush.words[flush.begins] == 0)
    totals = np.bincount(flush.lang, flush.words != 0)
    langs = list(dict.fromkeys(flush.langs))
    out = {"range": [0] * len(langs), "lang": list(langs), "phrase": [""] * len(langs),
           "n": [int(n) for n in totals], "doc_id": [None] * len(langs), "place": [None] * len(langs)}
    for size in range(1, params.longest + 1):
        keys, whole = flush.fingerprints(size)
        at, n = flush.phrases(size, keys, np.flatnonzero(whole & _marked(tables[min(size, len(tables)) - 1], keys)))
        doc = flush.doc[at]
        out["range"] += (keys[at] >> np.uint64(65 - ranges.bit_length())).tolist()
        out["n"] += n.tolist()
        out["place"] += (number[at] - first[doc]).tolist()
        for d, begin in zip(doc.tolist(), (at - flush.begins[doc]).tolist()):
            out["phrase"].append(b" ".join(flush.texts[d][begin:begin + size]).decode())
            out["lang"].append(flush.langs[d])
            out["doc_id"].append(ids[d])
    return out


def _added(tables: list[pa.Table]) -> pa.Table:
    """One row per language and text: counts added up, the first pointer kept."""
    names = tables[0].schema.names
    return (pa.concat_tables(tables).group_by(["range", "lang", "phrase"], use_threads=False)
            .aggregate([("n", "sum"), ("doc_id", "first"), ("place", "first")])
            .rename_columns(["range", "lang", "phrase", "n", "doc_id", "place"]).select(names))


def _written(column: pa.Array) -> bytes:
    """Whole numbers and texts as byte planes of numbers or lengths after the nulls, and the texts; others as Arrow writes them."""
    missing = column.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
    if pa.types.is_integer(column.type):
        return missing + column.fill_null(0).cast(pa.int64()).to_numpy().view(np.uint8).reshape(-1, 8).T.tobytes()
    if pa.types.is_string(column.type):
        column = column.fill_null("")
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
        text = column.buffers()[2][int(ends[0]):int(ends[-1])].to_pybytes() if ends[-1] > ends[0] else b""
        return missing + np.diff(ends).view(np.uint8).reshape(-1, 4).T.tobytes() + text
    return pa.record_batch([column], ["x"]).serialize().to_pybytes()


def _read(plain: pa.Buffer, kind: pa.DataType, rows: int) -> pa.Array:
    """The column that ``_written`` made bytes."""
    if not (pa.types.is_integer(kind) or pa.types.is_string(kind)):
        return pa.ipc.read_record_batch(plain, pa.schema([("x", kind)])).column(0)
    missing = np.frombuffer(plain, np.uint8, rows).astype(bool)
    width = 8 if pa.types.is_integer(kind) else 4
    planes = np.frombuffer(plain, np.uint8, width * rows, rows).reshape(width, rows)
    numbers = np.ascontiguousarray(planes.T).view(f"i{width}").ravel()
    if pa.types.is_integer(kind):
        return pa.array(numbers, mask=missing).cast(kind)
    ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(numbers, dtype=np.int32)])
    texts = pa.StringArray.from_buffers(rows, pa.py_buffer(ends), plain.slice((width + 1) * rows))
    return pc.if_else(pa.array(~missing), texts, None) if missing.any() else texts


def _blocks(table: pa.Table) -> pa.RecordBatch:
    """(range, block) rows: the rows of each range of fingerprints, sorted by text; each column is compressed by itself."""
    table = table.sort_by([(n, "ascending") for n in ("range", "lang", "phrase")]).combine_chunks()
    place = table["range"].to_numpy()
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    columns = [table[name].chunk(0) for name in table.schema.names[1:]]
    del table
    blocks = []
    for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(place)]):
        plain = [_written(column.slice(begin, end - begin)) for column in columns]
        packed = [PACKER.compress(x, asbytes=True) for x in plain]
        sizes = [end - begin, *map(len, plain), *map(len, packed)]
        blocks.append(np.array(sizes, np.int64).tobytes() + b"".join(packed))
    pa.default_memory_pool().release_unused()
    return pa.RecordBatch.from_arrays([pa.array(place[starts]), pa.array(blocks, pa.binary())], names=["place", "block"])


def _rows(place: int, block: bytes, fields: pa.Schema) -> pa.Table:
    """The rows of a block of the range ``place``."""
    own = list(fields)[1:]
    rows, *sizes = np.frombuffer(block, np.int64, 1 + 2 * len(own)).tolist()
    at, columns = 8 * (1 + 2 * len(own)), [pa.array(np.full(rows, place, np.int32))]
    for field, plain, packed in zip(own, sizes, sizes[len(own):]):
        columns.append(_read(PACKER.decompress(block[at:at + packed], plain), field.type, rows))
        at += packed
    return pa.table(columns, fields)


def _part(start: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", start, size), " ")


def _words(text: str) -> Column:
    """How many words a phrase has; blanks stand between words only."""
    return F.length(text) - F.length(F.replace(F.col(text), F.lit(" "), F.lit(""))) + 1


def scored(counted: DataFrame, params: Params = Params()) -> DataFrame:
    """(lang, phrase, a, l, r, n, score, size) of phrases of two words or more that no longer one covers.

    The lowest cut counts, of equal ones the one after fewer words.
    """
    totals = counted.filter("size = 0").select("lang", F.col("n").alias("total"))
    runs = counted.filter("size > 0").select("lang", "phrase", "n")
    phrases = counted.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    # A cut carries its two parts only; they hold the phrase, its size and the place of the cut.
    cuts = cuts.select("lang", "a", _part(F.lit(1), F.col("k")).alias("left"),
                       _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = (cuts.join(runs.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
            .join(runs.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]))
    cuts = cuts.select("lang", F.concat_ws(" ", "left", "right").alias("phrase"), "a", "l", "r", _words("left").alias("k"))
    value = F.expr(f"cast({params.scale} as decimal(38,0)) * cast(a as decimal(38,0)) "
                   "div (cast(l as decimal(38,0)) + cast(r as decimal(38,0)))")
    best = (cuts.groupBy("lang", "phrase").agg(F.min(F.struct(value.alias("score"), "k", "l", "r", "a")).alias("cut"))
            .select("lang", "phrase", "cut.*", _words("phrase").alias("size")))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("size") - size + 1), lambda at: F.array_join(F.slice("words", at, size), " "))))
    longer = (phrases.filter("size > 2").select("lang", "a", F.explode(inner).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    covers = (F.coalesce("longer", F.lit(0)).cast("decimal(38,0)") * 100
              >= F.col("a").cast("decimal(38,0)") * params.covered)
    return (best.join(longer, ["lang", "phrase"], "left").filter(~covers).join(totals, "lang")
            .select("lang", "phrase", "a", "l", "r", F.col("total").alias("n"), "score", "size"))


def top(phrases: DataFrame, params: Params = Params()) -> DataFrame:
    """The first phrases of each language by score, then a (both falling), then phrase by its bytes, with ``rank``."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = phrases.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    some = some.filter(F.col("rank") <= params.top).drop("salt", "rank")
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
            .filter(F.col("rank") <= params.top))


def collocations(documents: DataFrame, params: Params = Params()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, doc_id, place) of the first phrases of each language."""
    counted = materialize(counted_phrases(documents, params), "phrases")
    best = top(scored(counted, params), params)
    where = counted.filter("size > 1").select("lang", "phrase", "doc_id", "place")
    return best.join(where, ["lang", "phrase"]).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score", "doc_id", "place")
