"""Which of many words texts hold: one pass over the texts for any bank up to some millions of words.

A pass walks the prefixes of all words at once, over the bytes of many texts: from each place it goes on, byte by byte, as long as what it has read may begin a word. Prefixes are hashed
into a table of a few bytes each, so that millions of words fit beside each task; what may be a word is looked up and compared byte by byte. Distinct words are dealt
by hash to parts of at most ``PART_BYTES``, and only a part, whose size has been summed before, is sent to the tasks; each worker builds its table once. Texts stay where they are:
``held`` moves nothing but words. What was found meets the rows of a bank (``matches``) by a broadcast of up to ``SENT_BYTES`` of them; beyond that finds are shuffled with the columns
that are still needed.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.staging import stage

PART_BYTES, SENT_BYTES = 192 << 20, 192 << 20
#: Bytes at which a walk begins (if all words are as long) and ends (longer words are then looked up whole); bytes of texts that are looked at together, and places that are walked from together.
FIRST, LONG, TEXT_BYTES, PLACES = 6, 64, 4 << 20, 1 << 19
_MIX, _SPREAD, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), b"\xff"  # no text in UTF-8 holds that byte


def parts(words: DataFrame, word: str, most: int = PART_BYTES) -> list[DataFrame]:
    """``words``, staged, in parts of at most ``most`` bytes, cut by a hash of whole rows; a part that comes out larger is cut again, a single row is a part."""
    columns = words.columns
    size = F.lit(16)
    for c in columns:
        size = size + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    rows = stage(words.where(F.coalesce(F.col(word), F.lit("")) != "").withColumns({"_size": size.cast("long"), "_row": F.monotonically_increasing_id()}), "words")
    out, todo = [], [(rows, 0)]
    while todo:
        part, depth = todo.pop()
        total, n = part.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count("*")).first()
        if total <= most or n <= 1:
            out += [part.drop("_size", "_row")] * bool(n)
            continue
        ways = max(2, math.ceil(1.25 * total / most))
        todo += [(part.where(F.pmod(F.xxhash64("_row", F.lit(depth)), F.lit(ways)) == k), depth + 1) for k in range(ways)]
    return out


def _longer(h: np.ndarray, byte: np.ndarray | np.uint64) -> np.ndarray:
    """Hashes of what is one byte longer."""
    h = (h ^ byte) * _MIX
    h ^= h >> np.uint64(32)
    return h


def _begun(read: list[np.ndarray]) -> np.ndarray:
    """Hashes of the first bytes, at most eight."""
    h = read[0].astype(np.uint64)
    for byte in read[1:]:
        h <<= np.uint64(8)
        h |= byte
    return _longer(h, np.uint64(0))


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """In order; ``np.unique`` hashes first, which takes longer."""
    numbers.sort()
    return numbers[np.append(True, numbers[1:] != numbers[:-1])] if len(numbers) else numbers


def _bounds(words: pa.Array) -> np.ndarray:
    return np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]


class Words:
    """Distinct words, none of them empty, and where they are in texts."""

    def __init__(self, words: pa.LargeStringArray) -> None:
        size = np.diff(_bounds(words))
        self.words = words if (size[1:] >= size[:-1]).all() else words.take(pa.array(np.argsort(size, kind="stable")))  # by size
        bounds, self.data = _bounds(self.words), np.frombuffer(self.words.buffers()[2], np.uint8)
        self.size, self.at = np.diff(bounds), bounds[:-1]
        read = np.minimum(self.size, LONG)
        self.first, self.last = int(min(read[0], FIRST)), int(read[-1])
        begin = np.searchsorted(read, np.arange(self.last + 2))  # the first word of each length
        slots = int((read - self.first + 1).sum())  # more than there are prefixes, as words share them
        bits = max(10, (slots - 1).bit_length())
        self.shift, self.table, self.known = np.uint64(64 - bits), np.zeros(1 << bits, np.uint8), {}
        h = _begun([self.data[self.at + n] for n in range(self.first)])
        for n in range(self.first, self.last + 1):
            if n > self.first:
                h = _longer(h[begin[n] - begin[n - 1] :], self.data[self.at[begin[n] :] + (n - 1)])
            slot, bit = self._slots(h)
            ends = begin[n + 1] - begin[n]
            bit[:ends] |= bit[:ends] << np.uint8(4)
            for value in np.unique(bit):
                self.table[slot[bit == value]] |= value
            if n == LONG:
                ends = np.searchsorted(self.size, LONG, "right") - begin[n]
            if ends:
                by = np.argsort(h[:ends])
                keys = h[:ends][by]
                self.known[n] = (keys, (begin[n] + by).astype(np.int32), bool((keys[1:] == keys[:-1]).any()))

        longer = int(np.searchsorted(self.size, LONG, "right"))
        self.whole = {w.encode(): longer + k for k, w in enumerate(self.words[longer:].to_pylist())}
        self.sizes: dict[bytes, list[int]] = {}
        for start, size in sorted({(w[:LONG], len(w)) for w in self.whole}):
            self.sizes.setdefault(start, []).append(size)

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table, and the bits there that say that a prefix is known; the bit four to the left says that it is a word."""
        x = h * _SPREAD
        return (x >> self.shift).astype(np.int64), np.uint8(1) << ((x >> np.uint64(8)) & np.uint64(3)).astype(np.uint8)

    def _same(self, data: np.ndarray, place: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        same = np.ones(len(place), bool)
        for k in range(n):
            same &= data[place + k] == self.data[self.at[word] + k]
        return same

    def _longer_words(self, joined: bytes, places: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Words of more than ``LONG`` bytes, by their first ones and then whole, once for each size."""
        found = [(p, w) for p in places for size in self.sizes.get(joined[p : p + LONG], ()) if (w := self.whole.get(joined[p : p + size])) is not None]
        return np.array([p for p, _ in found], np.int64), np.array([w for _, w in found], np.int64)

    def _walk(self, joined: bytes, data: np.ndarray, start: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places from ``start`` on, and the words there."""
        place, h = np.arange(start, stop), _begun([data[start + n : stop + n] for n in range(self.first)])
        for n in range(self.first, self.last + 1):
            if n > self.first:
                h = _longer(h, data[place + (n - 1)])
            slot, bit = self._slots(h)
            told = self.table[slot]
            may = np.flatnonzero(told & (bit << np.uint8(4)))
            if n == LONG and len(may) and self.whole:
                yield self._longer_words(joined, place[may].tolist())
            if n in self.known and len(may):
                keys, words, twice = self.known[n]
                sought, at = h[may], place[may]
                low = np.searchsorted(keys, sought)
                many = (np.searchsorted(keys, sought, "right") if twice else low + (keys[np.minimum(low, len(keys) - 1)] == sought)) - low
                at, word = np.repeat(at, many), words[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
                same = self._same(data, at, word, n)
                yield at[same], word[same]
            on = np.flatnonzero(told & bit)
            if not len(on):
                return
            place, h = place[on], h[on]

    def find(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of texts, in order, and of ``words`` that they hold, each pair once."""
        joined = _END.join(t or b"" for t in texts)
        data = np.frombuffer(joined + _END * (self.last + 1), np.uint8)
        ends, n, out = np.cumsum([len(t or b"") + 1 for t in texts]), len(self.size), [np.zeros(0, np.int64)]
        for start in range(0, len(joined), PLACES):
            out += [_distinct(np.searchsorted(ends, place, "right") * n + word) for place, word in self._walk(joined, data, start, min(start + PLACES, len(joined)))]
        return np.divmod(_distinct(np.concatenate(out)), n)


#: What this Python worker built last, by the name of its part.
_BUILT: dict[str, Words] = {}


def _built(name: str, sent: Broadcast) -> Words:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Words(sent.value)
    return _BUILT[name]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Rows whose texts have ``TEXT_BYTES`` together, or one row."""
    texts = batch.column(column).cast(pa.large_binary()).to_pylist()
    start, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t or b"") > TEXT_BYTES:
            yield batch.slice(start, k - start), texts[start:k]
            start, size = k, 0
        size += len(t or b"")
    yield batch.slice(start), texts[start:]


def _held(texts: DataFrame, text: str, words: DataFrame, found: str, out: list[str]) -> DataFrame:
    """The columns ``out`` of those rows of ``texts`` that hold any word, with the distinct ones that they hold."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = T.StructType([*(texts.schema[c] for c in out), T.StructField(found, T.ArrayType(T.StringType()))])
    schema, at = to_arrow_schema(shape), texts.columns.index(text)
    bank = words.orderBy(F.octet_length(words.columns[0])).toArrow().column(0).cast(pa.large_string()).combine_chunks()  # at most the bytes of a part
    sent, name = texts.sparkSession.sparkContext.broadcast(bank), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bank = _built(name, sent)
        for batch in batches:
            for rows, said in _slices(batch, at):
                row, word = bank.find(said)
                if not len(row):
                    continue
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), bank.words.take(pa.array(word)).cast(schema.field(found).type.value_type))
                kept = rows.take(pa.array(row[first]))
                yield pa.RecordBatch.from_arrays([*(kept.column(c).cast(schema.field(c).type) for c in out), lists.cast(schema.field(found).type)], schema=schema)

    return texts.mapInArrow(run, shape)


def held(texts: DataFrame, text: str, words: DataFrame, word: str, most: int = PART_BYTES) -> DataFrame | None:
    """The other columns of ``texts`` with each distinct ``word`` that ``text`` holds; None if there are no words. Nothing is shuffled but the words."""
    out = [c for c in texts.columns if c != text]
    found = [_held(texts, text, part, "_held", out).select(*out, F.explode("_held").alias(word)) for part in parts(words.select(word).distinct(), word, most)]
    return reduce(DataFrame.unionByName, found) if found else None


def matches(texts: DataFrame, text: str, words: DataFrame, word: str, most: int = PART_BYTES, also: Column | None = None) -> DataFrame | None:
    """The pairs of a text and a row of ``words`` whose ``word`` the text holds, and for which ``also`` is true; None if there are no words.

    Null texts hold nothing; null and empty words are in no text. The columns of both tables must have different names.
    """
    rows = stage(words.where(F.coalesce(F.col(word), F.lit("")) != ""), "bank")
    size = sum((16 + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in rows.columns), F.lit(0))
    out, cut = None, parts(rows.select(word).distinct(), word, most)
    for part in cut:
        own = rows.join(part, word, "left_semi") if len(cut) > 1 else rows
        few = own.agg(F.sum(size)).first()[0] <= SENT_BYTES
        met = _held(texts, text, part, "_held", texts.columns).withColumn(word, F.explode("_held")).drop("_held").join(F.broadcast(own) if few else own, word)
        met = met if also is None else met.where(also)
        out = met if out is None else out.unionByName(met)
    return out
