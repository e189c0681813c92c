"""What several operators share: words, Arrow batches, hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is a stretch without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
# Stretches of words that are hashed at a time.
GRAMS = 1 << 14
# Bytes of texts that are split at a time.
SPLIT_BYTES = 4 << 20
# The white space that str.split knows beyond ASCII's.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_WORDS = re.compile(WORD)


def split_words(text: str) -> list[str]:
    """The words of a text; ``str.split`` where that means the same, as it is faster."""
    return _WORDS.findall(text) if _OTHER_SPACE.search(text) else text.split()


def words_column(text: Column) -> Column:
    """Words of a text column as an array; empty for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.filter(parts, lambda w: w != "")


class WordHashes(dict):
    """64-bit hash of every word, computed once; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class ByteHashes(WordHashes):
    """The same for words given as bytes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


LOWER = bytes(range(256)).lower()


def split_column(texts: pa.Array, fold: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of a column of texts one after another, and where each text's begin and end; null is empty.

    ``fold`` says what every byte of a text becomes before it is split at ASCII white space.
    """
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(1, np.int64)
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    folded = bytes(memoryview(data)[offsets[0] : offsets[-1]]).translate(fold) if data else b""
    offsets = (offsets - offsets[0]).astype(np.int32)
    texts = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(folded))
    split = pc.ascii_split_whitespace(texts)
    words, ends = split.flatten(), np.asarray(split.offsets) - split.offsets[0].as_py()
    full = np.asarray(pc.greater(pc.binary_length(words), 0))
    return words.filter(pa.array(full)), np.append(0, np.cumsum(full))[ends]


def hash_strings(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings without nulls, eight bytes of all of them at a time."""
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = (words.buffers()[2] or pa.py_buffer(b"")).to_pybytes() + bytes(8)
    # The eight bytes from every byte on.
    lanes = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    start, size = offsets[:-1], np.diff(offsets)
    hashes = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    active, at = np.flatnonzero(size), 0
    while len(active):
        left = size[active] - at
        value = lanes[start[active] + at]
        # Of the last bytes of a string those behind it don't count.
        value &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64))
        hashes[active] = mix(mix(hashes[active] ^ value) + np.uint64(0x9E3779B97F4A7C15))
        active, at = active[left > 8], at + 8
    return hashes


def hash_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after another, A-Z in lower case, and where each text's begin and end."""
    words, ends = split_column(texts, LOWER)
    return hash_strings(words), ends


def in_parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts in ``column`` have about ``SPLIT_BYTES``, or a single row."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    part = (np.cumsum(size) - size) // SPLIT_BYTES
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if a < b:
            yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every stretch of ``n`` words, from the hashes of the words."""
    out = np.empty(max(len(hashes) - n + 1, 0), np.uint64)
    # So many at a time as the processor's cache holds.
    for a in range(0, len(out), GRAMS):
        total = np.zeros(min(GRAMS, len(out) - a), np.uint64)
        for k in range(n):
            total = mix(total + np.uint64(0x9E3779B97F4A7C15))
            total += hashes[a + k : a + k + len(total)]
        out[a : a + len(total)] = mix(total)
    return out
