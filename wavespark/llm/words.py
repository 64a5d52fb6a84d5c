"""Hashed words and arrays of them, for the operators that compare texts inside tasks (numpy)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import WORD

find_words = re.compile(WORD).findall
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hashes of words; the table is emptied when it is full, so a task's memory is bounded."""

    most = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def mix2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of an ordered pair."""
    return mix(mix(a + _GOLD) * np.uint64(3) + b)


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a sequence of hashes, as two signed longs."""
    d = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def portions(batch: pa.RecordBatch, text: str, most_rows: int = 1024, most_bytes: int = 1 << 25) -> Iterator[pa.RecordBatch]:
    """The batch in slices of so many rows and bytes of text at most (one row at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, "right"))
        stop = max(at + 1, min(stop, at + most_rows))
        yield batch.slice(at, stop - at)
        at = stop


def word_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The different words of some texts (null: none), split at ASCII white space; for each word of all texts in a row its
    place among them; and the places where the texts begin and end in that row."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    bounds, coded = lists.offsets.to_numpy(zero_copy_only=False), lists.flatten().dictionary_encode()
    return bounds - bounds[0], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def gather(parts: list[bytes], which: np.ndarray, bounds: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """What the words of ``word_table`` stand for (numbers of that kind) in a row, and where each text's ends in it."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // kind.itemsize
    pool, first = np.frombuffer(b"".join(parts), kind), np.cumsum(sizes) - sizes
    each = sizes[which]
    ends = np.concatenate(([0], np.cumsum(each)))
    return pool[np.repeat(first[which] - ends[:-1], each) + np.arange(ends[-1])], ends[bounds]
