"""Words of Arrow text columns as numpy arrays: places, hashes and hashes of word windows.

A word is a longest run of characters other than the six ASCII blanks (0x20 and
0x09-0x0D). As UTF-8 uses these byte values for nothing else, words are found and
hashed on bytes. Hashes have 64 bits; equal words always have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# What Spark's SQL needs to find the same words.
BLANKS = r"[\x20\x09-\x0D]+"

def word_list(text: Column) -> Column:
    """The words of a text as an array; a null or blank text has none."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(bare) > 0, F.split(bare, BLANKS)).otherwise(F.array().cast("array<string>"))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PIECE = 1 << 20

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED_VALUE = _BYTE_VALUE.copy()
_FOLDED_VALUE[ord("A") : ord("Z") + 1] = _BYTE_VALUE[ord("a") : ord("z") + 1]

_powers: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values, after which all bits count alike."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_powers.get("up", ())):
        size = max(n, _PIECE) + 4096
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """A hash of the bytes of each span; spans are in order and do not overlap."""
    values = _FOLDED_VALUE if fold_case else _BYTE_VALUE
    out = np.empty(len(start), np.uint64)
    # Pieces bound the memory; a hash does not depend on where a piece begins.
    cuts = [0]
    while cuts[-1] < len(out):
        limit = start[cuts[-1]] + _PIECE
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(start, limit))))
    for a, b in zip(cuts, cuts[1:]):
        low, high = int(start[a]), int(end[b - 1])
        up, down = _power_tables(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * up[:-1], out=sums[1:])
        first, last = start[a:b] - low, end[a:b] - low
        out[a:b] = (sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)
    return mixed(out)


@dataclass
class Words:
    """The words of a text column, in order."""

    data: np.ndarray  # the bytes of all texts
    offsets: np.ndarray  # text i is data[offsets[i]:offsets[i + 1]]
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    doc: np.ndarray  # index of the text of each word

    def __post_init__(self):
        texts = len(self.offsets) - 1
        self.first = np.searchsorted(self.doc, np.arange(texts + 1))
        self.count = np.diff(self.first)
        self.place = np.arange(len(self.doc)) - self.first[self.doc]

    def hashes(self, fold_case: bool = False) -> np.ndarray:
        """A hash for each word; with `fold_case`, A-Z count as a-z."""
        return span_hashes(self.data, self.start, self.end, fold_case)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of `size` consecutive words of one text, and the index of the first word of each."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        acc = hashes[at].copy()
        for k in range(1, size):
            acc = acc * _BASE + hashes[at + k]
        return mixed(acc), at

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def find_words(column: pa.Array | pa.ChunkedArray) -> Words:
    """The words of a string column; a null text has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~_IS_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[True], ~inside[:-1]]) if len(data) else inside
    after = np.concatenate([~inside[1:], [True]]) if len(data) else inside
    start = np.flatnonzero(inside & (before | edge[:-1]))
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, offsets, start, end, doc)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, each of whole rows."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)
