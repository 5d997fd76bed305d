"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of consecutive words with smallest period q (words q apart are
equal) that no neighbouring word extends, of at least max(24, 3 q) words.

Level k splits a text into blocks of m = 2^k words. A run with a period in [m, 2m) is
at least 3m long, so the first block that lies in it is followed, q words later, by a
copy of itself inside the run. Hence each block asks for its occurrences that start in
the neighbouring window [i + m, i + 2m):

* the suffix array (sorted by prefix doubling, whose classes are the blocks' ranges)
  holds all occurrences of a block side by side;
* a wavelet matrix over it counts those in the window and gives the range successor;
* occurrences that lie so close form an arithmetic progression. One or two give their
  distances as candidate periods. With three or more the block itself repeats with the
  progression's difference d, and q is the distance between the left or the right ends
  of the stretches of period d around the block and around its occurrence.

Each candidate is verified by extending it word by word. A block asks only if each of
its words comes again within 2m words, which the run demands; texts without such a
block, that is nearly all, are done after that test.

Words are compared by 64-bit hashes. A null or empty text has no words and no runs.
Rows are independent, so repeated rows give repeated results; an empty table gives an
empty result. Other columns than doc_id and text are not looked at. A text is held
whole by one task, with about 60 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from revq.llm.tokens import Words, find_words, mixed, slices

LEAST_WORDS = 24
LEAST_EXPONENT = 3
RUNS = "array<struct<start long, length long, period long>>"

Run = tuple[int, int, int]  # first word, words, period


class SuffixArray:
    """Suffixes of a sequence, sorted by their first 2^levels words.

    `ranges(k)` gives, for each start of a block of 2^k words, the range of `order`
    that holds all occurrences of the block.
    """

    def __init__(self, codes: np.ndarray, levels: int):
        n = len(codes)
        self.order = np.argsort(codes, kind="stable")
        in_order = codes[self.order]
        fresh = np.ones(n, bool)
        fresh[1:] = in_order[1:] != in_order[:-1]
        self._ranges: list[tuple[np.ndarray, np.ndarray]] = []
        # The rank of a suffix is the first place of its class in `order`.
        rank = np.empty(n, np.int64)
        width = 1
        for level in range(levels + 1):
            first = np.flatnonzero(fresh)
            place = np.cumsum(fresh) - 1
            rank[self.order] = first[place]
            size = np.diff(np.append(first, n))
            starts = np.arange(0, n - width + 1, width)
            low = rank[starts]
            self._ranges.append((low, low + size[place[low]]))
            if level == levels:
                break
            # Only classes of several suffixes are sorted further, each in its own place.
            open_places = np.flatnonzero(size[place] > 1)
            suffix = self.order[open_places]
            beyond = suffix + width
            second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)], -1)
            own = rank[suffix]
            by = np.lexsort((second, own))
            self.order[open_places] = suffix[by]
            own, second = own[by], second[by]
            differs = np.ones(len(by), bool)
            differs[1:] = (own[1:] != own[:-1]) | (second[1:] != second[:-1])
            fresh[open_places] = differs
            width *= 2

    def ranges(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        return self._ranges[level]


class WaveletMatrix:
    """Counts and order statistics over ranges of a sequence of numbers below its length."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.bits = max(1, int(n).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for bit in reversed(range(self.bits)):
            one = (values >> bit & 1).astype(bool)
            padded = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
            padded[:n] = one
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(n - int(one.sum()))
            values = np.concatenate([values[~one], values[one]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` bits of a level are set."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        inside = self.words[level][word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[level][word] + np.bitwise_count(inside)

    def count_below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many numbers in [low, high) are less than `value`, which is at most the length."""
        total = np.zeros(len(low), np.int64)
        for level in range(self.bits):
            one = (value >> (self.bits - 1 - level) & 1).astype(bool)
            low_ones, high_ones = self._ones(level, low), self._ones(level, high)
            total += np.where(one, (high - high_ones) - (low - low_ones), 0)
            zeros = self.zeros[level]
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return total

    def nth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest number, from 0, in [low, high)."""
        value = np.zeros(len(low), np.int64)
        for level in range(self.bits):
            low_ones, high_ones = self._ones(level, low), self._ones(level, high)
            zeros_here = (high - high_ones) - (low - low_ones)
            one = k >= zeros_here
            k = np.where(one, k - zeros_here, k)
            zeros = self.zeros[level]
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
            value = value << 1 | one
        return value


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common prefix."""
    n, done, step = min(len(a), len(b)), 0, 32
    while done < n:
        differ = np.flatnonzero(a[done : min(done + step, n)] != b[done : min(done + step, n)])
        if len(differ):
            return done + int(differ[0])
        done, step = min(done + step, n), step * 2
    return n


def _stretch(codes: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The longest stretch of a period around [at, at + period)."""
    right = _agreeing(codes[at:], codes[at + period :])
    left = _agreeing(codes[:at][::-1], codes[period : at + period][::-1])
    return at - left, at + period + right


def _prime_divisors(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return found + [n] * (n > 1)


def _is_smallest(codes: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch of two periods or more has no smaller period that divides this one."""
    return all(
        not np.array_equal(codes[start : start + period], codes[start + period // p : start + period + period // p])
        for p in _prime_divisors(period)
    )


def _next_distance(keys: np.ndarray) -> np.ndarray:
    """How many places on each key comes again; a large number where it does not."""
    order = np.argsort(keys, kind="stable")
    distance = np.full(len(keys), np.iinfo(np.int64).max)
    again = keys[order[1:]] == keys[order[:-1]]
    distance[order[:-1][again]] = np.diff(order)[again]
    return distance


def _asking(distance: np.ndarray, level: int) -> np.ndarray:
    """Starts of the blocks all of whose words come again within two block lengths."""
    m = 1 << level
    near = np.concatenate([[0], np.cumsum(distance < 2 * m)])
    starts = np.arange(0, len(distance) - m + 1, m)
    return starts[near[starts + m] - near[starts] == m]


def runs_in(codes: np.ndarray, longest: int) -> list[Run]:
    """All runs of a sequence of numbers from 0, whose parts of at most `longest` share no run."""
    n = len(codes)
    levels = max(longest // LEAST_EXPONENT, 1).bit_length() - 1
    distance = _next_distance(codes)
    asking = [_asking(distance, level) for level in range(levels + 1)]
    deepest = max((k for k, blocks in enumerate(asking) if len(blocks)), default=-1)
    if deepest < 0:
        return []
    suffixes = SuffixArray(codes, deepest)
    matrix = WaveletMatrix(suffixes.order)
    candidates: set[tuple[int, int]] = set()
    for level in range(deepest + 1):
        m, blocks = 1 << level, asking[level]
        if not len(blocks):
            continue
        low, high = (x[blocks >> level] for x in suffixes.ranges(level))
        below = matrix.count_below(low, high, np.minimum(blocks + m, n))
        count = matrix.count_below(low, high, np.minimum(blocks + 2 * m, n)) - below
        found = count > 0
        blocks, low, high, below, count = blocks[found], low[found], high[found], below[found], count[found]
        first = matrix.nth(low, high, below)
        several = count > 1
        second = first.copy()
        second[several] = matrix.nth(low[several], high[several], below[several] + 1)
        few = count <= 2
        candidates |= _likely(codes, np.concatenate([blocks[few]] * 2), np.concatenate([first[few], second[few]]))
        around: dict[int, tuple[int, int]] = {}
        for i, j, d in zip(*(x[~few].tolist() for x in (blocks, first, second - first))):
            a, b = around.get(d, (0, 0))
            if not a <= i < b:
                a, b = around[d] = _stretch(codes, i, d)
            if not a <= j < b:
                c, e = _stretch(codes, j, d)
                candidates |= {(i, p) for p in {c - a, e - b} if m <= p < 2 * m}
    runs: set[Run] = set()
    seen: dict[int, int] = {}
    for i, period in sorted(candidates):
        if i + period <= seen.get(period, 0):  # inside the stretch of this period that was found last
            continue
        start, end = _stretch(codes, i, period)
        seen[period] = end
        long_enough = end - start >= max(LEAST_WORDS, LEAST_EXPONENT * period)
        if long_enough and _is_smallest(codes, start, period):
            runs.add((start, end - start, period))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _likely(codes: np.ndarray, block: np.ndarray, copy: np.ndarray) -> set[tuple[int, int]]:
    """(block, period) where the words one and two periods on agree as they must in a run."""
    period = copy - block
    fits = block + 2 * period < len(codes)
    block, period = block[fits], period[fits]
    fits = codes[block + period] == codes[block + 2 * period]
    fits &= codes[block + period - 1] == codes[block + 2 * period - 1]
    return set(zip(block[fits].tolist(), period[fits].tolist()))


def _runs_of_texts(words: Words) -> dict[int, list[Run]]:
    """The runs of each text that has any."""
    if not len(words.doc):
        return {}
    keys = mixed(words.hashes() ^ mixed(words.doc.astype(np.uint64)))
    distance = _next_distance(keys)
    may = np.zeros(len(words.count), bool)
    for level in range(max(int(words.count.max()) // LEAST_EXPONENT, 1).bit_length()):
        may[words.doc[_asking(distance, level)]] = True
    may &= words.count >= LEAST_WORDS
    found = {}
    # The texts are laid end to end, with a word of its own after each.
    texts = np.flatnonzero(may)
    if len(texts):
        after = np.zeros(1, np.uint64)
        parts = [x for i in texts.tolist() for x in (keys[words.first[i] : words.first[i + 1]], after)]
        ends = np.cumsum(words.count[texts] + 1)
        start = np.concatenate([[0], ends[:-1]])
        _, codes = np.unique(np.concatenate(parts), return_inverse=True)
        codes[ends - 1] = len(codes) + np.arange(len(texts))
        for first, length, period in runs_in(codes, int(words.count[texts].max())):
            at = int(np.searchsorted(start, first, side="right")) - 1
            found.setdefault(int(texts[at]), []).append((first - int(start[at]), length, period))
    return found


def _collapsed(text: bytes, runs: list[Run]) -> bytes:
    """The words but for those that a run holds after its first period, joined by a space."""
    words = text.split()  # at the same six blanks
    if runs:
        edges = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edges[start + period] += 1
            edges[start + length] -= 1
        words = [w for w, inside in zip(words, np.cumsum(edges[:-1]) > 0) if not inside]
    return b" ".join(words)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs by start and period, and the text with each run collapsed to one period."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
        for batch in batches:
            for part in slices(batch):
                words = find_words(part["text"])
                found = _runs_of_texts(words)
                runs = [found.get(i, []) for i in range(part.num_rows)]
                listed = [[dict(zip(("start", "length", "period"), r)) for r in of] for of in runs]
                collapsed = [_collapsed(words.text(i), of).decode() for i, of in enumerate(runs)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part["doc_id"],
                        "n_words": pa.array(words.count, pa.int64()),
                        "runs": pa.array(listed, pa.list_(struct)),
                        "collapsed": pa.array(collapsed, pa.string()),
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string"
    )
