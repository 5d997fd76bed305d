"""Counts over the texts, or the lines, of a text column."""

from __future__ import annotations

import numpy as np

from revq.llm.tokens import Words, mixed, span_hashes

SYMBOLS = "#*$%&|<>"
COUNTS = (
    "chars", "words", "word_chars", "upper", "lower", "digits", "bangs", "symbols", "bars", "points",
    "repeats", "echoes",
)


def _mark(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in characters]] = True
    return table


_UPPER, _LOWER = _mark("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mark("abcdefghijklmnopqrstuvwxyz")
_DIGIT, _SYMBOL, _POINT, _BLANK = _mark("0123456789"), _mark(SYMBOLS), _mark(".,;:?"), _mark(" \t\n\x0b\x0c\r")


def line_bounds(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (before the \\n) and text of every line; an empty text is one empty line."""
    breaks = np.flatnonzero(words.data == 10)
    start = np.sort(np.concatenate([words.offsets[:-1], breaks + 1]), kind="stable")
    # A break at the end of a text opens an empty last line, which starts where the next text does.
    doc_of_break = np.searchsorted(words.offsets, breaks, side="right") - 1
    doc = np.sort(np.concatenate([np.arange(len(words.offsets) - 1), doc_of_break]), kind="stable")
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    end = np.empty(len(start), np.int64)
    end[~last] = start[1:][~last[:-1]] - 1
    end[last] = words.offsets[1:][doc[last]]
    return start, end, doc


def counts(words: Words, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """Counts per span of bytes; spans are in order and hold whole words.

    `repeats` are words seen earlier in the span, `echoes` those equal to the word before.
    Letters are told upper from lower in ASCII and Latin-1.
    """
    data = words.data

    def total(mark: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mark)])
        return sums[end] - sums[start]

    upper, lower = _UPPER[data], _LOWER[data]
    accented = np.zeros(len(data), bool)
    accented[1:] = data[:-1] == 0xC3
    upper |= accented & (data >= 0x80) & (data <= 0x9E)
    lower |= accented & (data >= 0xA0) & (data <= 0xBE)
    chars = total((data & 0xC0) != 0x80)
    # A span that starts where the one before ends is empty, so the last start before a word is its span.
    span = np.searchsorted(start, words.start, side="right") - 1
    n = np.bincount(span, minlength=len(start))
    keys = mixed(hashes ^ mixed(span.astype(np.uint64)))
    distinct = np.zeros(len(keys), bool)
    distinct[np.unique(keys, return_index=True)[1]] = True
    echo = np.zeros(len(keys), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (span[1:] == span[:-1])
    return {
        "chars": chars,
        "words": n,
        "word_chars": chars - total(_BLANK[data]),
        "upper": total(upper),
        "lower": total(lower),
        "digits": total(_DIGIT[data]),
        "bangs": total(data == ord("!")),
        "symbols": total(_SYMBOL[data]),
        "bars": total(data == ord("|")),
        "points": total(_POINT[data]),
        "repeats": np.bincount(span[~distinct], minlength=len(start)),
        "echoes": np.bincount(span[echo], minlength=len(start)),
    }


def ratios(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sizes and shares from `counts`; shares of nothing are 0."""
    words, chars = np.maximum(c["words"], 1), np.maximum(c["word_chars"], 1)
    letters = np.maximum(c["upper"] + c["lower"], 1)
    return {
        "log_words": np.log1p(c["words"]),
        "word_length": c["word_chars"] / words,
        "upper": c["upper"] / letters,
        "digits": c["digits"] / chars,
        "bangs": c["bangs"] / words,
        "symbols": c["symbols"] / words,
        "bars": c["bars"] / words,
        "points": c["points"] / words,
        "repeats": c["repeats"] / words,
        "echoes": c["echoes"] / words,
    }


def repeated_lines(words: Words) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line."""
    start, end, doc = line_bounds(words)
    filled = np.searchsorted(words.start, start) < np.searchsorted(words.start, end)
    start, end, doc = start[filled], end[filled], doc[filled]
    keys = mixed(span_hashes(words.data, start, end) ^ mixed(doc.astype(np.uint64)))
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    return np.bincount(doc[again], minlength=len(words.count))


def repeated_words(words: Words, hashes: np.ndarray, size: int = 8) -> np.ndarray:
    """Per text, the words in windows of `size` words that occur twice or more in it."""
    keys, at = words.windows(hashes, size)
    keys = mixed(keys ^ mixed(words.doc[at].astype(np.uint64)))
    _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
    twice = at[count[which] > 1]
    edges = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + size, -1)
    return np.bincount(words.doc[np.cumsum(edges[:-1]) > 0], minlength=len(words.count))
