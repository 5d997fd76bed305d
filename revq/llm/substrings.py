"""Substring dedup with difference-cover anchors.

A window of 13 consecutive words goes where the same words also start in a document
with a smaller id. Hashing every window of every document would shuffle a row per
word. Instead:

1. Each block of documents sends the distinct hashes of its *anchors*: windows of 7
   words that begin at word positions 1, 2 or 4 modulo 7. These positions form a
   difference cover: for any two positions i and j some d < 7 puts both i + d and
   j + d on the cover. Hence two equal windows of 13 words, wherever they lie, hold
   an equal anchor at the same place inside them.
2. An anchor that another block holds as well extends to the up to seven windows
   around it. Only the hashes of those windows are sent.
3. Blocks are ranges of doc_id. A window that a block before holds too goes; equal
   windows inside one block are settled in that block.

Anchors are compared by 32 bits and their bucket, as a wrong match costs only the
sending of a window; windows are compared by 64 bits.

Rows with a null text have no words. Rows with a null doc_id neither lose words nor
make others lose any. Rows with the same doc_id do not make each other lose words.
An empty table gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revq.llm import blocks as B
from revq.llm.tokens import Words, find_words

PERIOD = 7
COVER = (1, 2, 4)

RESULT = "doc_id long, n_words long, n_removed long, kept string"


def _anchors(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the anchors on the cover."""
    keys, at = words.windows(hashes, size - PERIOD + 1)
    on_cover = np.isin(words.place[at] % PERIOD, COVER)
    return keys[on_cover], at[on_cover]


def _sorted_by_id(docs: pa.Table) -> pa.Table:
    return docs.sort_by([("doc_id", "ascending")])


def remove_repeats(docs: DataFrame, size: int = 13, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Per document: its words, how many of them went, and the kept ones joined by a space."""
    if size < 2 * PERIOD - 1:
        raise ValueError(f"windows have at least {2 * PERIOD - 1} words")
    count = B.block_count(docs, block_bytes=block_bytes)
    buckets = B.bucket_count(count)
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        B.range_block(docs, "doc_id", count).alias("block"),
    )

    def taking_part(docs: pa.Table) -> pa.Table:
        return docs.filter(docs["doc_id"].is_valid())

    def send_anchors(docs: pa.Table) -> pa.Table:
        words = find_words(taking_part(docs)["text"])
        keys, _ = _anchors(words, words.hashes(), size)
        return B.messages(docs["block"][0].as_py(), keys, buckets, bits=32)

    def send_windows(docs: pa.Table, shared: pa.Table) -> pa.Table:
        words = find_words(taking_part(docs)["text"])
        hashes = words.hashes()
        anchors, place = _anchors(words, hashes, size)
        hits = np.zeros(len(hashes) + 1, np.int64)
        hits[place[B.known(anchors, shared, buckets, bits=32)] + 1] = 1
        hits = np.cumsum(hits)
        keys, at = words.windows(hashes, size)
        return B.messages(docs["block"][0].as_py(), keys[hits[at + PERIOD] > hits[at]], buckets)

    def cut(docs: pa.Table, before: pa.Table) -> pa.Table:
        docs = _sorted_by_id(docs)
        words = find_words(docs["text"])
        ids = docs["doc_id"].to_pandas().to_numpy()
        keys, at = words.windows(words.hashes(), size)
        here = np.asarray(docs["doc_id"].is_valid())[words.doc[at]]
        keys, at = keys[here], at[here]
        gone = B.known(keys, before, buckets)
        # Rows are in order of doc_id, so the first of equal keys has the smallest.
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        gone |= ids[words.doc[at]] > ids[words.doc[at[first[which]]]]
        edges = np.zeros(len(words.doc) + 1, np.int64)
        np.add.at(edges, at[gone], 1)
        np.add.at(edges, at[gone] + size, -1)
        keep = np.cumsum(edges[:-1]) == 0
        kept = np.diff(np.concatenate([[0], np.cumsum(keep)])[words.first])
        texts = [
            b" ".join(itertools.compress(words.text(i).split(), keep[a:b])).decode()
            for i, (a, b) in enumerate(itertools.pairwise(words.first))
        ]
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "n_words": pa.array(words.count, pa.int64()),
                "n_removed": pa.array(words.count - kept, pa.int64()),
                "kept": pa.array(texts, pa.string()),
            }
        )

    shared = B.answers(B.per_block(placed, send_anchors, B.MESSAGE), bits=32)
    windows = B.with_answers(placed, shared, send_windows, B.MESSAGE)
    before = B.answers(windows, bits=64, lower_only=True)
    return B.with_answers(placed, before, cut, RESULT)
