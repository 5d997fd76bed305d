"""Find keys that several blocks of documents hold, without a row per key.

A block is a bounded set of whole documents that one task holds in memory. To learn
which of its keys (hashes) other blocks hold too, each block sends its *distinct*
keys to buckets, packed as bytes: a key that a third of all documents hold is one
entry per block. A bucket gathers the keys of its hash range from all blocks and
answers each block with those of its keys that pass the rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE = "block long, bucket long, keys binary"
ANSWER = "block long, bucket long, keys binary"
BLOCK_BYTES = 2 << 20
LEAST_BUCKETS = 128


def block_count(docs: DataFrame, column: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of about `block_bytes` of text for the whole table; one pass, one row."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return int(total // block_bytes) + 1


def bucket_count(blocks: int) -> int:
    return max(LEAST_BUCKETS, blocks // 2)


def range_block(docs: DataFrame, key: str, blocks: int) -> Column:
    """The block of a row, from 0; blocks are ranges of `key`, so they have its order.

    The bounds are quantiles (one number per block). A row finds its range by
    bisection. Rows without a key go to the block of their text's hash.
    """
    shares = [i / blocks for i in range(1, blocks)]
    bounds = docs.agg(F.percentile_approx(key, shares, 20 * blocks)).first()[0] if shares else None
    elsewhere = F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("long")
    if not bounds:
        return F.when(F.col(key).isNull(), elsewhere).otherwise(F.lit(0).cast("long"))
    bounds = sorted(set(bounds))
    array = "array(" + ",".join(f"{b}L" for b in bounds) + ")"
    steps = len(bounds).bit_length()
    found = F.expr(
        f"aggregate(sequence(1, {steps}), 0, (low, s) -> "
        f"if(low + shiftleft(1, {steps} - s) <= {len(bounds)} "
        f"and try_element_at({array}, low + shiftleft(1, {steps} - s)) <= `{key}`, "
        f"low + shiftleft(1, {steps} - s), low))"
    )
    return F.when(F.col(key).isNull(), elsewhere).otherwise(found.cast("long"))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(40)) % np.uint64(buckets)


def messages(block: int, hashes: np.ndarray, buckets: int, bits: int = 64) -> pa.Table:
    """Distinct `hashes` of a block, packed per bucket with their last `bits` bits."""
    hashes = np.unique(hashes)
    bucket = bucket_of(hashes, buckets)
    order = np.argsort(bucket, kind="stable")
    keys = hashes[order].astype(np.uint64 if bits == 64 else np.uint32)
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    used = np.flatnonzero(np.diff(cuts))
    return packed(
        np.full(len(used), block, np.int64), used, [keys[cuts[b] : cuts[b + 1]] for b in used]
    )


def packed(block: np.ndarray, bucket: np.ndarray, keys: list[np.ndarray]) -> pa.Table:
    return pa.table(
        {
            "block": pa.array(block, pa.int64()),
            "bucket": pa.array(bucket, pa.int64()),
            "keys": pa.array([k.tobytes() for k in keys], pa.binary()),
        }
    )


def unpacked(table: pa.Table, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a table of messages, and the row each came from."""
    parts = [np.frombuffer(x, np.uint64 if bits == 64 else np.uint32) for x in table["keys"].to_pylist()]
    row = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), row


def answers(sent: DataFrame, bits: int, lower_only: bool = False) -> DataFrame:
    """Per block, its keys that another block (`lower_only`: a block before it) holds as well."""

    def meet(table: pa.Table) -> pa.Table:
        keys, row = unpacked(table, bits)
        block = table["block"].to_numpy()[row]
        order = np.lexsort((block, keys))
        keys, row = keys[order], row[order]
        same = keys[1:] == keys[:-1]
        hit = np.concatenate([[False], same])
        if not lower_only:
            hit |= np.concatenate([same, [False]])
        keys, row = keys[hit], row[hit]
        order = np.argsort(row, kind="stable")
        keys, row = keys[order], row[order]
        used, first = np.unique(row, return_index=True)
        return packed(
            table["block"].to_numpy()[used], table["bucket"].to_numpy()[used],
            np.split(keys, first[1:]) if len(used) else [],
        )

    return sent.groupBy("bucket").applyInArrow(meet, ANSWER)


def known(hashes: np.ndarray, answer: pa.Table, buckets: int, bits: int = 64) -> np.ndarray:
    """Which of a block's `hashes` its answer names."""
    keys, row = unpacked(answer, bits)
    if bits == 64:
        return np.isin(hashes, keys)
    bucket = answer["bucket"].to_numpy().astype(np.uint64)[row]
    whole = bucket << np.uint64(32) | keys.astype(np.uint64)
    mine = bucket_of(hashes, buckets) << np.uint64(32) | hashes.astype(np.uint32).astype(np.uint64)
    return np.isin(mine, whole)


def per_block(docs: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Apply `work(table)` to the documents of each block."""
    return docs.groupBy("block").applyInArrow(work, schema)


def with_answers(docs: DataFrame, answer: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Apply `work(documents, answer)` to each block that holds documents."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left, right)

    return docs.groupBy("block").cogroup(answer.groupBy("block")).applyInArrow(meet, schema)


Batches = Iterator[pa.RecordBatch]
