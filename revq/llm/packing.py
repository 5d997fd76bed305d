"""Variable-capacity best-fit packing of documents into training sequences.

Documents are measured in words. A document longer than the largest permitted length
is cut into pieces: whole largest sequences and a rest. Pieces are dealt into groups by
a hash; a task packs one group at a time, largest pieces first. Each piece goes to the
open bin with the least room that still holds it. If none does, a bin is opened at
the length whose cost per word is least, where a bin counts as holding no more than what
is still to be packed. So all lengths are weighed against each other for every new bin,
and the last bins of a group are small. In the end each bin shrinks to the smallest
permitted length that holds its contents.

Only ids and sizes are moved. A group holds about `group_words` words, so that there
are as many groups as the table needs; bins of different groups are not shared, which
leaves at most a few bins per group less than full. Rows are counted before they are
dealt out and copies get numbers, so a document repeated very often is spread.

Documents without words (null or empty text) have one piece of size 0 in no bin (null).
Rows with a null doc_id are packed like others. Every repeated row is packed. An empty
table gives an empty result. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revq.llm.mixing import word_count
from revq.session import materialise

LENGTHS = (512, 1024, 2048, 4096, 8192)
GROUP_WORDS = 1_000_000

RESULT = (
    "doc_id long, copy long, piece long, first_word long, size long, bin_group long, bin_number long, "
    "bin_length long, position long"
)


def sequence_cost(length: int) -> float:
    """Work per sequence in words: a fixed share, its length, and attention, which grows with its square."""
    return 64 + length + length**2 / 16384


def best_fit(
    sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = sequence_cost
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, position in the bin, and final bin length of each piece.

    Sizes are positive, in descending order, and at most the largest length.
    Open bins are kept by the room left in them; the rooms in use are bits of one
    number, so the least room that suffices is its lowest bit after a shift.
    """
    lengths = sorted(lengths)
    costs = [cost(c) for c in lengths]
    left = int(sum(sizes))
    by_room: dict[int, list[int]] = {}
    rooms, used, holds = 0, [], []
    bins, positions = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(map(int, sizes)):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            price, room = min((p / min(c, left), c) for p, c in zip(costs, lengths) if c >= size)
            number = len(used)
            used.append(0)
            holds.append(room)
        bins[i], positions[i] = number, used[number]
        used[number] += size
        room -= size
        left -= size
        if room:
            by_room.setdefault(room, []).append(number)
            rooms |= 1 << room
    final = np.array(lengths)[np.searchsorted(lengths, used)] if used else np.empty(0, np.int64)
    return bins, positions, final[bins]


def pack(
    docs: DataFrame,
    lengths: Sequence[int] = LENGTHS,
    cost: Callable[[int], float] = sequence_cost,
    group_words: int = GROUP_WORDS,
) -> DataFrame:
    """One row per piece of each row: where it lies in its document, and in which bin."""
    most = max(lengths)
    sizes = materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("words"))
        .groupBy("doc_id", "words")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    total = sizes.agg(F.sum(F.col("words") * F.col("rows"))).first()[0] or 0
    groups = int(total // group_words) + 1
    rows = sizes.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    pieces = rows.withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("words") / most) - 1, F.lit(0))))
    ).select(
        "doc_id", "copy", "piece",
        (F.col("piece") * most).alias("first_word"),
        F.least(F.lit(most), F.col("words") - F.col("piece") * most).alias("size"),
        F.pmod(F.xxhash64("doc_id", "words", "copy", "piece"), F.lit(groups)).cast("long").alias("bin_group"),
    )
    nowhere = pieces.where("size = 0").withColumns(
        {name: F.lit(None).cast("long") for name in ("bin_group", "bin_number", "bin_length", "position")}
    )

    def fill(table: pa.Table) -> pa.Table:
        order = [("size", "descending"), ("doc_id", "ascending"), ("copy", "ascending"), ("piece", "ascending")]
        table = table.sort_by(order)
        bins, positions, final = best_fit(table["size"].to_numpy(), lengths, cost)
        for name, values in (("bin_number", bins), ("bin_length", final), ("position", positions)):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    names = [part.split()[0] for part in RESULT.split(", ")]
    filled = pieces.where("size > 0").groupBy("bin_group").applyInArrow(
        lambda table: fill(table).select(names), RESULT
    )
    return filled.unionByName(nowhere.select(names))
