"""Ranks over a whole result, at any size.

A window without PARTITION BY sorts all rows in one task. `with_global_ranks`
instead writes the rows once. The keys of all ranks are then stacked into one table,
sorted over all tasks and written, each with its place within its task. Within a
rank, adding the sizes of the tasks before it gives the rank. All rank tables are made
from that one table and joined to the rows by key at the end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revq.session import materialise

# Column name and direction, "asc" or "desc". NULLs come first ascending, last descending.
Order = Sequence[tuple[str, str]]


def _stacked(rows: DataFrame, orders: Mapping[str, Order]) -> tuple[DataFrame, dict[str, list[str]]]:
    """The distinct keys of all ranks, sorted and written, and the columns of each rank's keys.

    The key at one position has a column per type and direction; a rank fills one of
    them and leaves the others null, which does not change its order.
    """
    types = {field.name: field.dataType for field in rows.schema}
    slots: dict[tuple[int, str, str], str] = {}
    keys: dict[str, list[str]] = {}
    for out, order in orders.items():
        for i, (name, way) in enumerate(order):
            slot = slots.setdefault((i, types[name].simpleString(), way), f"_key{len(slots)}")
            keys.setdefault(out, []).append(slot)
    stacked = []
    for number, (out, order) in enumerate(orders.items()):
        own = dict(zip(keys[out], order))
        columns = [
            (F.col(own[slot][0]) if slot in own else F.lit(None).cast(kind)).alias(slot)
            for (_, kind, _), slot in slots.items()
        ]
        stacked.append(F.struct(F.lit(number).alias("_rank"), *columns))
    by_position = sorted(slots, key=lambda key: key[0])
    sort = [F.col(slots[key]).desc() if key[2] == "desc" else F.col(slots[key]).asc() for key in by_position]
    # An id is the number of the task times 2^33, plus the place in the task's sorted
    # rows. Both are written with the rows, so a task that runs again changes nothing.
    placed = (
        rows.select(F.explode(F.array(*stacked)).alias("_s")).select("_s.*").distinct()
        .orderBy("_rank", *sort)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    return materialise(placed), keys


def _places(placed: DataFrame, number: int, keys: list[str], out: str) -> DataFrame:
    """The keys of one rank with `out` = 1, 2, 3, ... in its order."""
    task, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    own = placed.where(F.col("_rank") == number).select(*keys, task.alias("_task"), place.alias("_place"))
    # One row per task of the sort, hence small enough for one task.
    sizes = own.groupBy("_task").agg(F.count(F.lit(1)).alias("_size"), F.min("_place").alias("_first"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_task", "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return own.join(starts, "_task").select(
        *keys, (F.col("_start") + F.col("_place") - F.col("_first") + 1).alias(out)
    )


def _tile(place: Column, rows: int, tiles: int) -> Column:
    """NTILE from a row's place: the first (rows mod tiles) tiles hold one row more."""
    size, wide = divmod(rows, tiles)
    in_wide = wide * (size + 1)
    return F.when(place <= in_wide, F.floor((place - 1) / (size + 1)) + 1).otherwise(
        wide + F.floor((place - 1 - in_wide) / F.lit(max(size, 1))) + 1
    )


def with_global_ranks(
    df: DataFrame,
    dense: Mapping[str, Order] | None = None,
    tiles: Mapping[str, tuple[int, Order]] | None = None,
    numbers: Mapping[str, Order] | None = None,
) -> DataFrame:
    """Add dense ranks, n-tiles and row numbers that span all rows.

    Orders given to `tiles` and `numbers` must be total: their columns tell any
    two rows apart. The added columns are BIGINT. Two tables are written, however many
    ranks there are.
    """
    rows = materialise(df)
    orders = {**(dense or {}), **(numbers or {}), **{out: order for out, (_, order) in (tiles or {}).items()}}
    placed, keys = _stacked(rows, orders)
    total = rows.count() if tiles else 0
    for number, (out, order) in enumerate(orders.items()):
        table = _places(placed, number, keys[out], out)
        if out in (tiles or {}):
            table = table.withColumn(out, _tile(F.col(out), total, tiles[out][0]).cast("bigint"))
        same = F.lit(True)
        for (name, _), key in zip(order, keys[out]):
            same = same & F.col(name).eqNullSafe(F.col(key))
        rows = rows.join(table, same).drop(*keys[out])
    return rows
