"""Sums per group, and what is read off them.

A report groups the orders once, into exact decimal sums; averages, shares and
ratios are computed from the sums of its few result rows. The group keys are
strings and dates and the sums are fixed-width, so Spark aggregates by hash,
first inside each scanning task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revq.functions.numeric import ratio

_MONEY = "decimal(20,2)"


def _times_units(price: Column) -> Column:
    return (price * F.col("units_sold")).cast(_MONEY)


SUMS = {
    "revenue": lambda: F.sum("revenue"),
    "units": lambda: F.sum("units_sold"),
    "weighted_discount": lambda: F.sum(F.col("discount_percent") * F.col("units_sold")),
    "gross": lambda: F.sum(_times_units(F.col("base_price"))),
    "net": lambda: F.sum(_times_units(F.col("final_price"))),
    "discount_sum": lambda: F.sum("discount_percent"),
    "discount_rows": lambda: F.count("discount_percent"),
    "transactions": lambda: F.count_distinct("order_id"),
}


def totals(orders: DataFrame | Cells, keys: list[str], *sums: str) -> DataFrame:
    if isinstance(orders, Cells):
        return orders.totals(keys, sums)
    return orders.groupBy(*keys).agg(*[SUMS[name]().alias(name) for name in sums])


def with_group(orders: DataFrame | Cells, name: str, group: Callable[[Column], Column]) -> DataFrame | Cells:
    """Orders with a grouping of their discounts; cells are stored by it."""
    return orders if isinstance(orders, Cells) else orders.withColumn(name, group(F.col("discount_percent")))


@dataclass(frozen=True)
class Cells:
    """Orders summed to the finest grain that the reports need (`cells.py`); reports take them instead of orders.

    sums: one row per cell. distinct: bitmaps of numbered orders, by a coarser grain, or
    None where a filter has left them behind.
    """

    sums: DataFrame
    distinct: DataFrame | None

    def where(self, condition: Column) -> Cells:
        """The cells that fulfil a condition; orders can no longer be counted among them."""
        return Cells(self.sums.where(condition), None)

    def totals(self, keys: list[str], names: Sequence[str]) -> DataFrame:
        kinds = {n: F.lit(0).cast("bigint") if n == "transactions" else F.col(n) for n in names}
        rows = self.sums.select(*keys, *[kind.alias(n) for n, kind in kinds.items()])
        types = {field.name: field.dataType for field in rows.schema}
        if "transactions" in names:
            if self.distinct is None or not set(keys) <= set(self.distinct.columns):
                raise ValueError(f"orders are not counted by {keys} in these cells")
            merged = self.distinct.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
            counts = {n: F.lit(None).cast(types[n]) for n in names} | {"transactions": F.bitmap_count("bits")}
            rows = rows.unionByName(merged.select(*keys, *[c.alias(n) for n, c in counts.items()]))
        # A sum of sums is exact in the type of the first.
        return rows.groupBy(*keys).agg(*[F.sum(n).cast(types[n]).alias(n) for n in names])


def one_zone_per_state(grouped: DataFrame) -> DataFrame:
    """Replace zone by the last zone name seen for the state.

    `grouped` is already aggregated by state and zone, so a state's window holds
    its report rows and no orders.
    """
    return grouped.withColumn("zone", F.max("zone").over(Window.partitionBy("state_name")))


# Read off the sums of a group.


def avg_discount() -> Column:
    return ratio(F.col("discount_sum"), F.col("discount_rows"))


def weighted_discount() -> Column:
    return ratio(F.col("weighted_discount"), F.col("units"))


def weighted_price() -> Column:
    return ratio(F.col("net"), F.col("units"))


def realization() -> Column:
    return ratio(F.col("net"), F.col("gross"))


def revenue_per_unit() -> Column:
    return ratio(F.col("revenue"), F.col("units"))


def revenue_per_order() -> Column:
    return ratio(F.col("revenue"), F.col("transactions"))


def discount_cost() -> Column:
    """Both sums are exact, so their difference is the sum of the differences."""
    return F.col("gross") - F.col("net")


def discount_cost_ratio() -> Column:
    return ratio(discount_cost(), F.col("revenue"))
