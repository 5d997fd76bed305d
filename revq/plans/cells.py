"""Orders summed once per load, into one stored table that the reports roll up.

A cell is a month and one value of every column that a report groups by. Its row holds
exact sums, which add up to those of any coarser grouping. Distinct orders do not add
up, so they are kept as bitmaps: each order id has a number for good, and a bitmap row
holds, for a month, category, event and band, which of 32,768 successive numbers occur.
Bitmaps of any cells are merged with OR, so counts stay exact without the orders.

Ids are numbered in the order of the cell they are first seen in. So the orders of a
cell lie side by side, and the bitmaps have about one bit per order; only orders with
lines in several cells add thin ones, which compress to little.

    path/cells      the sums and bitmaps, one folder per month, versioned as one table
    path/numbers    order id -> number; ids are only ever added

`adhoc`, `views` and `procedures` take `read(...)` in place of orders, save where they need
single days or rows: festival_lift, festival_lift_and_discount, revenue_loss_by_band.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revq.functions.labels import incentive_group, sensitivity_group
from revq.plans.measures import Cells, totals, with_group
from revq.session import materialise
from revq.sources.versions import VersionedTable

COUNTED_BY = ["month_start", "category", "sales_event", "discount_band"]
KEYS = [
    *COUNTED_BY, "state_name", "zone", "brand_type", "competition_intensity", "inventory_pressure",
    "customer_age_group", "discount_group", "sensitivity_group",
]
# Types of the sums as Spark gives them over the order columns.
SUMS = {
    "revenue": T.DecimalType(22, 2),
    "units": T.LongType(),
    "weighted_discount": T.DecimalType(26, 2),
    "gross": T.DecimalType(30, 2),
    "net": T.DecimalType(30, 2),
    "discount_sum": T.DecimalType(15, 2),
    "discount_rows": T.LongType(),
}
BITMAP = {"bucket": T.LongType(), "bits": T.BinaryType()}
KINDS = {key: T.DateType() if key == "month_start" else T.StringType() for key in KEYS} | SUMS | BITMAP
# Columns of orders that are read.
COLUMNS = [
    "order_id", *[key for key in KEYS if key not in ("discount_group", "sensitivity_group")],
    "discount_percent", "units_sold", "base_price", "final_price", "revenue",
]
SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in KINDS.items()])
NUMBERS = T.StructType([T.StructField("order_id", T.StringType()), T.StructField("number", T.LongType())])
BITS = 32768


def _tables(spark: SparkSession, path: str) -> tuple[VersionedTable, VersionedTable]:
    path = path.rstrip("/")
    return (
        VersionedTable(spark, f"{path}/cells", SCHEMA, "month_start"),
        VersionedTable(spark, f"{path}/numbers", NUMBERS),
    )


def _cell_numbers(orders: DataFrame) -> DataFrame:
    """(*COUNTED_BY, cell): a number for each cell that occurs, in their order; few rows, written."""
    found = orders.select(*COUNTED_BY).distinct().orderBy(*COUNTED_BY)
    return materialise(found.withColumn("cell", F.monotonically_increasing_id()))


def _number_new(seen: DataFrame, numbers: VersionedTable) -> DataFrame:
    """Give numbers to the ids that have none; return (number, cells) of all ids in `seen`.

    Of two loads that number at once, the second raises `Conflict`: it can be run again.
    """
    base = numbers.version()
    known = numbers.read(base)
    highest = known.agg(F.max("number")).first()[0] or 0
    # Numbers start at 1, and those of a load at a bitmap of their own.
    start = -(-highest // BITS) * BITS + 1
    if base:
        seen = materialise(seen.join(known, "order_id", "left"))
        old, fresh = seen.where("number IS NOT NULL"), seen.where("number IS NULL").drop("number")
    else:
        fresh = seen = materialise(seen)
    first = F.col("cells")[0]
    placed = fresh.repartitionByRange(first, "order_id").sortWithinPartitions(first, "order_id")
    # Written before it is used twice: a task that runs again may number otherwise.
    numbered = materialise(placed.withColumn("number", F.monotonically_increasing_id() + start))
    numbers.append(numbered.select("order_id", "number"), base=base)
    columns = ["number", "cells"]
    return numbered.select(columns).unionAll(old.select(columns)) if base else numbered.select(columns)


def _bitmaps(orders: DataFrame, numbers: VersionedTable) -> DataFrame:
    """Which orders there are, per cell of COUNTED_BY; an order without an id counts for none.

    An id travels with the numbers of its cells, and is numbered where they are. What is
    then shuffled are numbers, each to the one task that makes its bitmap: bitmaps made
    before the shuffle would be as many as there are of them in each task, nearly empty.
    """
    orders = orders.dropna(subset=["order_id"])
    cells = _cell_numbers(orders)
    named = cells.withColumnsRenamed({key: f"_{key}" for key in COUNTED_BY})
    same = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in COUNTED_BY])
    ids = orders.select("order_id", *COUNTED_BY).join(named, same).select("order_id", "cell")
    seen = ids.groupBy("order_id").agg(F.sort_array(F.collect_set("cell")).alias("cells"))
    placed = _number_new(seen, numbers).select(F.explode("cells").alias("cell"), "number")
    bitmaps = (
        placed.withColumn("bucket", F.bitmap_bucket_number("number"))
        .repartition("cell", "bucket")
        .groupBy("cell", "bucket")
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    )
    return bitmaps.join(cells, "cell").select(*COUNTED_BY, "bucket", "bits")


def _rows(df: DataFrame) -> DataFrame:
    """Rows in the schema of the table, NULL where they have no such column."""
    return df.select(
        [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA]
    )


def refresh(orders: DataFrame, path: str, months: Sequence[datetime.date] | None = None) -> Cells:
    """Store the cells of `orders`, of all months or of the given ones, and return the stored cells.

    Given months are replaced: all their orders must be in `orders`, and one without any
    loses its cells. Months not given are not read. Readers see the cells before until the
    new ones are whole. The orders are scanned three times: for the sums, the cells and the order ids.
    """
    table, numbers = _tables(orders.sparkSession, path)
    if months is not None:
        orders = orders.where(F.col("month_start").isin(*months))
    grouped = with_group(orders, "discount_group", sensitivity_group)
    grouped = with_group(grouped, "sensitivity_group", incentive_group)
    rows = _rows(totals(grouped, KEYS, *SUMS)).unionByName(_rows(_bitmaps(orders, numbers)))
    # Rebalancing writes a small month as one file and splits a large one.
    rows = rows.hint("rebalance", "month_start")
    if months is None:
        table.replace(rows)
    else:
        table.replace_partitions(rows, months)
    return read(orders.sparkSession, path)


def read(spark: SparkSession, path: str) -> Cells:
    """The stored cells as of now, with the parts of their month."""
    month = F.col("month_start")
    rows = _tables(spark, path)[0].read().withColumns(
        {"year": F.year(month), "month": F.month(month), "month_name": F.date_format(month, "MMM")}
    )
    parts = ["year", "month", "month_name"]
    return Cells(
        rows.where("bucket IS NULL").select(*KEYS, *parts, *SUMS),
        rows.where("bucket IS NOT NULL").select(*COUNTED_BY, *parts, *BITMAP),
    )
