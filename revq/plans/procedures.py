"""The two procedures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revq.functions.numeric import rnd
from revq.plans.measures import avg_discount, totals
from revq.schema import MONTHLY_SUMMARY, STG_ORDERS
from revq.sources.versions import VersionedTable

# Per month, what an order table holds: two sums of row hashes, in which the order of rows does not count.
DIGESTS = T.StructType(
    [T.StructField("month_start", T.DateType()), T.StructField("n_rows", T.LongType())]
    + [T.StructField(name, T.DecimalType(38, 0)) for name in ("digest", "other_digest")]
)


def monthly_summary(orders: DataFrame) -> DataFrame:
    """Revenue, units and simple mean discount per month, as stored."""
    keys = ["year", "month", "month_start"]
    sums = totals(orders, keys, "revenue", "units", "discount_sum", "discount_rows")
    return sums.select(
        *keys,
        F.col("revenue").cast("decimal(14,2)").alias("total_revenue"),
        F.col("units").alias("total_units"),
        rnd(avg_discount(), 2).cast("decimal(6,2)").alias("avg_discount"),
    )


def _summary_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, MONTHLY_SUMMARY, "year")


def read_monthly_summary(spark: SparkSession, path: str) -> DataFrame:
    """The stored summary as of now."""
    return _summary_table(spark, path).read()


def refresh_monthly_summary(
    orders: DataFrame, path: str, years: Sequence[int] | None = None
) -> DataFrame:
    """Write a new version of the summary table at `path` and return it.

    Without `years` the whole table is replaced. With `years` only the rows of these
    years are: their orders are recomputed, and a year whose orders are all gone loses
    its rows. Readers see the version before until the new one is whole, and a job that
    fails at any step leaves the table as it was.
    """
    table = _summary_table(orders.sparkSession, path)
    if years is None:
        table.replace(monthly_summary(orders).repartition("year"))
        return table.read()
    first, last = f"{min(years)}-01-01", f"{max(years)}-12-31"
    # On the stored order table the second filter skips the folders of other years.
    orders = orders.where(F.col("order_date").between(first, last))
    orders = orders.where(F.col("month_start").between(first, last) & F.col("year").isin(*years))
    # At most twelve rows per year: one file per folder.
    table.replace_partitions(monthly_summary(orders).repartition("year"), years)
    return table.read()


def month_digests(orders: DataFrame) -> DataFrame:
    """Rows and digests per month: any inserted, deleted or changed order changes its month's."""
    names = ["state_name" if name == "state" else name for name in STG_ORDERS.names]
    hashes = [F.sum(F.xxhash64(*salt, *names).cast("decimal(38,0)")) for salt in ([], [F.lit(1)])]
    return orders.groupBy("month_start").agg(
        F.count(F.lit(1)).alias("n_rows"), hashes[0].alias("digest"), hashes[1].alias("other_digest")
    )


def refresh_changed_months(orders: DataFrame, path: str) -> tuple[DataFrame, list]:
    """Recompute the months whose orders have changed since the last call; return the table and these months.

    The digests of the last call lie beside the summary. The summary is published
    first: a job that dies before the digests are makes the next call repeat these months.
    """
    spark = orders.sparkSession
    table, stored = _summary_table(spark, path), VersionedTable(spark, f"{path.rstrip('/')}_digests", DIGESTS)
    before_version, summary_before = stored.version(), table.read()
    digests = month_digests(orders)
    before = stored.read(before_version).withColumnsRenamed({n: f"{n}_before" for n in DIGESTS.names[1:]})
    unlike = [~F.col(n).eqNullSafe(F.col(f"{n}_before")) for n in DIGESTS.names[1:]]
    differs = digests.join(before, "month_start", "full").where(unlike[0] | unlike[1] | unlike[2])
    # One short row per month that has changed.
    months = sorted(r.month_start for r in differs.select("month_start").collect())
    if months:
        years = sorted({month.year for month in months})
        anew = monthly_summary(orders.where(F.col("month_start").isin(*months)))
        rest = summary_before.where(F.col("year").isin(*years) & ~F.col("month_start").isin(*months))
        kinds = [F.col(f.name).cast(f.dataType).alias(f.name) for f in MONTHLY_SUMMARY]
        table.replace_partitions(anew.select(kinds).unionByName(rest).repartition("year"), years)
        stored.replace(digests.coalesce(1))
    return table.read(), months


def state_performance(orders: DataFrame, state: str) -> DataFrame:
    """Months of one state; the filter reaches the scan of the order table."""
    keys = ["state_name", "year", "month_name", "month_start"]
    chosen = orders.where(F.col("state_name") == state)
    sums = totals(chosen, keys, "revenue", "units", "discount_sum", "discount_rows")
    return sums.select(
        *keys, "revenue", "units", rnd(avg_discount(), 2).alias("avg_discount")
    ).orderBy("month_start")
