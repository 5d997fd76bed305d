"""Orders derived from the normalised sales tables (lineitem, orders, customer, ...).

The mapping is the one of FIXTURES.md section 4. Customer geography is joined to
the order headers before the line items are, so the widest table is shuffled
once per key and no more. No side carries a broadcast hint: Spark broadcasts
what it measures to be below the session's threshold, and at larger sizes
adaptive execution splits a hot key of the sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revq.schema import STG_ORDERS

# Columns read of each table; declared, so that no job is spent on inferring them.
COLUMNS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_brand string, p_type string",
}

PRODUCTS = (
    "p_partkey",
    """CASE p_type WHEN 'ECONOMY' THEN 'Electronics' WHEN 'LARGE' THEN 'Home & Living'
       WHEN 'MEDIUM' THEN 'Footwear' WHEN 'PROMO' THEN 'Premium Lifestyle'
       WHEN 'SMALL' THEN 'Grocery Essentials' ELSE 'Other' END AS category""",
    "if(cast(substr(p_brand, 7) AS int) % 4 = 0, 'Premium', 'Mass') AS brand_type",
)
BUYERS = (
    "c_custkey",
    "n_name AS state",
    "r_name AS zone",
    "if(c_custkey % 2 = 0, 'Female', 'Male') AS customer_gender",
    "cast(18 + c_custkey % 60 AS int) AS customer_age",
)
HEADERS = (
    "o_orderkey",
    "cast(o_orderdate AS date) AS order_date",
    "state",
    "zone",
    "customer_gender",
    "customer_age",
    """CASE WHEN o_orderpriority < '3' THEN 'High' WHEN o_orderpriority < '4' THEN 'Medium'
       ELSE 'Low' END AS competition_intensity""",
    """CASE o_orderstatus WHEN 'F' THEN 'High' WHEN 'P' THEN 'Medium'
       ELSE 'Low' END AS inventory_pressure""",
)
# Discount and tax are fractions of two digits: adding a half and cutting rounds them.
# Multiples of 1.25 are exact in double.
LINES = (
    "concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string)) AS order_id",
    "order_date",
    "state",
    "zone",
    "category",
    "brand_type",
    "customer_gender",
    "customer_age",
    "cast(l_extendedprice AS decimal(10,2)) AS base_price",
    """cast(cast(l_discount * 100 + 0.5D AS int) * 6
       + cast(l_tax * 100 + 0.5D AS int) * 1.25D AS decimal(5,2)) AS discount_percent""",
    "cast(l_quantity AS int) AS units_sold",
    "if(l_returnflag = 'R', 'Festival', 'Normal') AS sales_event",
    "competition_intensity",
    "inventory_pressure",
)
FINAL_PRICE = "cast(base_price * (100 - discount_percent) * 0.01BD AS decimal(10,2))"
REVENUE = "cast(final_price * units_sold AS decimal(12,2))"


def stg_orders(spark: SparkSession, folder: str) -> DataFrame:
    """One staging row per line item, from the parquet tables in `folder`."""

    def read(name: str) -> DataFrame:
        return spark.read.schema(COLUMNS[name]).parquet(f"{folder}/{name}.parquet")

    buyers = (
        read("customer")
        .join(read("nation"), F.expr("c_nationkey = n_nationkey"))
        .join(read("region"), F.expr("n_regionkey = r_regionkey"))
        .selectExpr(*BUYERS)
    )
    headers = read("orders").join(buyers, F.expr("o_custkey = c_custkey")).selectExpr(*HEADERS)
    products = read("part").selectExpr(*PRODUCTS)
    # Line items travel as they are stored; prices and ids are computed where they arrive.
    return (
        read("lineitem")
        .join(products, F.expr("l_partkey = p_partkey"))
        .join(headers, F.expr("l_orderkey = o_orderkey"))
        .selectExpr(*LINES)
        .withColumn("final_price", F.expr(FINAL_PRICE))
        .withColumn("revenue", F.expr(REVENUE))
        .select(STG_ORDERS.names)
    )
