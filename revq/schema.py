"""Declared schemas of the staging table, the star and the summary table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TEXT, INT, LONG, DATE = T.StringType(), T.IntegerType(), T.LongType(), T.DateType()
PRICE, PERCENT, REVENUE = T.DecimalType(10, 2), T.DecimalType(5, 2), T.DecimalType(12, 2)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


STG_ORDERS = _table(
    order_id=TEXT, order_date=DATE, state=TEXT, zone=TEXT, category=TEXT, brand_type=TEXT,
    customer_gender=TEXT, customer_age=INT, base_price=PRICE, discount_percent=PERCENT,
    final_price=PRICE, units_sold=INT, revenue=REVENUE, sales_event=TEXT,
    competition_intensity=TEXT, inventory_pressure=TEXT,
)
DIM_DATE = _table(
    date_id=INT, full_date=DATE, year=INT, month=INT, month_name=TEXT, quarter=INT, month_start=DATE
)
DIM_STATE = _table(state_id=INT, state_name=TEXT, zone=TEXT)
DIM_PRODUCT = _table(product_id=INT, category=TEXT, brand_type=TEXT)
DIM_CUSTOMER_DEMO = _table(
    customer_demo_id=INT, customer_gender=TEXT, customer_age=INT, customer_age_group=TEXT
)
DIM_EVENT = _table(event_id=INT, sales_event=TEXT)
FACT_ORDERS = _table(
    order_id=TEXT, date_id=INT, state_id=INT, product_id=INT, customer_demo_id=INT, event_id=INT,
    base_price=PRICE, discount_percent=PERCENT, final_price=PRICE, units_sold=INT, revenue=REVENUE,
    competition_intensity=TEXT, inventory_pressure=TEXT,
)
MONTHLY_SUMMARY = _table(
    year=INT, month=INT, month_start=DATE, total_revenue=T.DecimalType(14, 2), total_units=LONG,
    avg_discount=T.DecimalType(6, 2),
)


def require_columns(df: DataFrame, schema: T.StructType = STG_ORDERS) -> DataFrame:
    """Return `df`, or raise ValueError naming the columns it lacks."""
    missing = [name for name in schema.names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
