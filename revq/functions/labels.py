"""Bands, groups and the two SQL functions.

The reports cut discounts and ages at different edges and with different
labels, so each coding has a function of its own. A NULL input falls into the
last branch where the definition ends in ELSE, and stays NULL where it is a
list of closed intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper edge (included) and label of each discount band.
BANDS = (
    (10, "0-10%"),
    (20, "11-20%"),
    (30, "21-30%"),
    (40, "31-40%"),
    (50, "41-50%"),
    (60, "51-60%"),
    (70, "61-70%"),
    (80, "71-80%"),
    (90, "81-90%"),
)
TOP_BAND = "91%+"

# What-if brackets, each (above, up to and including, label).
BRACKETS = (
    (0, 10, "0-10%"),
    (10, 20, "10-20%"),
    (20, 30, "20-30%"),
    (30, 40, "30-40%"),
    (40, 70, "40%+"),
)

# Age groups of the star schema, both ends included.
AGE_GROUPS = ((18, 24, "Youth"), (25, 44, "Young Adult"), (45, 59, "Middle-aged"))
OTHER_AGES = "Elderly"

# Age groups of the what-if catalogue; below 18 there is none.
WHATIF_AGE_GROUPS = ((18, 24, "Youth"), (25, 44, "Young Adult"), (45, 59, "Middle Age"))
WHATIF_OLDEST = (60, "Elderly")


# Columns whose few values are written with a capital first letter.
CLOSED_VOCABULARIES = ("brand_type", "sales_event", "competition_intensity", "inventory_pressure")


def one_spelling(orders: DataFrame) -> DataFrame:
    """Write closed vocabularies one way ('FESTIVAL ' -> 'Festival'); names compare without case."""
    return orders.withColumns({name: F.initcap(F.trim(F.col(name))) for name in CLOSED_VOCABULARIES})


def discount_band(pct: Column) -> Column:
    pct = pct.cast("decimal(5,2)")
    (edge, label), *rest = BANDS
    band = F.when(pct <= edge, label)
    for edge, label in rest:
        band = band.when(pct <= edge, label)
    return band.otherwise(TOP_BAND)


def discount_bracket(pct: Column) -> Column:
    """What-if bracket; 0 and anything above 70 belong to none."""
    return F.coalesce(
        *[F.when((pct > low) & (pct <= high), F.lit(label)) for low, high, label in BRACKETS]
    )


def incentive_group(pct: Column) -> Column:
    return (
        F.when(pct <= 10, "Low Incentive")
        .when(pct <= 30, "Moderate Incentive")
        .otherwise("High Incentive")
    )


def sensitivity_group(pct: Column) -> Column:
    return F.when(pct < 10, "LOW").when(pct >= 40, "HIGH").otherwise("MID")


def age_group(age: Column) -> Column:
    return F.coalesce(
        *[F.when(age.between(low, high), F.lit(label)) for low, high, label in AGE_GROUPS],
        F.lit(OTHER_AGES),
    )


def whatif_age_group(age: Column) -> Column:
    oldest, label = WHATIF_OLDEST
    return F.coalesce(
        *[F.when(age.between(low, high), F.lit(name)) for low, high, name in WHATIF_AGE_GROUPS],
        F.when(age >= oldest, F.lit(label)),
    )


def revenue_loss(base_price: Column, pct: Column, units: Column) -> Column:
    """Money given away by the discount, rounded per row before any sum."""
    return (base_price * units * pct * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(20,2)")


def is_event(event: Column, name: str) -> Column:
    """Rows of an event; orders hold each event in one spelling."""
    return event == name.capitalize()


def register_sql_functions(spark: SparkSession) -> None:
    """Make discount_band and revenue_loss callable from spark.sql."""
    branches = " ".join(f"WHEN pct <= {edge} THEN '{label}'" for edge, label in BANDS)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION discount_band(pct DECIMAL(5,2)) RETURNS STRING "
        f"RETURN CASE {branches} ELSE '{TOP_BAND}' END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION revenue_loss("
        "base_price DECIMAL(10,2), pct DECIMAL(5,2), units INT) RETURNS DECIMAL(20,2) "
        "RETURN CAST(base_price * units * pct * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(20,2))"
    )
