"""Edges of bands, groups and rounding."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from revq.functions import labels
from revq.functions.numeric import mean, pct_change, ratio, rnd, rnd_even


def apply(spark, function, values, kind):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}").coalesce(1)
    return [r[0] for r in df.select(function(F.col("x"))).collect()]


def decimals(*values):
    return [None if v is None else Decimal(str(v)) for v in values]


@pytest.mark.parametrize(
    "function, values, expected",
    [
        (
            labels.discount_band,
            (0, 10, 10.01, 20, 70, 90, 90.01, None),
            ["0-10%", "0-10%", "11-20%", "11-20%", "61-70%", "81-90%", "91%+", "91%+"],
        ),
        (
            labels.discount_bracket,
            (0, 0.01, 10, 10.01, 30, 40, 40.01, 70, 70.01, None),
            [None, "0-10%", "0-10%", "10-20%", "20-30%", "30-40%", "40%+", "40%+", None, None],
        ),
        (
            labels.incentive_group,
            (10, 10.01, 30, 30.01, None),
            ["Low Incentive", "Moderate Incentive", "Moderate Incentive", "High Incentive", "High Incentive"],
        ),
        (labels.sensitivity_group, (9.99, 10, 39.99, 40, None), ["LOW", "MID", "MID", "HIGH", "MID"]),
    ],
)
def test_discount_edges(spark, function, values, expected):
    assert apply(spark, function, decimals(*values), "decimal(5,2)") == expected


def test_age_edges(spark):
    ages = (17, 18, 24, 25, 44, 45, 59, 60)
    assert apply(spark, labels.age_group, ages, "int") == [
        "Elderly", "Youth", "Youth", "Young Adult", "Young Adult", "Middle-aged", "Middle-aged", "Elderly",
    ]
    assert apply(spark, labels.whatif_age_group, ages, "int") == [
        None, "Youth", "Youth", "Young Adult", "Young Adult", "Middle Age", "Middle Age", "Elderly",
    ]


def test_rounding(spark):
    half_up = apply(spark, lambda x: rnd(x, 2), (0.145, 0.144999, -0.145, None), "double")
    assert half_up == decimals("0.15", "0.14", "-0.15", None)
    assert apply(spark, lambda x: rnd_even(x, 0), (2.5, 3.5), "double") == decimals(2, 4)
    assert apply(spark, lambda x: rnd_even(x, 2), (2.345, 2.355), "double") == decimals("2.34", "2.36")


def test_null_safe_quotients(spark):
    row = spark.range(1).select(
        ratio(F.lit(1), F.lit(0)).alias("zero"),
        ratio(F.lit(1), F.lit(4)).alias("quarter"),
        pct_change(F.lit(3), F.lit(0)).alias("no_base"),
        pct_change(F.lit(3), F.lit(None).cast("int")).alias("no_past"),
        pct_change(F.lit(3), F.lit(2)).alias("half_more"),
    ).first()
    assert tuple(row) == (None, 0.25, None, None, 50.0)
    assert spark.createDataFrame([(1,), (None,), (2,)], "x int").select(mean(F.col("x"))).first()[0] == 1.5


def test_revenue_loss_rounds_each_row(spark):
    rows = spark.createDataFrame([(Decimal("0.01"), Decimal("50"), 1)] * 2, "b decimal(10,2), p decimal(5,2), u int")
    loss = labels.revenue_loss(F.col("b"), F.col("p"), F.col("u"))
    assert rows.select(F.sum(loss)).first()[0] == Decimal("0.02")


def test_sql_functions_agree(spark):
    labels.register_sql_functions(spark)
    row = spark.sql(
        "SELECT discount_band(10.01) AS a, discount_band(NULL) AS b, discount_band(90.01) AS c, "
        "revenue_loss(100, 12.5, 3) AS d, revenue_loss(0.01, 50, 1) AS e"
    ).first()
    assert tuple(row) == ("11-20%", "91%+", "91%+", Decimal("37.50"), Decimal("0.01"))
