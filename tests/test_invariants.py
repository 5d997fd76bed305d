"""What must hold between reports on any data."""

import pytest
from pyspark.sql import functions as F

from revq.plans import adhoc, procedures, views

TOTALS = [
    views.monthly_revenue_summary,
    views.event_uplift_by_category,
    views.monthly_discount_band,
    views.discount_band_performance,
    views.inventory_pricing_pressure,
    views.revenue_quality_risk_hotspots,
    views.risk_adjusted_performance,
    views.competition_discount_performance,
    views.revenue_concentration_geo,
    procedures.monthly_summary,
    adhoc.revenue_by_state_and_age,
]


@pytest.fixture(scope="module")
def portfolio(small_orders):
    return small_orders.agg(F.sum("revenue").alias("revenue"), F.sum("units_sold").alias("units")).first()


@pytest.mark.parametrize("report", TOTALS, ids=lambda r: r.__name__)
def test_revenue_is_whole(report, small_orders, portfolio):
    assert report(small_orders).agg(F.sum("total_revenue")).first()[0] == portfolio.revenue


def test_other_revenue_columns(small_orders, portfolio):
    for report in (views.state_growth, adhoc.revenue_loss_by_band, views.pricing_intelligence):
        assert report(small_orders).agg(F.sum("revenue")).first()[0] == portfolio.revenue


def test_shares_sum_to_one(small_orders):
    geo = views.revenue_concentration_geo(small_orders).groupBy("month_start").agg(
        F.sum("revenue_share").alias("s"), F.max("cumulative_revenue_share").alias("c")
    )
    assert geo.where("abs(s - 1) > 0.002 OR c <> 1").count() == 0
    units = adhoc.incentive_sensitivity(small_orders).groupBy("category", "brand_type").agg(
        F.sum("unit_share").alias("s")
    )
    assert units.where("abs(s - 1) > 0.001").count() == 0


def test_discount_cost_is_gross_less_net(small_orders):
    rows = views.inventory_pricing_pressure(small_orders)
    off = F.abs(F.col("realization_ratio") - (1 - F.col("total_discount_cost") / F.col("gross_base_revenue")))
    assert rows.where(off > 0.0001).count() == 0


def test_ranks_and_quartiles(small_orders):
    summary = views.risk_adjusted_summary(small_orders).toPandas()
    assert set(summary["revenue_rank"]) == set(range(1, summary["revenue_rank"].max() + 1))
    sizes = summary.groupby("revenue_quartile").size()
    assert sizes.max() - sizes.min() <= 1
    best = summary.sort_values("revenue_rank")["total_revenue"].astype(float)
    assert best.is_monotonic_decreasing
