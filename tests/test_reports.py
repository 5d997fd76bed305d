"""Reports on hand-made rows: gaps, ties, single months, zero changes."""

from decimal import Decimal

from revq.plans import adhoc, views


def only(df):
    (row,) = df.collect()
    return row


def month(m, **given):
    return {"order_date": f"2024-{m:02d}-10"} | given


def test_lag_is_the_previous_existing_month(orders):
    df = orders(month(1, units_sold=2), month(3, units_sold=3))
    jan, mar = views.monthly_revenue_summary(df).orderBy("month_start").collect()
    assert (jan.prev_units, jan.unit_growth_pct) == (None, None)
    assert (mar.prev_units, mar.unit_growth_pct) == (2, Decimal("50.00"))


def test_single_month_series(orders):
    row = only(views.discount_response_quality(orders(month(1))))
    assert (row.observations, row.positive_response_rate, row.avg_response_ratio) == (1, 0, None)


def test_response_counts(orders):
    df = orders(
        month(1, discount_percent=10, units_sold=10),
        month(2, discount_percent=20, units_sold=15),
        month(4, discount_percent=10, units_sold=12),
    )
    row = only(views.discount_response_quality(df))
    assert (row.observations, row.discount_up_units_up, row.discount_down_units_down) == (3, 1, 1)
    assert row.positive_response_rate == Decimal("0.33")
    # (+50 % / +100 % + -20 % / -50 %) / 2
    assert row.avg_response_ratio == Decimal("0.4500")


def test_zero_price_change_has_no_elasticity(orders):
    df = orders({"discount_percent": 5, "final_price": 50}, {"discount_percent": 45, "final_price": 50, "units_sold": 3})
    row = only(views.price_sensitivity_by_segment(df))
    assert (row.low_discount_units, row.high_discount_units, row.mid_discount_units) == (1, 3, None)
    assert (row.elasticity_proxy, row.sensitivity_segment) == (None, "Low Sensitivity")


def test_revenue_tie_goes_by_name(orders):
    df = orders({"state": "Bihar"}, {"state": "Assam"})
    assert [r.state_name for r in adhoc.top_states(df).collect()] == ["Assam", "Bihar"]
    shares = [tuple(r)[-2:] for r in views.revenue_concentration_geo(df).orderBy("state_name").collect()]
    assert shares == [(Decimal("0.5000"), Decimal("0.5000")), (Decimal("0.5000"), Decimal("1.0000"))]


def test_festival_matches_in_any_case(orders):
    df = orders(*[{"sales_event": e} for e in ("FESTIVAL", "festival", "Festival", "Normal")])
    row = only(views.risk_adjusted_performance(df))
    assert (row.festival_units, row.festival_dependency_score) == (3, 75)


def test_risk_scores(orders):
    df = orders(
        month(1, discount_percent=50, units_sold=1, sales_event="Festival"),
        month(2, discount_percent=50, units_sold=2),
    )
    row = only(views.risk_adjusted_performance(df))
    # discount 50 and realization 0.5 -> 50; both changes 100 % -> 100; festival 50 of 150
    assert (row.discount_dependency_score, row.demand_volatility_score) == (50, 100)
    assert row.festival_dependency_score == Decimal("33.33")
    assert row.overall_risk_score == Decimal("63.33")
    assert row.risk_segment == "High-Risk Revenue Pocket"
    summary = only(views.risk_adjusted_summary(df))
    assert (summary.risk_tier, summary.priority_flag, summary.revenue_quartile) == ("High", "Urgent Review", 1)
    assert summary.strategic_action == views.ACT_URGENT


def test_festival_lift_without_normal_rows(orders):
    row = only(adhoc.event_revenue_per_order(orders({"sales_event": "Festival"})))
    assert row.festival_transactions == 1
    assert (row.normal_revenue, row.revenue_per_transaction_lift_pct) == (None, None)


def test_distinct_orders(orders):
    row = only(adhoc.best_band_by_revenue(orders({"order_id": "a"}, {"order_id": "a"}, {"order_id": "b"})))
    assert (row.total_transactions, row.total_units) == (2, 3)


def test_cannibalisation_flags(orders):
    df = orders(
        {"discount_percent": 5, "base_price": 100, "units_sold": 10},
        {"discount_percent": 15, "base_price": 40, "units_sold": 12},
        {"discount_percent": 25, "base_price": 40, "units_sold": 12},
        {"discount_percent": 35, "base_price": 90, "units_sold": 12},
    )
    flags = [r.cannibalization_flag for r in adhoc.cannibalisation(df).collect()]
    assert flags == [
        "No Clear Cannibalisation",
        "Cannibalisation Risk",
        "Deeper Discount, No Demand Gain",
        "No Clear Cannibalisation",
    ]


def test_monthly_elasticity(orders):
    df = orders(month(1, final_price=100, units_sold=10), month(2, final_price=50, units_sold=15))
    row = only(adhoc.monthly_elasticity(df))
    assert (row.units_change_pct, row.price_change_pct, row.elasticity_proxy) == (50, -50, -1)


def test_slope_of_revenue_on_discount(orders):
    df = orders(*[month(m, discount_percent=10 * m, revenue=100 - 5 * m) for m in (1, 2, 4)])
    row = only(views.pricing_intelligence(df))
    assert row.discount_revenue_beta == Decimal("-0.500")
    assert row.revenue_share_pct == 100


def test_margin_pockets_keep_the_top_ranks(orders):
    df = orders(*[{"state": f"S{i:02d}", "units_sold": i} for i in range(1, 41)])
    got = adhoc.margin_risk_pockets(df).collect()
    assert sorted(r.units for r in got) == list(range(11, 41))
    assert all(r.risk_priority_score == 41 - r.units + 1 for r in got)


def test_empty_orders(orders):
    none = orders({}).where("false")
    assert views.risk_adjusted_summary(none).count() == 0
    assert views.pricing_intelligence(none).count() == 0
    assert adhoc.margin_risk_pockets(none).count() == 0
