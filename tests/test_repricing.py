"""One-pass scenarios against a row-by-row pandas model."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from revq.operators.repricing import Leg, Scenario, run
from revq.plans import whatif
from revq.sources import files


def brute_force(pdf, scenario, params):
    """The result row of one scenario, on floats."""
    new = pdf.copy()
    hit = pd.Series(False, index=pdf.index)
    for leg in scenario.legs:
        mask = pd.Series(True, index=pdf.index)
        for column, values in leg.where.items():
            mask &= pdf[column].isin(values)
        above = float(params[leg.above]) if isinstance(leg.above, str) else leg.above
        if above is not None:
            mask &= pdf["discount_percent"] > above
        hit |= mask
        old = pdf[mask]
        if leg.growth is not None:
            new.loc[mask, "units_sold"] = old["units_sold"] * (1 + leg.growth / 100)
            new.loc[mask, "revenue"] = old["final_price"] * new.loc[mask, "units_sold"]
            continue
        if leg.cut is not None:
            discount = (old["discount_percent"] - leg.cut).clip(lower=0)
        else:
            discount = float(params[leg.discount]) if isinstance(leg.discount, str) else float(leg.discount)
        price = old["base_price"] * (1 - discount / 100)
        change = (price - old["final_price"]) / old["final_price"]
        units = (old["units_sold"] * (1 + leg.response * change)).clip(lower=0)
        new.loc[mask, "discount_percent"] = discount
        new.loc[mask, "final_price"] = price
        new.loc[mask, "units_sold"] = units
        new.loc[mask, "revenue"] = price * units
    before, after = pdf[hit], new[hit]
    units, new_units = before["units_sold"].sum(), after["units_sold"].sum()
    delta = new["revenue"].sum() - pdf["revenue"].sum()
    return {
        "rows_affected": int(hit.sum()),
        "simulated_revenue_total": new["revenue"].sum(),
        "revenue_delta": delta,
        "revenue_delta_pct": delta / pdf["revenue"].sum() * 100,
        "actual_revenue_affected": before["revenue"].sum(),
        "sim_revenue_affected": after["revenue"].sum(),
        "actual_units_affected": units,
        "sim_units_affected": new_units,
        "unit_delta": new_units - units,
        "unit_delta_pct": (new_units - units) / units * 100 if units > 0 else 0,
        "avg_discount_before": (before["discount_percent"] * before["units_sold"]).sum() / units if units > 0 else 0,
        "avg_discount_after": (after["discount_percent"] * after["units_sold"]).sum() / new_units
        if new_units > 0
        else 0,
    }


@pytest.fixture(scope="module")
def catalogue():
    return whatif.catalogue(("NATION_3", "NATION_11", "NATION_20"))


@pytest.fixture(scope="module")
def results(small_orders, catalogue):
    return {r["opportunity"]: r for r in whatif.results(small_orders, catalogue).collect()}


def test_all_scenarios_against_pandas(small_orders, catalogue, results):
    rows = whatif.whatif_orders(small_orders)
    pdf = rows.toPandas()
    numbers = ["base_price", "discount_percent", "final_price", "units_sold", "revenue"]
    pdf[numbers] = pdf[numbers].astype(float)
    params = whatif.parameters(rows).first().asDict()
    assert len(results) == len(catalogue) == 28
    for scenario in catalogue:
        shown = f"{params[scenario.shown]:f}" if scenario.shown else ""
        got = results[scenario.label.format(shown)]
        for name, want in brute_force(pdf, scenario, params).items():
            assert float(got[name]) == pytest.approx(want, abs=0.006), (scenario.label, name)


def test_parameters_against_pandas(small_orders):
    rows = whatif.whatif_orders(small_orders)
    pdf, params = rows.toPandas(), whatif.parameters(rows).first()
    best = pdf[pdf.discount_bracket == "30-40%"].groupby("discount_percent")["revenue"].sum()
    assert params.optimal_discount == best.astype(float).idxmax()
    calm = pdf[(pdf.sales_event == "Normal") & (pdf.competition_intensity != "High")]
    mean = float((calm.discount_percent * calm.units_sold).sum()) / calm.units_sold.sum()
    assert float(params.calm_avg) == round(mean, 2)


def test_identities(results):
    for r in results.values():
        assert r.revenue_delta == r.simulated_revenue_total - r.actual_revenue_total
        assert abs(r.sim_revenue_affected - r.actual_revenue_affected - r.revenue_delta) <= 0.01
        assert float(r.revenue_delta_pct) == pytest.approx(
            100 * float(r.revenue_delta) / float(r.actual_revenue_total), abs=1e-4
        )
    assert results["OPP_12: Lower-Tier States +30% Volume"].unit_delta_pct == 30


def test_rollups(spark, small_orders, catalogue, tmp_path):
    result = whatif.results(small_orders, catalogue)
    kinds = {r.sim_type: r.opportunities for r in whatif.by_sim_type(result).collect()}
    assert kinds == {"discount_change": 24, "reallocation": 1, "volume_growth": 3}
    line = whatif.portfolio(result).first()
    deltas = [r.revenue_delta for r in whatif.ranked(result).collect()]
    assert deltas == sorted(deltas, reverse=True)
    assert (line.opportunities, line.max_revenue_delta, line.combined_revenue_delta) == (28, deltas[0], sum(deltas))
    path = str(tmp_path / "results")
    files.write_csv(whatif.ranked(result), path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == result.columns and back.count() == 28


def one(orders, *scenarios):
    total = orders.agg(F.sum("revenue")).first()[0]
    return run(orders, scenarios, total).collect()


def test_scenario_without_rows(orders):
    df = whatif.whatif_orders(orders({}))
    (row,) = one(df, Scenario("none", "discount_change", (Leg({"state_name": ("Mars",)}, discount=10),)))
    assert (row.rows_affected, row.revenue_delta, row.avg_discount_after) == (0, 0, 0)
    assert row.simulated_revenue_total == row.actual_revenue_total == 80


def test_units_do_not_go_below_zero(orders):
    df = orders({"base_price": 100, "discount_percent": 70, "final_price": 30, "units_sold": 5})
    row = whatif.discount_change(df, F.lit(True), 31, 0.9).first()
    assert (row.units_sold, row.revenue) == (0.0, 0.0)


def test_only_masked_rows_change(orders):
    df = orders({"brand_type": "Mass"}, {"brand_type": "Premium", "units_sold": 7})
    changed = whatif.discount_change(df, F.col("brand_type") == "Mass", 10, 0.0)
    got = {r.brand_type: (r.discount_percent, r.final_price, r.units_sold, r.revenue) for r in changed.collect()}
    assert got == {"Mass": (10.0, 90.0, 1.0, 90.0), "Premium": (20.0, 80.0, 7.0, 560.0)}


def test_reallocation_sign_and_precedence(orders):
    df = orders({"discount_percent": 20, "units_sold": 10}, {"discount_percent": 5, "units_sold": 10, "sales_event": "Festival"})
    every, festival = F.lit(True), F.col("sales_event") == "Festival"
    got = whatif.reallocation(df, (every, 10, 0.5), (festival, 10, 0.0)).orderBy("discount_percent").collect()
    # The second group: discount stops at 0, no response. The first: price +12.5 %, units +6.25 %.
    assert [(r.discount_percent, r.units_sold) for r in got] == [(0.0, 10.0), (10.0, 10.625)]
    legs = (Leg({}, cut=10, response=0.5), Leg({"sales_event": ("Festival",)}, cut=10, response=0.0))
    (row,) = one(df, Scenario("both", "reallocation", legs))
    assert (row.rows_affected, float(row.sim_units_affected)) == (2, pytest.approx(20.62, abs=0.01))


def test_zero_price_adds_nothing(orders):
    df = orders({"discount_percent": 100, "final_price": 0, "revenue": 0}, {"discount_percent": 50})
    (row,) = one(df, Scenario("cap", "discount_change", (Leg({}, 40, 40, response=-0.5),)))
    assert (row.rows_affected, row.avg_discount_after) == (2, 40)


def test_tie_takes_the_lower_discount(orders):
    df = orders({"discount_percent": 35, "revenue": 10}, {"discount_percent": 32, "revenue": 10})
    params = whatif.parameters(df).first()
    assert (params.optimal_discount, params.normal_avg_0) == (32, None)


def test_unknown_parameter_selects_nothing(orders):
    df = orders({"discount_percent": 60, "category": "Electronics"})
    got = {r.opportunity: r.rows_affected for r in whatif.results(df).collect()}
    assert got["OPP_01: Mass Brand Cap at 40%"] == 1
    assert got["OPP_01: Mass Brand Cap at n/a%"] == 0
    assert got["OPP_09: Inelastic Segments to Optimal Discount"] == 0


def test_any_mask_can_be_a_scenario(orders):
    df = orders(
        {"customer_age": 70, "discount_percent": 25}, {"customer_age": 70, "discount_percent": 50},
        {"customer_age": 30, "discount_percent": 25}, {"customer_age": None},
    )
    masks = [F.col("customer_age") > 60, F.col("discount_percent").between(20, 30), F.lit(False)]
    scenarios = [Scenario(str(i), "discount_change", (Leg(discount=10, mask=m),)) for i, m in enumerate(masks)]
    got = {r.opportunity: (r.rows_affected, float(r.actual_revenue_affected)) for r in whatif.results(df, scenarios).collect()}
    assert got == {"0": (2, 125.0), "1": (2, 150.0), "2": (0, 0.0)}
    for mask, (rows, _) in zip(masks, got.values()):
        changed = whatif.discount_change(df, mask, 10, 0.8)
        assert changed.where("discount_percent = 10").count() == rows


def test_reallocation_leaves_other_events_alone(orders):
    df = orders({"sales_event": "Festival"}, {"sales_event": "normal"}, {"sales_event": "Clearance"})
    (row,) = [r for r in whatif.results(df).collect() if r.opportunity.startswith("OPP_10")]
    assert row.rows_affected == 2


def test_summaries_read_one_result(small_orders):
    tables = whatif.summaries(small_orders)
    assert tables["portfolio"].first().opportunities == tables["ranked"].count() == 28
    assert sum(r.opportunities for r in tables["by_sim_type"].collect()) == 28
