"""The pricing opportunities: data-driven parameters, catalogue and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revq.functions.labels import discount_bracket, is_event, whatif_age_group
from revq.functions.numeric import mean, ratio, rnd_even
from revq.operators.repricing import Leg, Scenario, apply_where, reprice, run
from revq.session import materialise

# Labels, discounts, elasticities and rates of the catalogue.
CAPS = (40, 38, 35)
BASELINE_CATEGORIES = ("Premium Lifestyle", "Electronics")
INELASTIC = ("Home & Living", "Footwear", "Premium Lifestyle")
OLDER = ("Elderly", "Middle Age")
LOWER_TIER_STATES = ("Uttar Pradesh", "West Bengal", "Odisha")


def discount_change(
    orders: DataFrame, mask: Column, new_discount: float, elasticity: float
) -> DataFrame:
    """Orders of `mask` at a new discount; units fall as the price rises."""
    return apply_where(
        orders, mask, reprice(discount=F.lit(float(new_discount)), response=F.lit(-elasticity))
    )


def volume_growth(orders: DataFrame, mask: Column, growth_pct: float) -> DataFrame:
    """Orders of `mask` with more units at the same price."""
    return apply_where(orders, mask, reprice(growth=F.lit(float(growth_pct))))


def reallocation(
    orders: DataFrame,
    first: tuple[Column, float, float],
    second: tuple[Column, float, float],
) -> DataFrame:
    """Two groups of orders, each (mask, discount points cut, elasticity).

    Here units rise with the price: the sign is opposite to `discount_change`.
    Where both masks select a row, the second counts.
    """
    legs = [
        (mask, reprice(cut=F.lit(float(points)), response=F.lit(float(e))))
        for mask, points, e in (first, second)
    ]
    (mask1, new1), (mask2, new2) = legs
    changed = {n: F.when(mask2, new2[n]).otherwise(new1[n]) for n in new1}
    return apply_where(orders, mask1 | mask2, changed)


def whatif_orders(orders: DataFrame) -> DataFrame:
    """Orders with the brackets and age groups the catalogue selects by."""
    return orders.withColumns(
        {
            "discount_bracket": discount_bracket(F.col("discount_percent")),
            "customer_age_group": whatif_age_group(F.col("customer_age")),
        }
    )


def parameters(orders: DataFrame) -> DataFrame:
    """Data-driven parameters and total revenue: one row, from one scan.

    optimal_discount is the discount with the highest revenue in the bracket
    30-40%, the lower one on a tie. The baselines are unit-weighted mean
    discounts of normal periods: per category, and away from high competition.
    """
    keys = ["discount_percent", "category", "sales_event", "competition_intensity"]
    cube = orders.groupBy(*keys).agg(F.sum("revenue").alias("revenue"), F.sum("units_sold").alias("units"))
    weighted = F.col("discount_percent") * F.col("units")
    normal = is_event(F.col("sales_event"), "normal")
    periods = {f"normal_{i}": normal & (F.col("category") == c) for i, c in enumerate(BASELINE_CATEGORIES)}
    periods["calm"] = normal & (F.col("competition_intensity") != "High")
    per_discount = cube.groupBy("discount_percent").agg(
        F.sum("revenue").alias("revenue"),
        *[F.sum(F.when(p, weighted)).alias(f"{n}_weighted") for n, p in periods.items()],
        *[F.sum(F.when(p, F.col("units"))).alias(f"{n}_units") for n, p in periods.items()],
    )
    discount = F.col("discount_percent")
    in_bracket = discount_bracket(discount) == "30-40%"
    best = F.max(F.when(in_bracket, F.struct(F.col("revenue"), (-discount).alias("low"))))
    averages = {n: ratio(F.sum(f"{n}_weighted"), F.sum(f"{n}_units")) for n in periods}
    return per_discount.agg(
        (-best["low"]).alias("optimal_discount"),
        *[averages[f"normal_{i}"].alias(f"normal_{i}") for i in range(len(BASELINE_CATEGORIES))],
        averages["calm"].alias("calm"),
        F.sum("revenue").alias("total_revenue"),
    ).select(
        "optimal_discount",
        rnd_even(F.col("optimal_discount"), 0).alias("optimal_discount_rounded"),
        *[rnd_even(F.col(f"normal_{i}"), 1).alias(f"normal_avg_{i}") for i in range(len(BASELINE_CATEGORIES))],
        rnd_even(F.col("calm"), 2).alias("calm_avg"),
        "total_revenue",
    )


def _capped(label: str, where: dict, elasticity: float, above: float | None) -> list[Scenario]:
    """One scenario per cap; above=None stands for the cap itself."""
    caps = [(str(c), c, None) for c in CAPS]
    caps.append(("{}", "optimal_discount_rounded", "optimal_discount_rounded"))
    return [
        Scenario(
            label.replace("#", text),
            "discount_change",
            (Leg(where, cap if above is None else above, discount=cap, response=-elasticity),),
            shown,
        )
        for text, cap, shown in caps
    ]


def _change(label: str, where: dict, above: float | None, discount, elasticity: float) -> Scenario:
    return Scenario(label, "discount_change", (Leg(where, above, discount, response=-elasticity),))


def catalogue(lower_tier_states: Sequence[str] = LOWER_TIER_STATES) -> list[Scenario]:
    """The 28 scenarios."""
    mass = {"brand_type": ("Mass",)}
    festival = {"sales_event": ("Festival",)}
    lower_tier = {"state_name": tuple(lower_tier_states)}
    return [
        *_capped("OPP_01: Mass Brand Cap at #%", mass, 0.8, above=40),
        *_capped(
            "OPP_02: Electronics Mass Cap at #%", mass | {"category": ("Electronics",)}, 0.8, above=40
        ),
        *_capped("OPP_03: Deep Bands Cap at #%", {"discount_bracket": ("40%+",)}, 0.8, above=None),
        *[
            _change(
                f"OPP_04: No Festival Discount — {c}",
                festival | {"category": (c,)}, None, f"normal_avg_{i}", 0.3,
            )
            for i, c in enumerate(BASELINE_CATEGORIES)
        ],
        *[
            _change(
                f"OPP_05: Age Low-Sensitivity to {t}% (Step {step})",
                {"customer_age_group": OLDER}, t, t, 0.2,
            )
            for step, t in enumerate((30, 25, 20), 1)
        ],
        _change("OPP_06: Premium Brand Cap at 30%", {"brand_type": ("Premium",)}, 30, 30, 0.3),
        _change("OPP_07: Inventory Markdown Cap at 40%", {"inventory_pressure": ("High",)}, 40, 40, 0.6),
        _change(
            "OPP_08: Remove Triple-Risk Combination",
            festival | {"competition_intensity": ("High",), "discount_bracket": ("40%+",)},
            None, "calm_avg", 0.65,
        ),
        _change(
            "OPP_09: Inelastic Segments to Optimal Discount",
            {"category": INELASTIC}, 40, "optimal_discount", 0.2,
        ),
        Scenario(
            "OPP_10: Reallocate Festival Spend to Normal Periods",
            "reallocation",
            (Leg(festival, cut=10, response=0.5), Leg({"sales_event": ("Normal",)}, cut=3, response=0.3)),
        ),
        *[
            _change(
                f"OPP_11: Grocery Essentials to {t}%", {"category": ("Grocery Essentials",)}, 25, t, 0.9
            )
            for t in (25, 22, 20)
        ],
        *[
            Scenario(
                f"OPP_12: Lower-Tier States +{g}% Volume", "volume_growth", (Leg(lower_tier, growth=g),)
            )
            for g in (10, 20, 30)
        ],
    ]


def results(orders: DataFrame, scenarios: Sequence[Scenario] | None = None) -> DataFrame:
    """One row per scenario, from two scans: parameters first, then all scenarios."""
    rows = whatif_orders(orders)
    params = parameters(rows).first().asDict()
    total = params.pop("total_revenue")
    return run(rows, catalogue() if scenarios is None else scenarios, total, params)


def summaries(orders: DataFrame, scenarios: Sequence[Scenario] | None = None) -> dict[str, DataFrame]:
    """The results, written once, and the three tables read off them."""
    result = materialise(results(orders, scenarios))
    return {
        "results": result, "ranked": ranked(result), "by_sim_type": by_sim_type(result), "portfolio": portfolio(result),
    }


def ranked(result: DataFrame) -> DataFrame:
    """The summary table: best revenue change first."""
    return result.orderBy(F.desc("revenue_delta"), "opportunity")


def by_sim_type(result: DataFrame) -> DataFrame:
    """Number of runs, summed change and mean change in percent per model."""
    return result.groupBy("sim_type").agg(
        F.count("opportunity").alias("opportunities"),
        F.sum("revenue_delta").alias("total_revenue_delta"),
        mean(F.col("revenue_delta_pct"), 4).alias("avg_revenue_delta_pct"),
    )


def portfolio(result: DataFrame) -> DataFrame:
    """One line: number of runs, best change, and the sum of all as an upper bound."""
    return result.agg(
        F.count(F.lit(1)).alias("opportunities"),
        F.max("revenue_delta").alias("max_revenue_delta"),
        F.sum("revenue_delta").alias("combined_revenue_delta"),
    )
