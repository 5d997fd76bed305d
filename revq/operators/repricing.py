"""What-if repricing of order rows, and a whole catalogue of it in one pass.

A scenario changes the rows its legs select. Three models are known: a new
discount, a discount cut by some points, and more volume at the same price.
`reprice` turns the parameters of one leg into a row's new discount, price,
units and revenue. `run` finds the selections each row belongs to, looks up
the legs that use them and sums per scenario. The order table is read once for
any number of scenarios, and only sums are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from decimal import Decimal
from functools import reduce
from numbers import Number

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revq.functions.numeric import dbl, ratio, rnd_even


def _millionths(x: Column) -> Column:
    """A simulated amount as a whole number of millionths: sums of these are exact."""
    return F.rint(x * 1e6).cast("bigint").cast("decimal(19,0)")


def _sum_of_millionths(name: str) -> Column:
    return F.sum(name) * F.lit("0.000001").cast("decimal(6,6)")



@dataclass(frozen=True)
class Leg:
    """Rows and the change applied to them.

    where: column -> allowed values. above: discount must exceed it. mask: any
    further condition on the order rows. Rows must fulfil all that are given.
    One of discount, cut (percentage points) or growth (percent) is set;
    discount and above may name a data-driven parameter.
    response: change of units per unit of relative price change, signed.
    """

    where: dict[str, tuple[str, ...]] = field(default_factory=dict)
    above: float | str | None = None
    discount: float | str | None = None
    cut: float | None = None
    growth: float | None = None
    response: float = 0.0
    mask: Column | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Scenario:
    """label may hold {}, filled with the value of the parameter named by `shown`."""

    label: str
    sim_type: str
    legs: tuple[Leg, ...]
    shown: str | None = None


def reprice(
    discount: Column | None = None,
    cut: Column | None = None,
    growth: Column | None = None,
    response: Column | None = None,
) -> dict[str, Column]:
    """New discount_percent, final_price, units_sold and revenue of a row, as doubles.

    Parameters left out, or NULL in a row, do not apply. A price of 0 has no
    relative change: units and revenue are then NULL and add nothing.
    """
    none = F.lit(None).cast("double")
    discount, cut, growth, response = (
        none if p is None else p for p in (discount, cut, growth, response)
    )
    units, price = dbl(F.col("units_sold")), dbl(F.col("final_price"))
    old_discount = dbl(F.col("discount_percent"))
    repriced = discount.isNotNull() | cut.isNotNull()
    # greatest() skips a NULL and would answer 0, so what may be NULL is tested first.
    lowered = F.when(cut.isNotNull(), F.greatest(old_discount - cut, F.lit(0.0)))
    new_discount = F.coalesce(discount, lowered, old_discount)
    new_price = F.when(repriced, dbl(F.col("base_price")) * (1 - new_discount / 100)).otherwise(price)
    change = ratio(new_price - price, price)
    moved = units * (1 + response * change)
    new_units = (
        F.when(repriced, F.when(moved.isNotNull(), F.greatest(moved, F.lit(0.0))))
        .when(growth.isNotNull(), units * (1 + growth / 100))
        .otherwise(units)
    )
    return {
        "discount_percent": new_discount,
        "final_price": new_price,
        "units_sold": new_units,
        "revenue": new_price * new_units,
    }


def apply_where(orders: DataFrame, mask: Column, changed: dict[str, Column]) -> DataFrame:
    """Replace columns on the rows of `mask`; other rows keep their values."""
    return orders.withColumns(
        {name: F.when(mask, new).otherwise(dbl(F.col(name))) for name, new in changed.items()}
    )


def _filled(setting: Number | str | None, params: Mapping[str, Number | None]) -> Number | None:
    return params[setting] if isinstance(setting, str) else setting


def fill(scenario: Scenario, params: Mapping[str, Number | None]) -> Scenario:
    """Put data-driven parameters in; a leg whose parameter is unknown falls away."""
    legs = []
    for leg in scenario.legs:
        discount, above = _filled(leg.discount, params), _filled(leg.above, params)
        unknown = (leg.discount is not None and discount is None) or (
            leg.above is not None and above is None
        )
        if not unknown:
            legs.append(replace(leg, discount=discount, above=above))
    label = scenario.label
    if scenario.shown:
        shown = params[scenario.shown]
        label = label.format("n/a" if shown is None else f"{shown:f}")
    return replace(scenario, label=label, legs=tuple(legs))


def _mask(leg: Leg) -> Column:
    tests = [F.col(column).isin(*values) for column, values in leg.where.items()]
    if leg.above is not None:
        tests.append(F.col("discount_percent") > leg.above)
    if leg.mask is not None:
        tests.append(leg.mask)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _selections(scenarios: Sequence[Scenario]) -> tuple[list[Column], list[tuple]]:
    """Distinct row selections, and one row per leg naming the one it uses.

    Legs with the same rows share a selection. Of two legs of a scenario on one
    row the later one counts.
    """
    places, masks, legs = {}, [], []
    for n, scenario in enumerate(scenarios):
        for i, leg in enumerate(scenario.legs):
            later = scenario.legs[i + 1:]
            key = repr([(x.where, x.above, str(x.mask)) for x in (leg, *later)])
            if key not in places:
                places[key] = len(masks)
                excluded = [~F.coalesce(_mask(x), F.lit(False)) for x in later]
                masks.append(reduce(lambda a, b: a & b, excluded, _mask(leg)))
            numbers = (leg.discount, leg.cut, leg.growth, leg.response)
            legs.append((places[key], n, *[None if x is None else float(x) for x in numbers]))
    return masks, legs


def _leg_table(spark: SparkSession, legs: list[tuple]) -> DataFrame:
    """The legs as an inline table, which costs no job to read."""

    def literal(x: float | int | None) -> str:
        return "null" if x is None else f"{x!r}D" if isinstance(x, float) else str(x)

    # A row of no selection gives the columns their types, also for an empty catalogue.
    rows = ["(-1, -1, 0D, 0D, 0D, 0D)", *[f"({', '.join(map(literal, leg))})" for leg in legs]]
    return spark.sql(
        f"SELECT * FROM VALUES {', '.join(rows)} "
        "AS legs (selection, scenario, discount, cut, growth, response)"
    )


def _sums(orders: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """Per scenario, sums over the rows it selects, before and after."""
    masks, legs = _selections(scenarios)
    hits = [F.when(mask, F.lit(i)) for i, mask in enumerate(masks)]
    selected = orders.select(
        "base_price", "discount_percent", "final_price", "units_sold", "revenue",
        F.explode(F.array_compact(F.array(*hits))).alias("selection"),
    )
    # One row per leg of the catalogue, so it may be broadcast.
    parameters = F.broadcast(_leg_table(orders.sparkSession, legs))
    new = reprice(F.col("discount"), F.col("cut"), F.col("growth"), F.col("response"))
    return (
        selected.join(parameters, "selection")
        .select(
            "scenario", "revenue", "units_sold",
            (F.col("discount_percent") * F.col("units_sold")).alias("weighted"),
            _millionths(new["revenue"]).alias("new_revenue"),
            _millionths(new["units_sold"]).alias("new_units"),
            _millionths(new["discount_percent"] * new["units_sold"]).alias("new_weighted"),
        )
        .groupBy("scenario")
        .agg(
            F.count(F.lit(1)).alias("rows_affected"),
            F.sum("revenue").alias("revenue"),
            F.sum("units_sold").alias("units"),
            F.sum("weighted").alias("weighted"),
            _sum_of_millionths("new_revenue").alias("new_revenue"),
            _sum_of_millionths("new_units").alias("new_units"),
            _sum_of_millionths("new_weighted").alias("new_weighted"),
        )
    )


def run(
    orders: DataFrame,
    scenarios: Sequence[Scenario],
    total_revenue: Decimal,
    params: Mapping[str, Number | None] | None = None,
) -> DataFrame:
    """One result row per scenario, also for one that selects no row.

    total_revenue is that of all orders; params holds data-driven parameters.
    """
    filled = [fill(s, params or {}) for s in scenarios]
    labels = orders.sparkSession.createDataFrame(
        [(n, s.label, s.sim_type) for n, s in enumerate(filled)],
        "scenario int, opportunity string, sim_type string",
    )
    # One row per scenario at most.
    rows = labels.join(F.broadcast(_sums(orders, filled)), "scenario", "left")

    def amount(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    def average(num: Column, den: Column) -> Column:
        return F.when(den > 0, ratio(num, den)).otherwise(0.0)

    total = F.lit(total_revenue)
    delta = amount("new_revenue") - amount("revenue")
    units, new_units = amount("units"), amount("new_units")
    unit_delta = new_units - units
    unit_delta_pct = F.when(units > 0, ratio(unit_delta, units) * 100).otherwise(0.0)
    return rows.select(
        "opportunity",
        "sim_type",
        amount("rows_affected").alias("rows_affected"),
        rnd_even(total, 2).alias("actual_revenue_total"),
        # Rows outside the scenario keep their revenue, so totals differ by delta.
        rnd_even(total + delta, 2).alias("simulated_revenue_total"),
        rnd_even(delta, 2).alias("revenue_delta"),
        rnd_even(ratio(delta, total) * 100, 4).alias("revenue_delta_pct"),
        rnd_even(amount("revenue"), 2).alias("actual_revenue_affected"),
        rnd_even(amount("new_revenue"), 2).alias("sim_revenue_affected"),
        rnd_even(units, 2).alias("actual_units_affected"),
        rnd_even(new_units, 2).alias("sim_units_affected"),
        rnd_even(unit_delta, 2).alias("unit_delta"),
        rnd_even(unit_delta_pct, 4).alias("unit_delta_pct"),
        rnd_even(average(amount("weighted"), units), 2).alias("avg_discount_before"),
        rnd_even(average(amount("new_weighted"), new_units), 2).alias("avg_discount_after"),
    )
