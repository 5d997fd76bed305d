"""The thirteen ad-hoc queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revq.functions.labels import incentive_group, is_event, revenue_loss
from revq.functions.numeric import mean, pct_change, ratio, rel_change, rnd
from revq.operators.ranking import with_global_ranks
from revq.plans.measures import (
    avg_discount,
    one_zone_per_state,
    realization,
    revenue_per_order,
    revenue_per_unit,
    totals,
    weighted_price,
    with_group,
)

EVENTS = ("festival", "normal")


def _event_column(event: str, value: str) -> Column:
    """The value of the row of one event, NULL if there is none."""
    return F.max(F.when(is_event(F.col("sales_event"), event), F.col(value)))


def _lift_pct(festival: Column, normal: Column) -> Column:
    return rnd(100 * (ratio(festival, normal) - 1), 2)


def top_states(orders: DataFrame, n: int = 5) -> DataFrame:
    """The n states with the highest revenue."""
    by_state = one_zone_per_state(totals(orders, ["state_name", "zone"], "revenue"))
    return (
        by_state.groupBy("state_name", "zone")
        .agg(F.sum("revenue").alias("total_revenue"))
        .orderBy(F.desc("total_revenue"), "state_name")
        .limit(n)
    )


def revenue_by_state_and_age(orders: DataFrame) -> DataFrame:
    """Revenue per state and age group, with the state's quartile in the age group."""
    by_group = totals(orders, ["state_name", "customer_age_group"], "revenue")
    ascending = Window.partitionBy("customer_age_group").orderBy("revenue", "state_name")
    return by_group.select(
        "state_name",
        "customer_age_group",
        F.col("revenue").alias("total_revenue"),
        F.ntile(4).over(ascending).alias("revenue_quartile"),
    )


def incentive_sensitivity(orders: DataFrame) -> DataFrame:
    """Units per category, brand and incentive group, and their share."""
    grouped = with_group(orders, "sensitivity_group", incentive_group)
    keys = ["category", "brand_type", "sensitivity_group"]
    product = Window.partitionBy("category", "brand_type")
    return totals(grouped, keys, "units").select(
        *keys,
        "units",
        rnd(ratio(F.col("units"), F.sum("units").over(product)), 4).alias("unit_share"),
    )


def revenue_loss_by_band(orders: DataFrame) -> DataFrame:
    """Revenue, units and revenue given away per discount band."""
    loss = revenue_loss(F.col("base_price"), F.col("discount_percent"), F.col("units_sold"))
    return (
        orders.groupBy(F.col("discount_band").alias("discount_range"))
        .agg(
            F.sum("revenue").alias("revenue"),
            F.sum("units_sold").alias("units"),
            F.sum(loss).alias("revenue_forfeited"),
        )
        .orderBy("discount_range")
    )


def _per_order_by_event(orders: DataFrame, keys: list[str]) -> DataFrame:
    by_event = totals(orders, [*keys, "sales_event"], "revenue", "transactions").withColumn(
        "per_order", revenue_per_order()
    )
    columns = []
    for event in EVENTS:
        columns += [
            _event_column(event, "revenue").alias(f"{event}_revenue"),
            _event_column(event, "transactions").alias(f"{event}_transactions"),
            _event_column(event, "per_order").alias(f"{event}_per_order"),
        ]
    wide = by_event.groupBy(*keys).agg(*columns)
    per_order = {event: F.col(f"{event}_per_order") for event in EVENTS}
    shown = []
    for event in EVENTS:
        shown += [
            f"{event}_revenue",
            f"{event}_transactions",
            rnd(per_order[event], 2).alias(f"{event}_revenue_per_transaction"),
        ]
    lift = _lift_pct(per_order["festival"], per_order["normal"])
    return wide.select(*keys, *shown, lift.alias("revenue_per_transaction_lift_pct"))


def event_revenue_per_order(orders: DataFrame) -> DataFrame:
    """Festival against normal periods: one row."""
    return _per_order_by_event(orders, [])


def event_revenue_per_order_by_category(orders: DataFrame) -> DataFrame:
    """Festival against normal periods, per category."""
    result = _per_order_by_event(orders, ["category"])
    return result.orderBy(F.desc("revenue_per_transaction_lift_pct"), "category")


def _mean_by_event(daily: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """Mean over the dates of each event, then one column per event and value."""
    means = daily.groupBy(*keys, "sales_event").agg(*[mean(v).alias(n) for n, v in values.items()])
    return means.groupBy(*keys).agg(
        *[_event_column(e, n).alias(f"{e}_{n}") for n in values for e in EVENTS]
    )


def festival_lift(orders: DataFrame) -> DataFrame:
    """Mean revenue per order date, festival against normal, per category and brand.

    The column names say monthly; the dates are order dates.
    """
    keys = ["category", "brand_type"]
    daily = totals(orders, [*keys, "sales_event", "order_date"], "revenue")
    wide = _mean_by_event(daily, keys, avg_monthly_revenue=F.col("revenue"))
    festival, normal = (F.col(f"{e}_avg_monthly_revenue") for e in EVENTS)
    return wide.select(
        *keys,
        rnd(festival, 2).alias("festival_avg_monthly_revenue"),
        rnd(normal, 2).alias("normal_avg_monthly_revenue"),
        _lift_pct(festival, normal).alias("festival_lift_pct"),
    ).orderBy("category", F.desc("festival_lift_pct"), "brand_type")


def festival_lift_and_discount(orders: DataFrame) -> DataFrame:
    """Festival lift per category, with the mean daily discount of both periods."""
    daily = totals(
        orders, ["category", "sales_event", "order_date"], "revenue", "discount_sum", "discount_rows"
    ).withColumn("avg_discount", avg_discount())
    wide = _mean_by_event(
        daily, ["category"], avg_monthly_revenue=F.col("revenue"), avg_discount=F.col("avg_discount")
    )
    festival, normal = (F.col(f"{e}_avg_monthly_revenue") for e in EVENTS)
    return wide.select(
        "category",
        rnd(festival, 2).alias("festival_avg_monthly_revenue"),
        rnd(normal, 2).alias("normal_avg_monthly_revenue"),
        _lift_pct(festival, normal).alias("festival_lift_pct"),
        rnd(F.col("festival_avg_discount"), 2).alias("festival_avg_discount"),
        rnd(F.col("normal_avg_discount"), 2).alias("normal_avg_discount"),
    ).orderBy(F.desc("festival_lift_pct"), "category")


def _band_performance(orders: DataFrame) -> DataFrame:
    """Category x discount band. Distinct orders are counted exactly.

    Orders are shuffled by category, band and order id, so neither a large
    category nor a band ends up in one task.
    """
    sums = totals(
        orders,
        ["category", "discount_band"],
        "transactions", "units", "revenue", "discount_sum", "discount_rows",
    )
    return sums.withColumns(
        {
            "avg_discount_pct": avg_discount(),
            "revenue_per_transaction": revenue_per_order(),
            "revenue_per_unit": revenue_per_unit(),
            "units_per_transaction": ratio(F.col("units"), F.col("transactions")),
        }
    )


def _best_band(orders: DataFrame, by: str) -> DataFrame:
    best_first = Window.partitionBy("category").orderBy(F.desc(by), "discount_band")
    best = _band_performance(orders).withColumn("place", F.row_number().over(best_first))
    return (
        best.where("place = 1")
        .orderBy(F.desc(by), "category")
        .select(
            "category",
            F.col("discount_band").alias("optimal_discount_band"),
            rnd(F.col("avg_discount_pct"), 2).alias("avg_discount_pct_in_band"),
            F.col("transactions").alias("total_transactions"),
            F.col("units").alias("total_units"),
            F.col("revenue").alias("total_revenue"),
            rnd(F.col("revenue_per_transaction"), 2).alias("revenue_per_transaction"),
            rnd(F.col("revenue_per_unit"), 2).alias("revenue_per_unit"),
        )
    )


def best_band_by_revenue(orders: DataFrame) -> DataFrame:
    """The discount band with the highest revenue, per category."""
    return _best_band(orders, "revenue")


def best_band_by_revenue_per_order(orders: DataFrame) -> DataFrame:
    """The discount band with the highest revenue per order, per category."""
    return _best_band(orders, "revenue_per_transaction")


def cannibalisation(orders: DataFrame) -> DataFrame:
    """Each discount band against the next shallower one of its category."""
    deeper = Window.partitionBy("category").orderBy("avg_discount_pct", "discount_band")
    bands = _band_performance(orders)
    rpt, rpu, upt = (
        F.col(c) for c in ("revenue_per_transaction", "revenue_per_unit", "units_per_transaction")
    )
    bands = bands.withColumns({f"prev_{n}": F.lag(c).over(deeper)
                               for n, c in (("rpt", rpt), ("rpu", rpu), ("upt", upt))})
    order_value_down = rpt < F.col("prev_rpt")
    more_units = upt > F.col("prev_upt")
    flag = (
        F.when(more_units & order_value_down & (rpu < F.col("prev_rpu")), "Cannibalisation Risk")
        .when(more_units & order_value_down, "Volume Up, Order Value Down")
        .when(~more_units & order_value_down, "Deeper Discount, No Demand Gain")
        .otherwise("No Clear Cannibalisation")
    )

    def change(now: Column, name: str) -> Column:
        return rnd(100 * (ratio(now, F.col(f"prev_{name}")) - 1), 2).alias(f"{name}_change_pct")

    return bands.orderBy("category", "avg_discount_pct").select(
        "category",
        "discount_band",
        rnd(F.col("avg_discount_pct"), 2).alias("avg_discount_pct"),
        F.col("transactions").alias("total_transactions"),
        F.col("units").alias("total_units"),
        F.col("revenue").alias("total_revenue"),
        rnd(upt, 2).alias("units_per_transaction"),
        rnd(rpt, 2).alias("revenue_per_transaction"),
        rnd(rpu, 2).alias("revenue_per_unit"),
        change(upt, "upt"),
        change(rpt, "rpt"),
        change(rpu, "rpu"),
        flag.alias("cannibalization_flag"),
    )


def monthly_elasticity(orders: DataFrame) -> DataFrame:
    """Unit change over price change, month on month, per category."""
    monthly = totals(orders, ["month_start", "category"], "units", "net").withColumn(
        "price", weighted_price()
    )
    by_month = Window.partitionBy("category").orderBy("month_start")
    units, price = F.col("units"), F.col("price")
    before, price_before = F.col("prev_units"), F.col("prev_price")
    changed = monthly.withColumns(
        {"prev_units": F.lag("units").over(by_month), "prev_price": F.lag("price").over(by_month)}
    ).where("prev_units IS NOT NULL AND prev_price IS NOT NULL")
    return changed.select(
        "month_start",
        "category",
        "units",
        rnd(price, 2).alias("w_avg_final_price"),
        rnd(pct_change(units, before), 2).alias("units_change_pct"),
        rnd(pct_change(price, price_before), 2).alias("price_change_pct"),
        rnd(ratio(rel_change(units, before), rel_change(price, price_before)), 3).alias(
            "elasticity_proxy"
        ),
    ).orderBy("category", "month_start")


def margin_risk_pockets(orders: DataFrame, top: int = 30) -> DataFrame:
    """The `top` revenue ranks, scored by revenue rank plus realization rank."""
    keys = ["state_name", "category", "brand_type", "sales_event"]
    sums = totals(orders, keys, "revenue", "units", "discount_sum", "discount_rows", "net", "gross")
    segments = sums.select(
        *keys,
        "revenue",
        "units",
        rnd(avg_discount(), 2).alias("avg_discount"),
        rnd(realization(), 3).alias("realization_ratio"),
        rnd(revenue_per_unit(), 2).alias("revenue_per_unit"),
    )
    ranked = with_global_ranks(
        segments,
        dense={
            "revenue_rank": [("revenue", "desc")],
            "margin_risk_rank": [("realization_ratio", "asc")],
        },
    )
    score = F.col("revenue_rank") + F.col("margin_risk_rank")
    return (
        ranked.where(F.col("revenue_rank") <= top)
        .select(*segments.columns, score.alias("risk_priority_score"))
        .orderBy("risk_priority_score", F.desc("revenue"), *keys)
    )
