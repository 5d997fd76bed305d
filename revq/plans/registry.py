"""Every report by its id, over the parquet tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revq.functions.labels import register_sql_functions
from revq.plans import adhoc, cells, model, procedures, views, whatif
from revq.schema import FACT_ORDERS
from revq.session import materialise, new_path
from revq.sources import files
from revq.sources.tables import stg_orders

# States of the test tables that stand for the catalogue's lower-tier states.
LOWER_TIER_STATES = ("NATION_3", "NATION_11", "NATION_20")
STATE = "NATION_7"
REFRESHED_YEARS = (1995, 1996)
SECOND_LOAD_FROM = "1995-06-15"


def _reimported(staging: DataFrame) -> DataFrame:
    path = new_path(staging.sparkSession)
    files.write_csv(staging, path)
    return files.read_orders_csv(staging.sparkSession, path)


def _import_with_rejects(staging: DataFrame) -> DataFrame:
    """Every order of a file in which some cells are spoiled, with the reasons of those not imported."""
    path = new_path(staging.sparkSession)
    spoiled = staging.withColumns(
        {
            "order_date": F.when(F.col("units_sold") % 11 == 0, "soon").otherwise(F.col("order_date").cast("string")),
            "units_sold": F.when(F.col("customer_age") % 7 == 0, "many").otherwise(F.col("units_sold").cast("string")),
        }
    )
    files.write_csv(spoiled, path)
    orders, rejects = files.import_orders_csv(staging.sparkSession, path)
    return orders.select("order_id", F.lit(None).cast("string").alias("reasons")).unionByName(
        rejects.select(F.split("line", ",")[0].alias("order_id"), F.array_join("reasons", ", ").alias("reasons"))
    )


def _written_facts(staging: DataFrame) -> DataFrame:
    path = new_path(staging.sparkSession)
    model.write_star(model.star(staging), path)
    facts = staging.sparkSession.read.parquet(f"{path}/fact_orders")
    return facts.select(FACT_ORDERS.names)


def _appended_facts(staging: DataFrame) -> DataFrame:
    """The facts after two loads, the later orders second; the second is sent twice."""
    staging = materialise(staging)  # each load reads its orders twice
    path = new_path(staging.sparkSession)
    later = F.col("order_date") >= F.lit(SECOND_LOAD_FROM).cast("date")
    model.load(staging.where(~later), path, "first")
    model.load(staging.where(later), path, "second")
    return model.load(staging.where(later), path, "second")["fact_orders"].select(FACT_ORDERS.names)


FROM_STAGING = {
    "S01_csv_import": _reimported,
    "S02_import_with_rejects": _import_with_rejects,
    "S06_appended_facts": _appended_facts,
    "S07_written_facts": _written_facts,
    "D01_dim_date": model.dim_date,
    "D02_dim_state": model.dim_state,
    "D03_dim_product": model.dim_product,
    "D04_dim_customer_demo": model.dim_customer_demo,
    "D05_dim_event": model.dim_event,
    "D06_fact_orders": lambda staging: model.star(staging)["fact_orders"],
    "D07_constraint_report": model.load_report,
    "D08_load_checks": model.load_checks,
}

# View names as a user would write them in SQL.
VIEWS = {
    "V01_monthly_revenue_summary": views.monthly_revenue_summary,
    "V02_event_uplift_by_category": views.event_uplift_by_category,
    "V03_monthly_discount_band": views.monthly_discount_band,
    "V04_discount_band_performance": views.discount_band_performance,
    "V05_discount_response_quality": views.discount_response_quality,
    "V06_price_sensitivity_by_segment": views.price_sensitivity_by_segment,
    "V07_state_growth": views.state_growth,
    "V08_revenue_concentration_geo": views.revenue_concentration_geo,
    "V09_inventory_pricing_pressure": views.inventory_pricing_pressure,
    "V10_revenue_quality_risk_hotspots": views.revenue_quality_risk_hotspots,
    "V11_risk_adjusted_performance": views.risk_adjusted_performance,
    "V12_risk_adjusted_summary": views.risk_adjusted_summary,
    "V13_competition_discount_performance": views.competition_discount_performance,
    "V14_pricing_intelligence": views.pricing_intelligence,
}


def _rows(changed: DataFrame) -> DataFrame:
    """The columns a repricing changes, unrounded."""
    return changed.select("order_id", "discount_percent", "final_price", "units_sold", "revenue")


def _mass_cap(orders: DataFrame) -> DataFrame:
    mask = (F.col("brand_type") == "Mass") & (F.col("discount_percent") > 40)
    return _rows(whatif.discount_change(orders, mask, 40, 0.8))


def _more_volume(orders: DataFrame) -> DataFrame:
    return _rows(whatif.volume_growth(orders, F.col("state_name").isin(*LOWER_TIER_STATES), 20))


def _shifted_spend(orders: DataFrame) -> DataFrame:
    festival, normal = (F.col("sales_event") == event for event in ("Festival", "Normal"))
    return _rows(whatif.reallocation(orders, (festival, 10, 0.5), (normal, 3, 0.3)))


def _by_sql_functions(orders: DataFrame) -> DataFrame:
    register_sql_functions(orders.sparkSession)
    return orders.sparkSession.sql(
        """SELECT discount_band(discount_percent) AS discount_range, sum(revenue) AS revenue,
        sum(units_sold) AS units,
        sum(revenue_loss(base_price, discount_percent, units_sold)) AS revenue_forfeited
        FROM {orders} GROUP BY 1""",
        orders=orders,
    )


def _refreshed(orders: DataFrame) -> DataFrame:
    path = new_path(orders.sparkSession)
    procedures.refresh_monthly_summary(orders, path)
    return procedures.refresh_monthly_summary(orders, path, years=REFRESHED_YEARS)


def _refreshed_by_month(orders: DataFrame) -> DataFrame:
    """The summary after orders have come, gone and changed between refreshes that find the changed months."""
    path = new_path(orders.sparkSession)
    late, festival = F.col("order_date") >= F.lit(SECOND_LOAD_FROM).cast("date"), F.col("sales_event") == "Festival"
    more = orders.withColumn("units_sold", F.when(festival, F.col("units_sold") + 1).otherwise(F.col("units_sold")))
    procedures.refresh_changed_months(more.where(~late), path)
    return procedures.refresh_changed_months(orders, path)[0]


def _cannibalisation_from_cells(orders: DataFrame) -> DataFrame:
    """Distinct orders by bitmaps that two loads have written; the second replaces the month where the first ends."""
    # Read once for the months and three times in each load.
    orders = materialise(orders.select("order_date", *cells.COLUMNS))
    path = new_path(orders.sparkSession)
    split = F.lit(SECOND_LOAD_FROM).cast("date")
    cells.refresh(orders.where(F.col("order_date") < split), path)
    late = F.col("month_start") >= F.trunc(split, "MM")
    months = [r.month_start for r in orders.where(late).select("month_start").distinct().collect()]
    return adhoc.cannibalisation(cells.refresh(orders, path, months))


def _summary_from_cells(orders: DataFrame) -> DataFrame:
    orders = materialise(orders.select(cells.COLUMNS))  # read three times in the load
    return views.risk_adjusted_summary(cells.refresh(orders, new_path(orders.sparkSession)))


def _results(orders: DataFrame) -> DataFrame:
    return whatif.results(orders, whatif.catalogue(LOWER_TIER_STATES))


FROM_ORDERS = {
    "Q01_top_states": adhoc.top_states,
    "Q02_revenue_by_state_and_age": adhoc.revenue_by_state_and_age,
    "Q03_incentive_sensitivity": adhoc.incentive_sensitivity,
    "Q04_revenue_loss_by_band": adhoc.revenue_loss_by_band,
    "Q05_event_revenue_per_order": adhoc.event_revenue_per_order,
    "Q06_event_revenue_per_order_by_category": adhoc.event_revenue_per_order_by_category,
    "Q07_festival_lift": adhoc.festival_lift,
    "Q08_festival_lift_and_discount": adhoc.festival_lift_and_discount,
    "Q09_best_band_by_revenue": adhoc.best_band_by_revenue,
    "Q10_best_band_by_revenue_per_order": adhoc.best_band_by_revenue_per_order,
    "Q11_cannibalisation": adhoc.cannibalisation,
    "Q12_monthly_elasticity": adhoc.monthly_elasticity,
    "Q13_margin_risk_pockets": adhoc.margin_risk_pockets,
    **VIEWS,
    "A03_counts_from_cells": _cannibalisation_from_cells,
    "S09_views_from_cells": _summary_from_cells,
    "P01_monthly_summary": procedures.monthly_summary,
    "U01_sql_functions": _by_sql_functions,
    "U03_refreshed_summary": _refreshed,
    "U03_refreshed_by_month": _refreshed_by_month,
    "P02_state_performance": lambda orders: procedures.state_performance(orders, STATE),
    "R01_discount_change": _mass_cap,
    "R02_volume_growth": _more_volume,
    "R03_reallocation": _shifted_spend,
    "R04_scenario_results": _results,
    "R05_whatif_parameters": lambda orders: whatif.parameters(whatif.whatif_orders(orders)),
    "R07_ranked_summary": lambda orders: whatif.ranked(_results(orders)),
    "R08_by_sim_type": lambda orders: whatif.by_sim_type(_results(orders)),
    "R09_portfolio": lambda orders: whatif.portfolio(_results(orders)),
}


def portable(df: DataFrame) -> DataFrame:
    """Decimals as DOUBLE and all integers as BIGINT, to compare across engines."""

    def cast(field: T.StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.IntegralType):
            column = column.cast("bigint")
        return column.alias(field.name)

    return df.select([cast(field) for field in df.schema])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def over_staging(report):
        return lambda spark, folder: portable(report(stg_orders(spark, folder)))

    def over_orders(report):
        return lambda spark, folder: portable(report(model.enrich(stg_orders(spark, folder))))

    return {k: over_staging(r) for k, r in FROM_STAGING.items()} | {
        k: over_orders(r) for k, r in FROM_ORDERS.items()
    }


# Views with ranks over all rows: numbering needs jobs, so they are written, not defined.
RANKED_VIEWS = (
    "V10_revenue_quality_risk_hotspots", "V12_risk_adjusted_summary", "V14_pricing_intelligence",
)


def _view_name(key: str) -> str:
    return f"v_{key.split('_', 1)[1]}"


def register_views(orders: DataFrame, tables: dict[str, DataFrame] | None = None) -> list[str]:
    """Register views, star tables if given, and the SQL functions; return the names of the views.

    Nothing runs until a view is read. The three views of RANKED_VIEWS are left to
    `refresh_ranked_views`.
    """
    register_sql_functions(orders.sparkSession)
    named = {_view_name(k): report(orders) for k, report in VIEWS.items() if k not in RANKED_VIEWS}
    named |= tables or {}
    for name, df in named.items():
        df.createOrReplaceTempView(name)
    return list(named)


def refresh_ranked_views(orders: DataFrame) -> list[str]:
    """Compute the ranked views as of now and register the results; return their names."""
    for key in RANKED_VIEWS:
        materialise(VIEWS[key](orders)).createOrReplaceTempView(_view_name(key))
    return [_view_name(key) for key in RANKED_VIEWS]
