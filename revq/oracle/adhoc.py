"""The ad-hoc queries."""

from __future__ import annotations

from revq.oracle.parts import (
    AVG_DISCOUNT,
    ORDERS,
    PRICE,
    REAL,
    REV,
    RPU,
    UNITS,
    avg,
    change,
    div,
    pct,
    query,
    rnd,
)


def _of(event: str, value: str) -> str:
    return f"max(CASE WHEN sales_event = '{event}' THEN {value} END)"


def _lift(festival: str, normal: str) -> str:
    return rnd(f"100 * ({div(festival, normal)} - 1)", 2)


def _per_order(keys: str) -> str:
    group = f"{keys}, " if keys else ""
    lift = _lift(_of("Festival", "per_order"), _of("Normal", "per_order"))
    columns = [
        f"""{_of(e, 'rev')} AS {e}_revenue, {_of(e, 'orders')} AS {e}_transactions,
        {rnd(_of(e, 'per_order'), 2)} AS {e}_revenue_per_transaction"""
        for e in ("Festival", "Normal")
    ]
    inner = f"""SELECT {group}sales_event, {REV} AS rev, {ORDERS} AS orders, {div(REV, ORDERS)} AS per_order
        FROM sales GROUP BY {group}sales_event"""
    return f"""SELECT {group}{', '.join(columns)}, {lift} AS revenue_per_transaction_lift_pct
        FROM ({inner}) {'GROUP BY ' + keys if keys else ''}"""


_PER_ORDER_COLUMNS = """festival_revenue:d festival_transactions:b festival_revenue_per_transaction:d
    normal_revenue:d normal_transactions:b normal_revenue_per_transaction:d
    revenue_per_transaction_lift_pct:d"""

_BANDS = f"""bands AS (SELECT category, discount_band, {ORDERS} AS orders, {UNITS} AS units, {REV} AS rev,
    {AVG_DISCOUNT} AS disc, {div(REV, ORDERS)} AS rpt, {RPU} AS rpu, {div(UNITS, ORDERS)} AS upt
    FROM sales GROUP BY category, discount_band)"""


def _best_band(by: str) -> str:
    return query(
        """category optimal_discount_band avg_discount_pct_in_band:d total_transactions:b total_units:b
        total_revenue:d revenue_per_transaction:d revenue_per_unit:d""",
        f"""SELECT category, discount_band AS optimal_discount_band, {rnd('disc', 2)} AS avg_discount_pct_in_band,
        orders AS total_transactions, units AS total_units, rev AS total_revenue,
        {rnd('rpt', 2)} AS revenue_per_transaction, {rnd('rpu', 2)} AS revenue_per_unit
        FROM bands QUALIFY row_number() OVER (PARTITION BY category ORDER BY {by} DESC, discount_band) = 1""",
        _BANDS,
    )


def _step(name: str) -> str:
    return rnd(f"100 * ({div(name, 'prev_' + name)} - 1)", 2) + f" AS {name}_change_pct"


def queries() -> dict[str, str]:
    return {
        "Q01_top_states": query(
            "state_name zone total_revenue:d",
            f"""SELECT state_name, zone, {REV} AS total_revenue FROM sales GROUP BY state_name, zone
            ORDER BY total_revenue DESC, state_name LIMIT 5""",
        ),
        "Q02_revenue_by_state_and_age": query(
            "state_name customer_age_group total_revenue:d revenue_quartile:b",
            """SELECT *, ntile(4) OVER (PARTITION BY customer_age_group ORDER BY total_revenue, state_name)
            AS revenue_quartile FROM g""",
            f"""g AS (SELECT state_name, customer_age_group, {REV} AS total_revenue FROM sales
            GROUP BY state_name, customer_age_group)""",
        ),
        "Q03_incentive_sensitivity": query(
            "category brand_type sensitivity_group units:b unit_share:d",
            f"""SELECT *, {rnd(div('units', 'sum(units) OVER (PARTITION BY category, brand_type)'), 4)}
            AS unit_share FROM g""",
            f"""g AS (SELECT category, brand_type, CASE WHEN discount_percent <= 10 THEN 'Low Incentive'
            WHEN discount_percent <= 30 THEN 'Moderate Incentive' ELSE 'High Incentive' END AS sensitivity_group,
            {UNITS} AS units FROM sales GROUP BY ALL)""",
        ),
        "Q04_revenue_loss_by_band": query(
            "discount_range revenue:d units:b revenue_forfeited:d",
            f"""SELECT discount_band AS discount_range, {REV} AS revenue, {UNITS} AS units,
            sum(cast(base_price * units_sold * discount_percent * cast(0.01 AS decimal(3,2)) AS decimal(20,2)))
            AS revenue_forfeited FROM sales GROUP BY discount_band""",
        ),
        "Q05_event_revenue_per_order": query(_PER_ORDER_COLUMNS, _per_order("")),
        "Q06_event_revenue_per_order_by_category": query(
            "category " + _PER_ORDER_COLUMNS, _per_order("category")
        ),
        "Q07_festival_lift": query(
            """category brand_type festival_avg_monthly_revenue:d normal_avg_monthly_revenue:d
            festival_lift_pct:d""",
            f"""SELECT category, brand_type, {rnd(_of('Festival', 'm'), 2)} AS festival_avg_monthly_revenue,
            {rnd(_of('Normal', 'm'), 2)} AS normal_avg_monthly_revenue,
            {_lift(_of('Festival', 'm'), _of('Normal', 'm'))} AS festival_lift_pct
            FROM means GROUP BY category, brand_type""",
            f"""daily AS (SELECT category, brand_type, sales_event, order_date, {REV} AS rev FROM sales
            GROUP BY ALL)""",
            f"""means AS (SELECT category, brand_type, sales_event, {avg('rev')} AS m FROM daily GROUP BY ALL)""",
        ),
        "Q08_festival_lift_and_discount": query(
            """category festival_avg_monthly_revenue:d normal_avg_monthly_revenue:d festival_lift_pct:d
            festival_avg_discount:d normal_avg_discount:d""",
            f"""SELECT category, {rnd(_of('Festival', 'm'), 2)} AS festival_avg_monthly_revenue,
            {rnd(_of('Normal', 'm'), 2)} AS normal_avg_monthly_revenue,
            {_lift(_of('Festival', 'm'), _of('Normal', 'm'))} AS festival_lift_pct,
            {rnd(_of('Festival', 'md'), 2)} AS festival_avg_discount,
            {rnd(_of('Normal', 'md'), 2)} AS normal_avg_discount FROM means GROUP BY category""",
            f"""daily AS (SELECT category, sales_event, order_date, {REV} AS rev, {AVG_DISCOUNT} AS disc
            FROM sales GROUP BY ALL)""",
            f"""means AS (SELECT category, sales_event, {avg('rev')} AS m, {avg('disc')} AS md FROM daily
            GROUP BY ALL)""",
        ),
        "Q09_best_band_by_revenue": _best_band("rev"),
        "Q10_best_band_by_revenue_per_order": _best_band("rpt"),
        "Q11_cannibalisation": query(
            """category discount_band avg_discount_pct:d total_transactions:b total_units:b total_revenue:d
            units_per_transaction:d revenue_per_transaction:d revenue_per_unit:d upt_change_pct:d
            rpt_change_pct:d rpu_change_pct:d cannibalization_flag""",
            f"""SELECT category, discount_band, {rnd('disc', 2)} AS avg_discount_pct,
            orders AS total_transactions, units AS total_units, rev AS total_revenue,
            {rnd('upt', 2)} AS units_per_transaction, {rnd('rpt', 2)} AS revenue_per_transaction,
            {rnd('rpu', 2)} AS revenue_per_unit, {_step('upt')}, {_step('rpt')}, {_step('rpu')},
            CASE WHEN rpt < prev_rpt AND upt > prev_upt AND rpu < prev_rpu THEN 'Cannibalisation Risk'
                 WHEN rpt < prev_rpt AND upt > prev_upt THEN 'Volume Up, Order Value Down'
                 WHEN rpt < prev_rpt AND upt <= prev_upt THEN 'Deeper Discount, No Demand Gain'
                 ELSE 'No Clear Cannibalisation' END AS cannibalization_flag FROM steps""",
            _BANDS,
            """steps AS (SELECT *, lag(rpt) OVER w AS prev_rpt, lag(rpu) OVER w AS prev_rpu,
            lag(upt) OVER w AS prev_upt FROM bands
            WINDOW w AS (PARTITION BY category ORDER BY disc, discount_band))""",
        ),
        "Q12_monthly_elasticity": query(
            """month_start category units:b w_avg_final_price:d units_change_pct:d price_change_pct:d
            elasticity_proxy:d""",
            f"""SELECT month_start, category, units, {rnd('price', 2)} AS w_avg_final_price,
            {rnd(pct('units', 'pu'), 2)} AS units_change_pct, {rnd(pct('price', 'pp'), 2)} AS price_change_pct,
            {rnd(div(change('units', 'pu'), change('price', 'pp')), 3)} AS elasticity_proxy
            FROM lagged WHERE pu IS NOT NULL AND pp IS NOT NULL""",
            f"""monthly AS (SELECT month_start, category, {UNITS} AS units, {PRICE} AS price FROM sales
            GROUP BY ALL)""",
            """lagged AS (SELECT *, lag(units) OVER w AS pu, lag(price) OVER w AS pp FROM monthly
            WINDOW w AS (PARTITION BY category ORDER BY month_start))""",
        ),
        "Q13_margin_risk_pockets": query(
            """state_name category brand_type sales_event revenue:d units:b avg_discount:d realization_ratio:d
            revenue_per_unit:d risk_priority_score:b""",
            """SELECT *, rr + mr AS risk_priority_score FROM (
            SELECT *, dense_rank() OVER (ORDER BY revenue DESC NULLS LAST) AS rr,
            dense_rank() OVER (ORDER BY realization_ratio ASC NULLS FIRST) AS mr FROM seg) WHERE rr <= 30""",
            f"""seg AS (SELECT state_name, category, brand_type, sales_event, {REV} AS revenue,
            {UNITS} AS units, {rnd(AVG_DISCOUNT, 2)} AS avg_discount, {rnd(REAL, 3)} AS realization_ratio,
            {rnd(RPU, 2)} AS revenue_per_unit FROM sales GROUP BY state_name, category, brand_type, sales_event)""",
        ),
    }
