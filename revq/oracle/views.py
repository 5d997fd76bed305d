"""The views and procedures."""

from __future__ import annotations

from revq.oracle.parts import (
    AVG_DISCOUNT,
    COST,
    DISC,
    GROSS,
    NET,
    PRICE,
    REAL,
    REV,
    RPU,
    UNITS,
    WAVG,
    avg,
    change,
    div,
    pct,
    query,
    rnd,
)

_RISK_COLUMNS = """state_name category brand_type total_revenue:d total_units:b avg_discount:d
    realization_ratio:d revenue_per_unit:d festival_revenue:d festival_units:b
    avg_abs_revenue_change_pct:d avg_abs_units_change_pct:d discount_dependency_score:d
    demand_volatility_score:d festival_dependency_score:d overall_risk_score:d risk_segment"""

_RISK = (
    f"""ev AS (SELECT state_name, category, brand_type, month_start, sales_event, {REV} AS revenue,
    {UNITS} AS units, {rnd(WAVG, 2)} AS disc, {rnd(REAL, 3)} AS realz FROM sales
    GROUP BY state_name, category, brand_type, month_start, sales_event)""",
    f"""mon AS (SELECT state_name, category, brand_type, month_start, sum(revenue) AS mrev,
    sum(units) AS munits, {rnd(avg('disc', 2), 2)} AS mdisc, {rnd(avg('realz', 3), 3)} AS mreal,
    sum(CASE WHEN lower(sales_event) = 'festival' THEN revenue ELSE 0 END) AS frev,
    sum(CASE WHEN lower(sales_event) = 'festival' THEN units ELSE 0 END) AS funits
    FROM ev GROUP BY state_name, category, brand_type, month_start)""",
    f"""vol AS (SELECT *, {rnd('abs(' + pct('mrev', 'lag(mrev) OVER w') + ')', 2)} AS rchg,
    {rnd('abs(' + pct('munits', 'lag(munits) OVER w') + ')', 2)} AS uchg FROM mon
    WINDOW w AS (PARTITION BY state_name, category, brand_type ORDER BY month_start))""",
    f"""seg AS (SELECT state_name, category, brand_type, sum(mrev) AS total_revenue,
    sum(munits) AS total_units, {rnd(avg('mdisc', 2), 2)} AS avg_discount,
    {rnd(avg('mreal', 3), 3)} AS realization_ratio, {rnd(div('sum(mrev)', 'sum(munits)'), 2)} AS revenue_per_unit,
    sum(frev) AS festival_revenue, sum(funits) AS festival_units,
    {rnd(avg('rchg', 2), 2)} AS avg_abs_revenue_change_pct, {rnd(avg('uchg', 2), 2)} AS avg_abs_units_change_pct
    FROM vol GROUP BY state_name, category, brand_type)""",
    f"""scores AS (SELECT *,
    {rnd('avg_discount * 0.5 + (1 - realization_ratio) * 100 * 0.5', 2)} AS discount_dependency_score,
    {rnd('coalesce(avg_abs_revenue_change_pct, 0) * 0.5 + coalesce(avg_abs_units_change_pct, 0) * 0.5', 2)}
    AS demand_volatility_score,
    {rnd('cast(festival_revenue AS double) * 100.0 / nullif(cast(total_revenue AS double), 0)', 2)}
    AS festival_dependency_score FROM seg)""",
    f"""scored AS (SELECT *, {rnd('''discount_dependency_score * 0.40 + demand_volatility_score * 0.35
    + festival_dependency_score * 0.25''', 2)} AS overall_risk_score FROM scores)""",
    """risk AS (SELECT *, CASE WHEN overall_risk_score >= 45 THEN 'High-Risk Revenue Pocket'
    WHEN discount_dependency_score >= 35 THEN 'Discount-Dependent'
    WHEN demand_volatility_score >= 35 THEN 'Volatile Growth'
    WHEN festival_dependency_score >= 50 THEN 'Festival-Reliant' ELSE 'Stable Core' END AS risk_segment
    FROM scored)""",
)


def _dense(column: str, way: str = "DESC NULLS LAST") -> str:
    return f"dense_rank() OVER (ORDER BY {column} {way})"


def _pressure(key: str, more: str = "") -> str:
    return f"""SELECT category, brand_type, {key}, discount_band, {UNITS} AS total_units,
        {REV} AS total_revenue, {rnd(WAVG, 2)} AS avg_discount_percent, {rnd(RPU, 2)} AS revenue_per_unit,
        {GROSS} AS gross_base_revenue, {COST} AS total_discount_cost,
        {rnd(div(COST, REV), 4)} AS discount_cost_ratio, {rnd(REAL, 4)} AS realization_ratio{more}
        FROM sales GROUP BY category, brand_type, {key}, discount_band"""


def _pressure_columns(key: str) -> str:
    return f"""category brand_type {key} discount_band total_units:b total_revenue:d avg_discount_percent:d
        revenue_per_unit:d gross_base_revenue:d total_discount_cost:d discount_cost_ratio:d realization_ratio:d"""


def _level(level: str, value: str) -> str:
    return f"max(CASE WHEN lvl = '{level.upper()}' THEN {value} END)"


def queries() -> dict[str, str]:
    product = "category, brand_type"
    response = div(change("units", "pu"), change("disc", "pd"))
    elasticity = div(
        change("high_discount_units", "low_discount_units"),
        change("high_discount_price", "low_discount_price"),
    )
    move = f"abs({div(change('units', 'pu'), change('price', 'pp'))})"
    slope = div("n * sxy - sx * sy", "n * sxx - sx * sx")
    return {
        "V01_monthly_revenue_summary": query(
            """month_start total_revenue:d total_units:b w_avg_discount:d prev_units:b prev_revenue:d
            unit_growth_pct:d revenue_growth_pct:d""",
            f"""SELECT *, {rnd(pct('total_units', 'prev_units'), 2)} AS unit_growth_pct,
            {rnd(pct('total_revenue', 'prev_revenue'), 2)} AS revenue_growth_pct FROM (
            SELECT *, lag(total_units) OVER (ORDER BY month_start) AS prev_units,
            lag(total_revenue) OVER (ORDER BY month_start) AS prev_revenue FROM m)""",
            f"""m AS (SELECT month_start, {REV} AS total_revenue, {UNITS} AS total_units,
            {rnd(WAVG, 2)} AS w_avg_discount FROM sales GROUP BY month_start)""",
        ),
        "V02_event_uplift_by_category": query(
            """month_start category brand_type sales_event total_revenue:d total_units:b
            avg_discount_percent:d normal_avg_revenue:d normal_avg_units:d revenue_uplift_vs_normal:d
            unit_uplift_vs_normal:d""",
            f"""SELECT m.*, normal_avg_revenue, normal_avg_units,
            {rnd('cast(total_revenue AS double) - normal_avg_revenue', 2)} AS revenue_uplift_vs_normal,
            {rnd('cast(total_units AS double) - normal_avg_units', 2)} AS unit_uplift_vs_normal
            FROM m JOIN b USING (category, brand_type)""",
            f"""m AS (SELECT month_start, category, brand_type, sales_event, {REV} AS total_revenue,
            {UNITS} AS total_units, {rnd(WAVG, 0)} AS avg_discount_percent FROM sales
            GROUP BY month_start, category, brand_type, sales_event)""",
            f"""b AS (SELECT category, brand_type, {div('sum(total_revenue)', 'count(*)')} AS normal_avg_revenue,
            {div('sum(total_units)', 'count(*)')} AS normal_avg_units FROM m WHERE sales_event = 'Normal'
            GROUP BY category, brand_type)""",
        ),
        "V03_monthly_discount_band": query(
            """year:b month:b month_start discount_band total_revenue:d total_units:b revenue_per_unit:d
            w_avg_discount:d""",
            f"""SELECT year, month, month_start, discount_band, {REV} AS total_revenue,
            {UNITS} AS total_units, {rnd(RPU, 2)} AS revenue_per_unit, {rnd(WAVG, 2)} AS w_avg_discount
            FROM sales GROUP BY year, month, month_start, discount_band""",
        ),
        "V04_discount_band_performance": query(
            """month_start category brand_type zone discount_range total_units:b total_revenue:d
            gross_base_revenue:d total_discount_cost:d discount_cost_ratio:d avg_discount_percent:d
            avg_final_price:d""",
            f"""SELECT month_start, category, brand_type, zone, discount_band AS discount_range,
            {UNITS} AS total_units, {REV} AS total_revenue, {GROSS} AS gross_base_revenue,
            {COST} AS total_discount_cost, {rnd(div(COST, REV), 4)} AS discount_cost_ratio,
            {rnd(WAVG, 4)} AS avg_discount_percent, {rnd(PRICE, 2)} AS avg_final_price
            FROM sales GROUP BY month_start, category, brand_type, zone, discount_band""",
        ),
        "V05_discount_response_quality": query(
            """category brand_type zone sales_event observations:b discount_up_units_up:b
            discount_down_units_down:b positive_response_rate:d avg_response_ratio:d""",
            f"""SELECT category, brand_type, zone, sales_event, count(*) AS observations,
            count(*) FILTER (disc > pd AND units > pu) AS discount_up_units_up,
            count(*) FILTER (disc < pd AND units < pu) AS discount_down_units_down,
            {rnd(div('count(*) FILTER (disc > pd AND units > pu)', 'count(*)'), 2)} AS positive_response_rate,
            {rnd(avg('resp'), 4)} AS avg_response_ratio
            FROM (SELECT *, {response} AS resp FROM lagged) GROUP BY category, brand_type, zone, sales_event""",
            f"""m AS (SELECT month_start, category, brand_type, zone, sales_event, {rnd(WAVG, 2)} AS disc,
            {UNITS} AS units FROM sales GROUP BY month_start, category, brand_type, zone, sales_event)""",
            """lagged AS (SELECT *, lag(disc) OVER w AS pd, lag(units) OVER w AS pu FROM m
            WINDOW w AS (PARTITION BY category, brand_type, zone, sales_event ORDER BY month_start))""",
        ),
        "V06_price_sensitivity_by_segment": query(
            """category brand_type state_name customer_age_group low_discount_price:d mid_discount_price:d
            high_discount_price:d low_discount_units:b mid_discount_units:b high_discount_units:b
            low_discount_revenue:d mid_discount_revenue:d high_discount_revenue:d elasticity_proxy:d
            sensitivity_segment""",
            f"""SELECT *, CASE WHEN abs(elasticity_proxy) >= 1 THEN 'Highly Sensitive'
            WHEN abs(elasticity_proxy) >= 0.5 THEN 'Moderately Sensitive' ELSE 'Low Sensitivity' END
            AS sensitivity_segment FROM (SELECT *, {rnd(elasticity, 4)} AS elasticity_proxy FROM wide)""",
            f"""g AS (SELECT category, brand_type, state_name, customer_age_group,
            CASE WHEN discount_percent < 10 THEN 'LOW' WHEN discount_percent >= 40 THEN 'HIGH' ELSE 'MID' END AS lvl,
            {PRICE} AS price, {UNITS} AS units, {REV} AS rev FROM sales GROUP BY ALL)""",
            "wide AS (SELECT category, brand_type, state_name, customer_age_group, "
            + ", ".join(
                f"{_level(level, value)} AS {level}_discount_{name}"
                for value, name in (("price", "price"), ("units", "units"), ("rev", "revenue"))
                for level in ("low", "mid", "high")
            )
            + " FROM g GROUP BY category, brand_type, state_name, customer_age_group)",
        ),
        "V07_state_growth": query(
            """state_name year:b month_name month_start revenue:d prev_month_revenue:d mom_change:d
            mom_growth_pct:d""",
            f"""SELECT *, revenue - prev_month_revenue AS mom_change,
            {rnd(change('revenue', 'prev_month_revenue'), 4)} AS mom_growth_pct
            FROM (SELECT *, lag(revenue) OVER (PARTITION BY state_name ORDER BY month_start)
            AS prev_month_revenue FROM m)""",
            f"""m AS (SELECT state_name, year, month_name, month_start, {REV} AS revenue FROM sales
            GROUP BY state_name, year, month_name, month_start)""",
        ),
        "V08_revenue_concentration_geo": query(
            """month_start zone state_name total_revenue:d revenue_share:d cumulative_revenue_share:d""",
            f"""SELECT *, {rnd(div('total_revenue', 'sum(total_revenue) OVER (PARTITION BY month_start)'), 4)}
            AS revenue_share, {rnd(div('''sum(total_revenue) OVER (PARTITION BY month_start
            ORDER BY total_revenue DESC, state_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)''',
            'sum(total_revenue) OVER (PARTITION BY month_start)'), 4)} AS cumulative_revenue_share FROM m""",
            f"""m AS (SELECT month_start, zone, state_name, {REV} AS total_revenue FROM sales
            GROUP BY month_start, zone, state_name)""",
        ),
        "V09_inventory_pricing_pressure": query(
            _pressure_columns("inventory_pressure"), _pressure("inventory_pressure")
        ),
        "V10_revenue_quality_risk_hotspots": query(
            """month_start category brand_type state_name sales_event competition_intensity inventory_pressure
            total_revenue:d total_units:b avg_discount_percent:d total_discount_cost:d realization_ratio:d
            discount_cost_ratio:d revenue_rank:b margin_risk_rank:b""",
            f"""SELECT * EXCLUDE (realz), {rnd('realz', 4)} AS realization_ratio,
            {rnd('dcr', 4)} AS discount_cost_ratio, {_dense('total_revenue')} AS revenue_rank,
            dense_rank() OVER (ORDER BY dcr DESC NULLS LAST, realz ASC NULLS FIRST) AS margin_risk_rank FROM g""",
            f"""g AS (SELECT month_start, category, brand_type, state_name, sales_event, competition_intensity,
            inventory_pressure, {REV} AS total_revenue, {UNITS} AS total_units,
            {rnd(WAVG, 4)} AS avg_discount_percent, {COST} AS total_discount_cost, {REAL} AS realz,
            {div(COST, REV)} AS dcr FROM sales GROUP BY month_start, category, brand_type, state_name,
            sales_event, competition_intensity, inventory_pressure)""",
        ),
        "V11_risk_adjusted_performance": query(_RISK_COLUMNS, "SELECT * FROM risk", *_RISK),
        # The tiers, flags and action texts.
        "V12_risk_adjusted_summary": query(
            _RISK_COLUMNS
            + """ revenue_share_pct:d revenue_rank:b revenue_quartile:b realization_rank:b
            discount_dependency_rank:b volatility_rank:b festival_dependency_rank:b risk_rank:b risk_tier
            priority_flag strategic_action""",
            """SELECT *, CASE WHEN overall_risk_score >= 45 THEN 'High' WHEN overall_risk_score >= 30 THEN 'Medium'
            ELSE 'Low' END AS risk_tier,
            CASE WHEN revenue_quartile = 1 AND overall_risk_score >= 45 THEN 'Urgent Review'
            WHEN revenue_quartile = 1 AND overall_risk_score < 30 THEN 'Protect and Scale'
            WHEN revenue_quartile > 1 AND overall_risk_score >= 45 THEN 'Low-Value Risk'
            ELSE 'Monitor' END AS priority_flag,
            CASE WHEN revenue_quartile = 1 AND overall_risk_score >= 45
            THEN 'High revenue but elevated risk; reduce discount pressure and stabilize demand'
            WHEN revenue_quartile = 1 AND overall_risk_score < 30
            THEN 'Healthy revenue and low risk; protect margins and expand strategically'
            WHEN revenue_quartile > 1 AND overall_risk_score >= 45
            THEN 'Lower contribution but elevated risk; reassess discount strategy'
            WHEN risk_segment = 'Discount-Dependent'
            THEN 'Revenue relies heavily on discounting; improve price realization'
            WHEN risk_segment = 'Volatile Growth'
            THEN 'Demand fluctuations are high; improve forecasting and demand stability'
            WHEN risk_segment = 'Festival-Reliant'
            THEN 'Sales concentrated during festival periods; strengthen normal-period demand'
            ELSE 'Stable segment; maintain pricing discipline and monitor performance' END AS strategic_action
            FROM ranked""",
            *_RISK,
            f"""ranked AS (SELECT *, {rnd('''cast(total_revenue AS double) * 100.0
            / nullif(cast(sum(total_revenue) OVER () AS double), 0)''', 2)} AS revenue_share_pct,
            {_dense('total_revenue')} AS revenue_rank,
            ntile(4) OVER (ORDER BY total_revenue DESC, state_name, category, brand_type) AS revenue_quartile,
            {_dense('realization_ratio')} AS realization_rank,
            {_dense('discount_dependency_score')} AS discount_dependency_rank,
            {_dense('demand_volatility_score')} AS volatility_rank,
            {_dense('festival_dependency_score')} AS festival_dependency_rank,
            {_dense('overall_risk_score')} AS risk_rank FROM risk)""",
        ),
        "V13_competition_discount_performance": query(
            _pressure_columns("competition_intensity") + " w_avg_final_price:d",
            _pressure("competition_intensity", f", {rnd(PRICE, 2)} AS w_avg_final_price"),
        ),
        "V14_pricing_intelligence": query(
            """category brand_type revenue:d units:b revenue_share_pct:d avg_discount_pct:d revenue_per_unit:d
            realization_ratio:d discount_revenue_beta:d avg_abs_elasticity_proxy:d
            pct_months_price_down_units_up:d optimal_discount_band optimal_band_realization_ratio:d
            optimal_score:b revenue_rank:b margin_risk_rank:b sensitivity_rank:b""",
            f"""SELECT category, brand_type, revenue, units,
            {rnd('100 * cast(revenue AS double) / nullif(cast(sum(revenue) OVER () AS double), 0)', 2)}
            AS revenue_share_pct, {rnd('disc', 2)} AS avg_discount_pct,
            {rnd(div('revenue', 'units'), 2)} AS revenue_per_unit, {rnd('realz', 3)} AS realization_ratio,
            {rnd(slope, 3)} AS discount_revenue_beta, {rnd('el', 3)} AS avg_abs_elasticity_proxy,
            {rnd('100 * down', 1)} AS pct_months_price_down_units_up, discount_band AS optimal_discount_band,
            {rnd('band_real', 3)} AS optimal_band_realization_ratio, score AS optimal_score,
            {_dense('revenue')} AS revenue_rank, {_dense('realz', 'ASC NULLS FIRST')} AS margin_risk_rank,
            {_dense('el')} AS sensitivity_rank
            FROM totals LEFT JOIN elastic USING (category, brand_type) LEFT JOIN best USING (category, brand_type)""",
            f"""m AS (SELECT month_start, {product}, {REV} AS rev, {UNITS} AS units, {WAVG} AS disc,
            {PRICE} AS price, {REAL} AS realz FROM sales GROUP BY month_start, {product})""",
            f"""lagged AS (SELECT *, lag(units) OVER w AS pu, lag(price) OVER w AS pp FROM m
            WINDOW w AS (PARTITION BY {product} ORDER BY month_start))""",
            f"""elastic AS (SELECT {product}, {avg('el')} AS el,
            {div('count(*) FILTER (price < pp AND units > pu)', 'count(*)')} AS down
            FROM (SELECT *, {move} AS el FROM lagged WHERE pu IS NOT NULL AND pp IS NOT NULL) GROUP BY {product})""",
            f"""xy AS (SELECT *, cast(disc AS decimal(9,6)) AS x, cast(rev AS decimal(20,2)) AS y FROM m)""",
            f"""totals AS (SELECT {product}, sum(rev) AS revenue, sum(units) AS units, {avg('disc')} AS disc,
            {avg('realz')} AS realz, cast(count(*) AS double) AS n, cast(sum(x) AS double) AS sx,
            cast(sum(y) AS double) AS sy, cast(sum(x * x) AS double) AS sxx, cast(sum(x * y) AS double) AS sxy
            FROM xy GROUP BY {product})""",
            f"""bands AS (SELECT {product}, discount_band, {REV} AS rev, {REAL} AS band_real FROM sales
            GROUP BY {product}, discount_band)""",
            f"""best AS (SELECT *, row_number() OVER (PARTITION BY {product}
            ORDER BY score, rev DESC, band_real DESC NULLS LAST, discount_band) AS place FROM (
            SELECT *, dense_rank() OVER (PARTITION BY {product} ORDER BY rev DESC)
            + dense_rank() OVER (PARTITION BY {product} ORDER BY band_real DESC NULLS LAST) AS score FROM bands)
            QUALIFY place = 1)""",
        ),
        "P01_monthly_summary": query(
            "year:b month:b month_start total_revenue:d total_units:b avg_discount:d",
            f"""SELECT year, month, month_start, {REV} AS total_revenue, {UNITS} AS total_units,
            {rnd(AVG_DISCOUNT, 2)} AS avg_discount FROM sales GROUP BY year, month, month_start""",
        ),
        "P02_state_performance": query(
            "state_name year:b month_name month_start revenue:d units:b avg_discount:d",
            f"""SELECT state_name, year, month_name, month_start, {REV} AS revenue, {UNITS} AS units,
            {rnd(AVG_DISCOUNT, 2)} AS avg_discount FROM sales WHERE state_name = 'NATION_7'
            GROUP BY state_name, year, month_name, month_start""",
        ),
    }
