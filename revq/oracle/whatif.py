"""What-if repricing: one branch per scenario, each with its own filter."""

from __future__ import annotations

from revq.oracle.parts import BRACKET, WHATIF_AGE, div, even, query

STATES = "('NATION_3', 'NATION_11', 'NATION_20')"

RESULT_COLUMNS = """opportunity sim_type rows_affected:b actual_revenue_total:d simulated_revenue_total:d
    revenue_delta:d revenue_delta_pct:d actual_revenue_affected:d sim_revenue_affected:d
    actual_units_affected:d sim_units_affected:d unit_delta:d unit_delta_pct:d avg_discount_before:d
    avg_discount_after:d"""

ROWS = f"""w AS (SELECT order_id, state AS state_name, category, brand_type, sales_event, competition_intensity,
    inventory_pressure, discount_percent, units_sold, revenue,
    cast(base_price AS double) AS base, cast(final_price AS double) AS price,
    cast(units_sold AS double) AS u, cast(discount_percent AS double) AS d,
    {BRACKET} AS bracket, {WHATIF_AGE} AS age FROM stg)"""


def _baseline(where: str, digits: int) -> str:
    weighted = "sum(discount_percent * units_sold)"
    return even(div(f"{weighted} FILTER ({where})", f"sum(units_sold) FILTER ({where})"), digits)


PARAMS = f"""best AS (SELECT arg_max(discount_percent, row(rev, -discount_percent)) AS best_discount FROM (
      SELECT discount_percent, sum(revenue) AS rev FROM w WHERE bracket = '30-40%' GROUP BY discount_percent)),
    params AS (SELECT max(best_discount) AS optimal_discount,
    {even('max(best_discount)', 0)} AS optimal_discount_rounded,
    {_baseline("sales_event = 'Normal' AND category = 'Premium Lifestyle'", 1)} AS normal_avg_0,
    {_baseline("sales_event = 'Normal' AND category = 'Electronics'", 1)} AS normal_avg_1,
    {_baseline("sales_event = 'Normal' AND competition_intensity <> 'High'", 2)} AS calm_avg,
    sum(revenue) AS total_revenue FROM w, best)"""


def _new_discount(target: str, response: str) -> tuple[str, str, str]:
    """New discount, price and units for a target discount and a signed response."""
    price = f"base * (1 - ({target}) / 100)"
    units = f"greatest(u * (1 + {response} * (({price} - price) / nullif(price, 0))), 0)"
    return target, price, units


def _branch(label: str, kind: str, where: str, new: tuple[str, str, str]) -> str:
    discount, price, units = new
    return f"""SELECT {label} AS opportunity, '{kind}' AS sim_type, count(*) AS n,
        coalesce(sum(revenue), 0) AS rev, coalesce(sum(units_sold), 0) AS un,
        coalesce(sum(discount_percent * units_sold), 0) AS du,
        coalesce(sum(cast(np * nu AS decimal(18,6))), 0) AS nrev,
        coalesce(sum(cast(nu AS decimal(18,6))), 0) AS nun,
        coalesce(sum(cast(nd * nu AS decimal(18,6))), 0) AS ndu
        FROM (SELECT revenue, units_sold, discount_percent, {discount} AS nd, {price} AS np, {units} AS nu
        FROM w WHERE {where})"""


def _param(name: str) -> str:
    return f"(SELECT cast({name} AS double) FROM params)"


def _shift() -> tuple[str, str, str]:
    cut = "greatest(d - (CASE sales_event WHEN 'Festival' THEN 10 WHEN 'Normal' THEN 3 END), 0)"
    return _new_discount(
        cut, "(CASE sales_event WHEN 'Festival' THEN 0.5::double WHEN 'Normal' THEN 0.3::double END)"
    )


SHIFTED = "sales_event = 'Festival' OR sales_event = 'Normal'"


def _branches() -> list[str]:
    found = []

    def cap(label: str, where: str, target: str, e: str, shown: str | None = None) -> None:
        text = f"'{label}'" if shown is None else label
        found.append(_branch(text, "discount_change", where, _new_discount(target, f"(-{e}::double)")))

    opt = _param("optimal_discount_rounded")
    opt_text = "(SELECT cast(cast(optimal_discount_rounded AS int) AS varchar) FROM params)"
    for label, where, deep in (
        ("OPP_01: Mass Brand Cap at ", "brand_type = 'Mass'", "40"),
        ("OPP_02: Electronics Mass Cap at ", "brand_type = 'Mass' AND category = 'Electronics'", "40"),
        ("OPP_03: Deep Bands Cap at ", "bracket = '40%+'", None),
    ):
        for target in ("40", "38", "35"):
            cap(f"{label}{target}%", f"{where} AND d > {deep or target}", f"{target}::double", "0.8")
        cap(f"'{label}' || {opt_text} || '%'", f"{where} AND d > {deep or opt}", opt, "0.8", "opt")
    for i, category in enumerate(("Premium Lifestyle", "Electronics")):
        cap(
            f"OPP_04: No Festival Discount — {category}",
            f"sales_event = 'Festival' AND category = '{category}'", _param(f"normal_avg_{i}"), "0.3",
        )
    for step, target in enumerate((30, 25, 20), 1):
        cap(
            f"OPP_05: Age Low-Sensitivity to {target}% (Step {step})",
            f"age IN ('Elderly', 'Middle Age') AND d > {target}", f"{target}::double", "0.2",
        )
    cap("OPP_06: Premium Brand Cap at 30%", "brand_type = 'Premium' AND d > 30", "30::double", "0.3")
    cap("OPP_07: Inventory Markdown Cap at 40%", "inventory_pressure = 'High' AND d > 40", "40::double", "0.6")
    cap(
        "OPP_08: Remove Triple-Risk Combination",
        "sales_event = 'Festival' AND competition_intensity = 'High' AND bracket = '40%+'",
        _param("calm_avg"), "0.65",
    )
    cap(
        "OPP_09: Inelastic Segments to Optimal Discount",
        "category IN ('Home & Living', 'Footwear', 'Premium Lifestyle') AND d > 40",
        _param("optimal_discount"), "0.2",
    )
    found.append(
        _branch("'OPP_10: Reallocate Festival Spend to Normal Periods'", "reallocation", SHIFTED, _shift())
    )
    for target in (25, 22, 20):
        cap(
            f"OPP_11: Grocery Essentials to {target}%",
            "category = 'Grocery Essentials' AND d > 25", f"{target}::double", "0.9",
        )
    for growth in (10, 20, 30):
        new = ("d", "price", f"u * (1 + {growth}::double / 100)")
        found.append(
            _branch(
                f"'OPP_12: Lower-Tier States +{growth}% Volume'", "volume_growth",
                f"state_name IN {STATES}", new,
            )
        )
    return found


def _results() -> str:
    """CTE with the 15 result fields."""
    sums = " UNION ALL ".join(_branches())
    return f"""results AS (SELECT opportunity, sim_type, n AS rows_affected,
        {even('total_revenue', 2)} AS actual_revenue_total,
        {even('total_revenue + nrev - rev', 2)} AS simulated_revenue_total,
        {even('nrev - rev', 2)} AS revenue_delta,
        {even(div('nrev - rev', 'total_revenue') + ' * 100', 4)} AS revenue_delta_pct,
        {even('rev', 2)} AS actual_revenue_affected, {even('nrev', 2)} AS sim_revenue_affected,
        {even('un', 2)} AS actual_units_affected, {even('nun', 2)} AS sim_units_affected,
        {even('nun - un', 2)} AS unit_delta,
        {even(f"CASE WHEN un > 0 THEN {div('nun - un', 'un')} * 100 ELSE 0 END", 4)} AS unit_delta_pct,
        {even(f"CASE WHEN un > 0 THEN {div('du', 'un')} ELSE 0 END", 2)} AS avg_discount_before,
        {even(f"CASE WHEN nun > 0 THEN {div('ndu', 'nun')} ELSE 0 END", 2)} AS avg_discount_after
        FROM ({sums}), params)"""


def _row_query(where: str, new: tuple[str, str, str]) -> str:
    discount, price, units = new
    names = ("discount_percent", "final_price", "units_sold", "revenue")
    values = ("nd", "np", "nu", "CASE WHEN hit THEN np * nu ELSE cast(revenue AS double) END")
    body = f"""SELECT order_id, {', '.join(f'{v} AS {n}' for n, v in zip(names, values))} FROM (
        SELECT order_id, hit, revenue, CASE WHEN hit THEN {discount} ELSE d END AS nd,
        CASE WHEN hit THEN {price} ELSE price END AS np, CASE WHEN hit THEN {units} ELSE u END AS nu
        FROM (SELECT *, {where} AS hit FROM w))"""
    return query("order_id discount_percent:d final_price:d units_sold:d revenue:d", body, ROWS, over="stg")


def queries() -> dict[str, str]:
    ctes = (ROWS, PARAMS, _results())
    summary = query(RESULT_COLUMNS, "SELECT * FROM results", *ctes, over="stg")
    return {
        "R01_discount_change": _row_query(
            "brand_type = 'Mass' AND d > 40", _new_discount("40::double", "(-0.8::double)")
        ),
        "R02_volume_growth": _row_query(
            f"state_name IN {STATES}", ("d", "price", "u * (1 + 20::double / 100)")
        ),
        "R03_reallocation": _row_query(SHIFTED, _shift()),
        "R04_scenario_results": summary,
        "R05_whatif_parameters": query(
            """optimal_discount:d optimal_discount_rounded:d normal_avg_0:d normal_avg_1:d calm_avg:d
            total_revenue:d""",
            "SELECT * FROM params", ROWS, PARAMS, over="stg",
        ),
        "R07_ranked_summary": summary,
        "R08_by_sim_type": query(
            "sim_type opportunities:b total_revenue_delta:d avg_revenue_delta_pct:d",
            f"""SELECT sim_type, count(opportunity) AS opportunities, sum(revenue_delta) AS total_revenue_delta,
            {div('sum(revenue_delta_pct)', 'count(*)')} AS avg_revenue_delta_pct FROM results GROUP BY sim_type""",
            *ctes, over="stg",
        ),
        "R09_portfolio": query(
            "opportunities:b max_revenue_delta:d combined_revenue_delta:d",
            """SELECT count(*) AS opportunities, max(revenue_delta) AS max_revenue_delta,
            sum(revenue_delta) AS combined_revenue_delta FROM results""",
            *ctes, over="stg",
        ),
    }
