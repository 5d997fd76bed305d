"""Dimensions, fact table and checks."""

from __future__ import annotations

from revq.oracle.parts import AGE_GROUP, query

DIMS = {
    "dim_date": """SELECT row_number() OVER (ORDER BY full_date) AS date_id, full_date,
        year(full_date) AS year, month(full_date) AS month, strftime(full_date, '%b') AS month_name,
        quarter(full_date) AS quarter, cast(date_trunc('month', full_date) AS date) AS month_start
        FROM (SELECT DISTINCT order_date AS full_date FROM stg)""",
    "dim_state": """SELECT row_number() OVER (ORDER BY state) AS state_id, state AS state_name,
        max(zone) AS zone FROM stg GROUP BY state""",
    "dim_product": """SELECT row_number() OVER (ORDER BY category, brand_type) AS product_id,
        category, brand_type FROM (SELECT DISTINCT category, brand_type FROM stg)""",
    "dim_customer_demo": f"""SELECT
        row_number() OVER (ORDER BY customer_age, customer_gender) AS customer_demo_id,
        customer_gender, customer_age, {AGE_GROUP} AS customer_age_group
        FROM (SELECT DISTINCT customer_gender, customer_age FROM stg)""",
    "dim_event": """SELECT row_number() OVER (ORDER BY sales_event) AS event_id, sales_event
        FROM (SELECT DISTINCT sales_event FROM stg)""",
}

LATER = "min(CASE WHEN order_date >= DATE '1995-06-15' THEN 1 ELSE 0 END)"
# Dimensions after two loads: members of the first keep their ids, those of the second come after them.
GROWN_DIMS = {
    "dim_date": f"""SELECT row_number() OVER (ORDER BY {LATER}, order_date) AS date_id, order_date AS full_date
        FROM stg GROUP BY order_date""",
    "dim_state": f"""SELECT row_number() OVER (ORDER BY {LATER}, state) AS state_id, state AS state_name
        FROM stg GROUP BY state""",
    "dim_product": f"""SELECT row_number() OVER (ORDER BY {LATER}, category, brand_type) AS product_id,
        category, brand_type FROM stg GROUP BY category, brand_type""",
    "dim_customer_demo": f"""SELECT
        row_number() OVER (ORDER BY {LATER}, customer_age, customer_gender) AS customer_demo_id,
        customer_gender, customer_age FROM stg GROUP BY customer_gender, customer_age""",
    "dim_event": f"""SELECT row_number() OVER (ORDER BY {LATER}, sales_event) AS event_id, sales_event
        FROM stg GROUP BY sales_event""",
}

FACT = """SELECT order_id, date_id, state_id, product_id, customer_demo_id, event_id, base_price,
    discount_percent, final_price, units_sold, revenue, competition_intensity, inventory_pressure
    FROM stg s JOIN dim_date d ON d.full_date = s.order_date JOIN dim_state t ON t.state_name = s.state
    JOIN dim_product p ON p.category = s.category AND p.brand_type = s.brand_type
    JOIN dim_customer_demo c ON c.customer_gender = s.customer_gender AND c.customer_age = s.customer_age
    JOIN dim_event e ON e.sales_event = s.sales_event"""

COLUMNS = {
    "dim_date": "date_id:b full_date year:b month:b month_name quarter:b month_start",
    "dim_state": "state_id:b state_name zone",
    "dim_product": "product_id:b category brand_type",
    "dim_customer_demo": "customer_demo_id:b customer_gender customer_age:b customer_age_group",
    "dim_event": "event_id:b sales_event",
    "fact_orders": "order_id date_id:b state_id:b product_id:b customer_demo_id:b event_id:b "
    "base_price:d discount_percent:d final_price:d units_sold:b revenue:d "
    "competition_intensity inventory_pressure",
}

UNIQUE = {
    "dim_date": ("date_id", "full_date"),
    "dim_state": ("state_id", "state_name"),
    "dim_product": ("product_id", "category, brand_type"),
    "dim_customer_demo": ("customer_demo_id", "customer_gender, customer_age"),
    "dim_event": ("event_id", "sales_event"),
    "fact_orders": ("order_id",),
}


NATURAL = {
    "dim_date": {"order_date": "full_date"},
    "dim_state": {"state": "state_name"},
    "dim_product": {"category": "category", "brand_type": "brand_type"},
    "dim_customer_demo": {"customer_age": "customer_age", "customer_gender": "customer_gender"},
    "dim_event": {"sales_event": "sales_event"},
}


def _star_ctes() -> list[str]:
    return [f"{n} AS ({s})" for n, s in DIMS.items()] + [f"fact_orders AS ({FACT})"]


def _violations() -> str:
    parts = []

    def add(table: str, rule: str, columns: str, count: str) -> None:
        parts.append(
            f"SELECT '{table}' AS table_name, '{rule}' AS rule, '{columns}' AS columns, ({count}) AS violations"
        )

    for table, columns in COLUMNS.items():
        for column in columns.replace(":b", "").replace(":d", "").split():
            add(table, "not null", column, f"SELECT count(*) FROM {table} WHERE {column} IS NULL")
        for key in UNIQUE[table]:
            add(
                table, "unique", key,
                f"SELECT count(*) FROM (SELECT {key} FROM {table} GROUP BY {key} HAVING count(*) > 1)",
            )
    for dim in DIMS:
        key = COLUMNS[dim].split(":")[0]
        add(
            "fact_orders", "foreign key", key,
            f"SELECT count(*) FROM fact_orders f WHERE f.{key} NOT IN (SELECT {key} FROM {dim})",
        )
    for dim, keys in NATURAL.items():
        same = " AND ".join(f"d.{theirs} = s.{ours}" for ours, theirs in keys.items())
        add(
            "fact_orders", "not loaded", ", ".join(keys),
            f"SELECT count(*) FROM stg s WHERE NOT EXISTS (SELECT 1 FROM {dim} d WHERE {same})",
        )
    return " UNION ALL ".join(parts)


def queries() -> dict[str, str]:
    result = {
        f"D0{i}_{name}": query(COLUMNS[name], body, over="stg") for i, (name, body) in enumerate(DIMS.items(), 1)
    }
    result["S01_csv_import"] = query(
        "order_id order_date state zone category brand_type customer_gender customer_age:b base_price:d "
        "discount_percent:d final_price:d units_sold:b revenue:d sales_event competition_intensity inventory_pressure",
        "SELECT * FROM stg", over="stg",
    )
    result["S02_import_with_rejects"] = query(
        "order_id reasons",
        """SELECT order_id, nullif(concat_ws(', ', CASE WHEN units_sold % 11 = 0 THEN 'order_date' END,
        CASE WHEN customer_age % 7 = 0 THEN 'units_sold' END), '') AS reasons FROM stg""",
        over="stg",
    )
    result["D06_fact_orders"] = query(
        COLUMNS["fact_orders"], "SELECT * FROM fact_orders", *_star_ctes(), over="stg"
    )
    result["S06_appended_facts"] = query(
        COLUMNS["fact_orders"], "SELECT * FROM fact_orders",
        *[f"{n} AS ({s})" for n, s in GROWN_DIMS.items()], f"fact_orders AS ({FACT})", over="stg",
    )
    result["D07_constraint_report"] = query(
        "table_name rule columns violations:b", _violations(), *_star_ctes(), over="stg"
    )
    result["D08_load_checks"] = query(
        "check_name item value",
        """SELECT 'rows_loaded' AS check_name, NULL AS item, cast(count(*) AS varchar) AS value FROM stg
        UNION ALL SELECT 'first_order_date', NULL, cast(min(order_date) AS varchar) FROM stg
        UNION ALL SELECT 'last_order_date', NULL, cast(max(order_date) AS varchar) FROM stg
        UNION ALL SELECT 'rows_per_event', sales_event, cast(count(*) AS varchar) FROM stg GROUP BY sales_event""",
        over="stg",
    )
    return result
