"""From staging rows to the order rows all reports read, and to the star schema."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revq.functions.labels import age_group, discount_band, one_spelling
from revq.operators.constraints import TableRules, enforce, table_violations, violations
from revq.operators.ranking import with_global_ranks
from revq.schema import (
    DIM_CUSTOMER_DEMO,
    DIM_DATE,
    DIM_EVENT,
    DIM_PRODUCT,
    DIM_STATE,
    FACT_ORDERS,
    require_columns,
)
from revq.session import materialise
from revq.sources.files import replace_table
from revq.sources.versions import VersionedTable

# A row without one of these has no place in a dimension.
NATURAL_KEYS = (
    "order_date", "state", "category", "brand_type", "customer_gender", "customer_age", "sales_event",
)

# Dimension -> schema, its id first, and natural key in the order ids are given.
DIMENSIONS = {
    "dim_date": (DIM_DATE, ("full_date",)),
    "dim_state": (DIM_STATE, ("state_name",)),
    "dim_product": (DIM_PRODUCT, ("category", "brand_type")),
    "dim_customer_demo": (DIM_CUSTOMER_DEMO, ("customer_age", "customer_gender")),
    "dim_event": (DIM_EVENT, ("sales_event",)),
}

RULES = {
    "dim_date": TableRules(DIM_DATE.names, [("date_id",), ("full_date",)]),
    "dim_state": TableRules(DIM_STATE.names, [("state_id",), ("state_name",)]),
    "dim_product": TableRules(DIM_PRODUCT.names, [("product_id",), ("category", "brand_type")]),
    "dim_customer_demo": TableRules(
        DIM_CUSTOMER_DEMO.names, [("customer_demo_id",), ("customer_gender", "customer_age")]
    ),
    "dim_event": TableRules(DIM_EVENT.names, [("event_id",), ("sales_event",)]),
    "fact_orders": TableRules(
        FACT_ORDERS.names,
        [("order_id",)],
        {
            "date_id": ("dim_date", "date_id"),
            "state_id": ("dim_state", "state_id"),
            "product_id": ("dim_product", "product_id"),
            "customer_demo_id": ("dim_customer_demo", "customer_demo_id"),
            "event_id": ("dim_event", "event_id"),
        },
    ),
}


def enrich(staging: DataFrame, spelled: bool = False) -> DataFrame:
    """Order rows with date parts, age group and discount band: no join, no shuffle.

    `spelled` says that the closed vocabularies are written one way already, as in a table of
    `write_orders`; a filter on a brand, event or pressure then reaches the scan.

    This is the star schema joined back together, but for one thing: a state
    named with two zones keeps both here, and the reports that show a zone
    settle it after they have aggregated (`one_zone_per_state` in measures).
    """
    require_columns(staging)
    date = F.col("order_date")
    added = {
        "year": F.year(date),
        "month": F.month(date),
        "month_name": F.date_format(date, "MMM"),
        "quarter": F.quarter(date),
        "month_start": F.trunc(date, "MM"),
        "customer_age_group": age_group(F.col("customer_age")),
        "discount_band": discount_band(F.col("discount_percent")),
    }
    if "month_start" in staging.columns:
        # The order table is stored by month: a filter on it then skips folders.
        del added["month_start"]
    # One test per column, so that each can reach the scan.
    present = " AND ".join(f"{name} IS NOT NULL" for name in NATURAL_KEYS)
    rows = staging.where(present)
    if not spelled:
        rows = one_spelling(rows)
    return rows.withColumnRenamed("state", "state_name").withColumns(added)


def _numbered(name: str, keys: DataFrame) -> DataFrame:
    """A dimension from its distinct natural keys, numbered in their order; ids repeat from run to run."""
    schema, order = DIMENSIONS[name]
    id_column = schema.names[0]
    ranked = with_global_ranks(keys, numbers={id_column: [(k, "asc") for k in order]})
    return _with_attributes(name, ranked.withColumn(id_column, F.col(id_column).cast("int")))


def _with_attributes(name: str, rows: DataFrame) -> DataFrame:
    """A dimension's columns from its id and natural key."""
    schema, _ = DIMENSIONS[name]
    if name == "dim_date":
        date = F.col("full_date")
        rows = rows.withColumns(
            {
                "year": F.year(date),
                "month": F.month(date),
                "month_name": F.date_format(date, "MMM"),
                "quarter": F.quarter(date),
                "month_start": F.trunc(date, "MM"),
            }
        )
    if name == "dim_customer_demo":
        rows = rows.withColumn("customer_age_group", age_group(F.col("customer_age")))
    return rows.select(schema.names)


def _one_zone(places: DataFrame) -> DataFrame:
    """Of a state named with several zones the last by name counts."""
    return places.groupBy("state_name").agg(F.max("zone").alias("zone"))


def dim_date(staging: DataFrame) -> DataFrame:
    """One row per order date."""
    dates = staging.select(F.col("order_date").alias("full_date"))
    return _numbered("dim_date", dates.dropna().distinct())


def dim_state(staging: DataFrame) -> DataFrame:
    """One row per state, with one zone."""
    places = staging.select(F.col("state").alias("state_name"), "zone")
    return _numbered("dim_state", _one_zone(places.dropna(subset=["state_name"]).distinct()))


def dim_product(staging: DataFrame) -> DataFrame:
    """One row per category and brand type."""
    products = one_spelling(staging).select("category", "brand_type")
    return _numbered("dim_product", products.dropna().distinct())


def dim_customer_demo(staging: DataFrame) -> DataFrame:
    """One row per gender and age."""
    demos = staging.select("customer_gender", "customer_age")
    return _numbered("dim_customer_demo", demos.dropna().distinct())


def dim_event(staging: DataFrame) -> DataFrame:
    """One row per sales event."""
    return _numbered("dim_event", one_spelling(staging).select("sales_event").dropna().distinct())


def dimensions(staging: DataFrame) -> dict[str, DataFrame]:
    """All five dimensions from one scan of the orders.

    Each order yields its five natural keys; duplicates fall away inside the
    scanning tasks, so only a few keys per task are shuffled.
    """
    return _members(_natural_keys(staging), {name: 0 for name in DIMENSIONS})


# The natural keys of all dimensions in one table: a date, a whole number and two texts.
KEY_COLUMNS = {
    "dim_date": {"full_date": "d"},
    "dim_state": {"state_name": "a"},
    "dim_product": {"category": "a", "brand_type": "b"},
    "dim_customer_demo": {"customer_age": "i", "customer_gender": "a"},
    "dim_event": {"sales_event": "a"},
}


def _natural_keys(staging: DataFrame) -> DataFrame:
    """(dim, d, i, a, b, zone): the distinct whole keys of all dimensions, from one scan."""
    stacked = one_spelling(staging).selectExpr(
        """stack(5,
          'dim_date', order_date, cast(null AS int), cast(null AS string), cast(null AS string), cast(null AS string),
          'dim_state', cast(null AS date), cast(null AS int), state, cast(null AS string), zone,
          'dim_product', cast(null AS date), cast(null AS int), category, brand_type, cast(null AS string),
          'dim_customer_demo', cast(null AS date), customer_age, customer_gender, cast(null AS string),
            cast(null AS string),
          'dim_event', cast(null AS date), cast(null AS int), sales_event, cast(null AS string), cast(null AS string)
          ) AS (dim, d, i, a, b, zone)"""
    )
    whole = reduce(
        lambda x, y: x | y,
        [
            (F.col("dim") == name) & reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in columns.values()])
            for name, columns in KEY_COLUMNS.items()
        ],
    )
    # Orders fall to distinct keys by hash. A maximum of texts sorts, and Spark takes it over the
    # orders even behind distinct; so the zones of the few keys are listed.
    few = stacked.where(whole).distinct()
    # Of a state named with several zones the last by name counts.
    return few.groupBy("dim", "d", "i", "a", "b").agg(F.array_max(F.collect_list("zone")).alias("zone"))


def _members(keys: DataFrame, highest: dict[str, int]) -> dict[str, DataFrame]:
    """Dimension rows for keys as of `_natural_keys`, numbered on from the highest id of each."""
    order = [(name, "asc") for name in ("dim", "d", "i", "a", "b")]
    placed = materialise(with_global_ranks(keys, numbers={"place": order}))
    # One row per dimension.
    first = {r.dim: r.first for r in placed.groupBy("dim").agg(F.min("place").alias("first")).collect()}

    def of(name: str) -> DataFrame:
        schema, _ = DIMENSIONS[name]
        rows = placed.where(F.col("dim") == name)
        number = F.col("place") - first.get(name, 0) + 1 + highest[name]
        columns = [F.col(c).alias(key) for key, c in KEY_COLUMNS[name].items()]
        rows = rows.select(number.cast("int").alias(schema.names[0]), *columns, "zone")
        return _with_attributes(name, rows if name == "dim_state" else rows.drop("zone"))

    return {name: of(name) for name in DIMENSIONS}


def _star_tables(spark: SparkSession, folder: str) -> dict[str, VersionedTable]:
    by_month = T.StructType([*FACT_ORDERS, T.StructField("month_start", T.DateType())])
    tables = {name: VersionedTable(spark, f"{folder}/{name}", schema) for name, (schema, _) in DIMENSIONS.items()}
    return tables | {"fact_orders": VersionedTable(spark, f"{folder}/fact_orders", by_month, "month_start")}


def read_loaded(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The star that `load` keeps in a folder, as of now."""
    return {name: table.read() for name, table in _star_tables(spark, folder).items()}


def load(staging: DataFrame, folder: str, load_id: str) -> dict[str, DataFrame]:
    """Add orders to the star in a folder; ids that were given before never change.

    Members that no dimension knows are numbered past its highest id, in the order of
    their keys. A known state takes the last by name of all its zones. Facts are
    appended by month. Dimensions are published before the facts: a load that dies
    between leaves members without orders, which the repeated load finds and uses. A
    load that is sent again with its id adds nothing.
    """
    tables = _star_tables(staging.sparkSession, folder)
    if load_id in tables["fact_orders"].loads():
        return read_loaded(staging.sparkSession, folder)
    known = {name: tables[name].read() for name in DIMENSIONS}
    highest = {
        name: known[name].agg(F.max(schema.names[0])).first()[0] or 0 for name, (schema, _) in DIMENSIONS.items()
    }
    keys = materialise(_natural_keys(staging))
    held = []
    for name, columns in KEY_COLUMNS.items():
        own = {c: key for key, c in columns.items()}
        kinds = {"d": "date", "i": "int", "a": "string", "b": "string"}
        held.append(
            known[name].select(
                F.lit(name).alias("dim"),
                *[(F.col(own[c]) if c in own else F.lit(None).cast(kind)).alias(c) for c, kind in kinds.items()],
            )
        )
    names = ["dim", "d", "i", "a", "b"]
    held = reduce(DataFrame.unionByName, held).withColumnsRenamed({c: f"_{c}" for c in names})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names])
    fresh = _members(keys.join(held, same, "left_anti"), highest)
    for name, rows in fresh.items():
        if name == "dim_state":
            zones = keys.where("dim = 'dim_state'").select(F.col("a").alias("state_name"), F.col("zone").alias("_zone"))
            old = known[name].join(zones, "state_name", "left").withColumn("zone", F.greatest("zone", "_zone"))
            tables[name].replace(old.select(rows.columns).unionByName(rows))
        else:
            tables[name].append(rows)
    dims = {name: tables[name].read() for name in DIMENSIONS}
    facts = fact_orders(staging, dims, ["month_start"])
    tables["fact_orders"].append(facts.hint("rebalance", "month_start"), load_id)
    return read_loaded(staging.sparkSession, folder)


def _placed(staging: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Staging rows with dimension ids, null where a dimension has no match.

    Dimensions are written tables: Spark knows their sizes and broadcasts those
    below the session's threshold.
    """
    rows = one_spelling(staging).withColumnsRenamed({"state": "state_name", "order_date": "full_date"})
    for name, (schema, keys) in DIMENSIONS.items():
        rows = rows.join(dims[name].select(schema.names[0], *keys), list(keys), "left")
    return rows


def fact_orders(staging: DataFrame, dims: dict[str, DataFrame], more: Sequence[str] = ()) -> DataFrame:
    """Staging rows with dimension ids; a row without a match drops out. `more` may name month_start."""
    ids = [schema.names[0] for schema, _ in DIMENSIONS.values()]
    placed = _placed(staging, dims).dropna(subset=ids).withColumn("month_start", F.trunc("full_date", "MM"))
    return placed.select(*FACT_ORDERS.names, *more)


def star(staging: DataFrame) -> dict[str, DataFrame]:
    """The five dimensions and the fact table."""
    dims = dimensions(staging)
    return dims | {"fact_orders": fact_orders(staging, dims)}


def write_star(tables: dict[str, DataFrame], folder: str, strict: bool = False) -> None:
    """Drop and recreate the six tables under `folder`, the facts in one folder per month.

    With `strict`, a broken rule raises an error before anything is written.
    """
    if strict:
        enforce(constraint_report(tables))
    for name, df in tables.items():
        if name == "fact_orders":
            months = tables["dim_date"].select("date_id", "month_start")
            replace_table(df.join(months, "date_id"), f"{folder}/{name}", ("month_start",))
        else:
            replace_table(df, f"{folder}/{name}")


def rejoin(tables: dict[str, DataFrame]) -> DataFrame:
    """Staging rows from a star schema, each with the zone of its state."""
    rows = tables["fact_orders"].drop("month_start")  # written facts have it, and so has dim_date
    for name, (schema, _) in DIMENSIONS.items():
        rows = rows.join(tables[name], schema.names[0])
    return rows.withColumnsRenamed({"state_name": "state", "full_date": "order_date"})


def constraint_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations per declared rule of a star schema."""
    return violations(tables, RULES)


def load_report(staging: DataFrame) -> DataFrame:
    """Violations of the star schema that `staging` makes, and the staging rows it leaves out.

    A row is left out where a dimension has no match for it, most often for a missing
    natural key; such rows are counted per dimension. The orders are read once for the
    dimensions and once for everything else.
    """
    dims = dimensions(staging)
    placed = _placed(staging, dims)
    ids = [schema.names[0] for schema, _ in DIMENSIONS.values()]
    loaded = reduce(lambda a, b: a & b, [F.col(i).isNotNull() for i in ids])
    names = {"full_date": "order_date", "state_name": "state"}
    left_out = {
        ("not loaded", ", ".join(names.get(k, k) for k in keys)): F.col(schema.names[0]).isNull()
        for schema, keys in DIMENSIONS.values()
    }
    facts = table_violations(dims | {"fact_orders": placed}, "fact_orders", RULES["fact_orders"], loaded, left_out)
    dim_rules = {name: rule for name, rule in RULES.items() if name in dims}
    return violations(dims, dim_rules).unionAll(facts)


def load_checks(staging: DataFrame) -> DataFrame:
    """Row count, first and last date, and rows per event, in one pass."""
    counts = one_spelling(staging).rollup("sales_event").agg(
        F.grouping("sales_event").alias("overall"),
        F.count(F.lit(1)).alias("n"),
        F.min("order_date").alias("first"),
        F.max("order_date").alias("last"),
    )

    def entry(check: str, item, value):
        return F.struct(
            F.lit(check).alias("check_name"), item.alias("item"), value.cast("string").alias("value")
        )

    nothing = F.lit(None).cast("string")
    overall = F.array(
        entry("rows_loaded", nothing, F.col("n")),
        entry("first_order_date", nothing, F.col("first")),
        entry("last_order_date", nothing, F.col("last")),
    )
    per_event = F.array(entry("rows_per_event", F.col("sales_event"), F.col("n")))
    return counts.select(F.inline(F.when(F.col("overall") == 1, overall).otherwise(per_event)))


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    """A few rows to look at, in no particular order."""
    return df.limit(rows)
