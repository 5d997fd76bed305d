import datetime
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from compare import SMALL  # noqa: E402

from revq.plans.model import enrich  # noqa: E402
from revq.schema import STG_ORDERS  # noqa: E402
from revq.session import local_session  # noqa: E402
from revq.sources.tables import stg_orders  # noqa: E402

DEFAULTS = {
    "order_id": None,
    "order_date": datetime.date(2024, 1, 5),
    "state": "Goa",
    "zone": "West",
    "category": "Footwear",
    "brand_type": "Mass",
    "customer_gender": "Female",
    "customer_age": 30,
    "base_price": 100,
    "discount_percent": 20,
    "final_price": None,
    "units_sold": 1,
    "revenue": None,
    "sales_event": "Normal",
    "competition_intensity": "Low",
    "inventory_pressure": "Low",
}


def _cents(x):
    return Decimal(str(x)).quantize(Decimal("0.01"))


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def staging(spark):
    """Build staging rows; unset columns take defaults, prices follow the discount."""

    def build(*rows):
        full = []
        for i, given in enumerate(rows):
            row = DEFAULTS | {"order_id": f"o{i}"} | given
            if isinstance(row["order_date"], str):
                row["order_date"] = datetime.date.fromisoformat(row["order_date"])
            if row["final_price"] is None:
                row["final_price"] = row["base_price"] * (100 - (row["discount_percent"] or 0)) / 100
            if row["revenue"] is None:
                row["revenue"] = row["final_price"] * row["units_sold"]
            for name in ("base_price", "discount_percent", "final_price", "revenue"):
                row[name] = None if row[name] is None else _cents(row[name])
            full.append(tuple(row[f.name] for f in STG_ORDERS))
        return spark.createDataFrame(full, STG_ORDERS)

    return build


@pytest.fixture(scope="session")
def orders(staging):
    return lambda *rows: enrich(staging(*rows))


@pytest.fixture(scope="session")
def small_staging(spark, tmp_path_factory):
    """The small test tables as an order table, written once."""
    path = str(tmp_path_factory.mktemp("tables") / "stg")
    stg_orders(spark, SMALL).write.parquet(path)
    return spark.read.schema(STG_ORDERS).parquet(path)


@pytest.fixture(scope="session")
def small_orders(small_staging):
    return enrich(small_staging)
