"""Stored cells give every report that the orders give."""

import datetime
import random
import re

import compare
import pytest
from pyspark.sql import functions as F

from revq.plans import adhoc, cells, measures, procedures, registry
from revq.sources.versions import Conflict, VersionedTable

NEED_DAYS_OR_ROWS = ("Q04", "Q07", "Q08", "P02", "U0", "R0")
REPORTS = {k: r for k, r in registry.FROM_ORDERS.items() if not k.startswith(NEED_DAYS_OR_ROWS) and "cells" not in k}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def stored(small_orders, tmp_path_factory):
    return cells.refresh(small_orders, str(tmp_path_factory.mktemp("cells") / "t"))


@pytest.mark.parametrize("name", REPORTS)
def test_reports_agree(small_orders, stored, name):
    ours, plain = (registry.portable(REPORTS[name](source)) for source in (stored, small_orders))
    assert compare.difference(compare.spark_rows(ours), compare.spark_rows(plain)) is None


def test_one_state(small_orders, stored):
    ours, plain = (procedures.state_performance(source, "NATION_3") for source in (stored, small_orders))
    assert rows(ours) == rows(plain) and rows(ours)


def test_sums_do_not_read_the_bitmaps(stored):
    text = measures.totals(stored, ["state_name"], "revenue")._jdf.queryExecution().executedPlan().toString()
    (read,) = re.findall(r"ReadSchema: struct<(.*)>", text)
    assert "bits" not in read and "zone" not in read


@pytest.fixture
def many(orders):
    """Orders of several lines over months, categories and events, rows repeated, ids missing."""
    random.seed(3)
    dates = [f"2024-{m:02}-{d:02}" for m in (1, 2, 3) for d in (1, 20)]
    return orders(
        *[
            {
                "order_id": random.choice([None, *[f"o{i}" for i in range(40)]]),
                "order_date": random.choice(dates),
                "category": random.choice(["Footwear", "Electronics"]),
                "sales_event": random.choice(["Normal", "Festival"]),
                "discount_percent": random.choice([None, 5, 25, 55]),
                "units_sold": random.choice([0, 1, 3]),
            }
            for _ in range(400)
        ]
    )


GROUPS = ([], ["category"], ["month_start"], ["sales_event", "discount_band"], ["year", "category"])


def counted(source, keys):
    return rows(measures.totals(source, keys, "transactions", "units", "discount_sum", "discount_rows"))


def test_counts_of_orders_with_many_lines(many, tmp_path):
    ours = cells.refresh(many, str(tmp_path / "t"))
    for keys in GROUPS:
        assert counted(ours, keys) == counted(many, keys)


def test_months_are_replaced_alone_and_ids_keep_their_numbers(spark, many, tmp_path):
    path = str(tmp_path / "t")
    january, february, march = (datetime.date(2024, m, 1) for m in (1, 2, 3))
    early = many.where(F.col("month_start") < F.lit(march))
    cells.refresh(early, path)
    numbers = VersionedTable(spark, f"{path}/numbers", cells.NUMBERS)
    before = dict(rows(numbers.read()))
    # February loses its festival, March comes, January is not read again.
    now = many.where(~((F.col("month_start") == F.lit(february)) & (F.col("sales_event") == "Festival")))
    ours = cells.refresh(now.where(F.col("month_start") != F.lit(january)), path, [february, march])
    for keys in GROUPS:
        assert counted(ours, keys) == counted(now, keys)
    after = dict(rows(numbers.read()))
    assert before.items() <= after.items()
    assert len(set(after.values())) == len(after)
    gone = cells.refresh(now.where("false"), path, [march])
    assert counted(gone, ["month_start"]) == counted(now.where(F.col("month_start") < F.lit(march)), ["month_start"])


def test_numbers_past_one_bitmap(spark, tmp_path):
    """Ids over several bitmaps and two loads count once each."""
    ids = spark.range(70000).select(
        F.concat(F.lit("o"), F.col("id") % 50000).alias("order_id"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("category"),
        F.lit("Normal").alias("sales_event"),
        F.lit("0-20%").alias("discount_band"),
        F.lit(datetime.date(2024, 1, 1)).alias("month_start"),
    )
    numbers = VersionedTable(spark, str(tmp_path / "n"), cells.NUMBERS)
    for part in (ids.where("order_id < 'o3'"), ids):
        bits = cells._bitmaps(part, numbers)
        for keys in ([], ["category"]):
            merged = bits.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
            got = merged.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")))
            assert rows(got) == rows(part.groupBy(*keys).agg(F.count_distinct("order_id")))


def test_empty_orders(many, tmp_path):
    ours = cells.refresh(many.where("false"), str(tmp_path / "t"))
    assert counted(ours, ["category"]) == []
    assert adhoc.best_band_by_revenue(ours).count() == 0


def test_what_cells_cannot_count_is_an_error(stored):
    with pytest.raises(ValueError, match="not counted"):
        measures.totals(stored, ["state_name"], "transactions")
    with pytest.raises(ValueError, match="not counted"):
        measures.totals(stored.where(F.col("state_name") == "NATION_3"), ["category"], "transactions")


def test_two_loads_that_number_at_once(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "n"), cells.NUMBERS)
    first = spark.createDataFrame([("a", 1)], cells.NUMBERS)
    table.append(first, base=0)
    with pytest.raises(Conflict):
        table.append(spark.createDataFrame([("b", 1)], cells.NUMBERS), base=0)
    assert rows(table.read()) == [("a", 1)]


def test_numbers_are_shuffled_and_not_bitmaps(spark, many, tmp_path):
    """A bitmap is made whole by one task, after the shuffle by cell and bucket."""
    bits = cells._bitmaps(many, VersionedTable(spark, str(tmp_path / "n"), cells.NUMBERS))
    lines = bits._jdf.queryExecution().executedPlan().toString().splitlines()
    partial = [i for i, line in enumerate(lines) if "partial_bitmap_construct_agg" in line]
    above = [line for line in lines[: partial[0]] if "Exchange hashpartitioning" in line]
    below = [line for line in lines[partial[0] :] if "Exchange hashpartitioning(cell" in line]
    assert partial and not above and below


@pytest.mark.parametrize("name", ["A03_counts_from_cells", "S09_views_from_cells"])
def test_loads_read_stored_orders(small_orders, monkeypatch, name):
    """The tables are joined to orders once, however often a load reads them."""
    files = []
    refresh = cells.refresh

    def noted(orders, *more):
        files.extend(orders.inputFiles())
        return refresh(orders, *more)

    monkeypatch.setattr(cells, "refresh", noted)
    assert registry.FROM_ORDERS[name](small_orders).count()
    assert files and not set(small_orders.inputFiles()) & set(files)
