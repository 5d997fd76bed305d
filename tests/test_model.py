"""Star schema, checks, files, views and the summary table."""

import datetime

import pytest
from pyspark.sql import functions as F

from revq.operators import constraints
from revq.operators.constraints import enforce
from revq.plans import adhoc, model, procedures, registry, views, whatif
from revq.schema import FACT_ORDERS, STG_ORDERS, require_columns
from revq.sources import files


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def violations(tables):
    return {
        (r.table_name, r.rule, r["columns"]): r.violations
        for r in model.constraint_report(tables).where("violations > 0").collect()
    }


def test_one_pass_dimensions_equal_single_ones(small_staging):
    together = model.dimensions(small_staging)
    for name, df in together.items():
        assert rows(df) == rows(getattr(model, name)(small_staging)), name


def test_rejoined_star_gives_the_same_reports(small_staging, small_orders, spark, tmp_path):
    model.write_star(model.star(small_staging), str(tmp_path))
    names = [*model.DIMENSIONS, "fact_orders"]
    tables = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in names}
    assert tables["fact_orders"].count() == small_staging.count()
    assert set(tables["fact_orders"].schema.names) == {*FACT_ORDERS.names, "month_start"}
    again = model.enrich(model.rejoin(tables))
    for report in (views.risk_adjusted_performance, views.discount_band_performance):
        assert rows(report(again)) == rows(report(small_orders))


def test_rows_without_natural_key_drop(staging):
    df = staging({}, {"state": None}, {"sales_event": None}, {"customer_age": None})
    assert model.star(df)["fact_orders"].count() == 1
    assert model.enrich(df).count() == 1


def test_state_with_two_zones_has_the_last(staging):
    df = staging({"zone": "A"}, {"zone": "B"}, {"zone": None})
    assert [(r.state_name, r.zone) for r in model.dim_state(df).collect()] == [("Goa", "B")]
    assert [(r.zone, r.total_units) for r in views.discount_band_performance(model.enrich(df)).collect()] == [
        ("B", 3)
    ]


def test_constraints(staging):
    good = model.star(staging({}, {"state": "Delhi"}))
    assert violations(good) == {}
    enforce(model.constraint_report(good))
    bad = dict(good)
    fact = good["fact_orders"]
    bad["fact_orders"] = fact.unionAll(
        fact.where("order_id = 'o0'").withColumn("state_id", F.lit(99)).withColumn("revenue", F.lit(None).cast("decimal(12,2)"))
    ).unionAll(fact.where("order_id = 'o0'").withColumn("state_id", F.lit(99)))
    assert violations(bad) == {
        ("fact_orders", "not null", "revenue"): 1,
        ("fact_orders", "unique", "order_id"): 1,
        ("fact_orders", "foreign key", "state_id"): 2,
    }
    with pytest.raises(ValueError, match="foreign key"):
        enforce(model.constraint_report(bad))


def test_missing_columns_are_named(spark, staging):
    assert require_columns(staging({})) is not None
    with pytest.raises(ValueError, match="zone"):
        require_columns(staging({}).drop("zone"))


def test_load_checks(staging):
    df = staging({}, {"order_date": "2024-03-01", "sales_event": "Festival"}, {})
    assert rows(model.load_checks(df)) == [
        ("first_order_date", None, "2024-01-05"),
        ("last_order_date", None, "2024-03-01"),
        ("rows_loaded", None, "3"),
        ("rows_per_event", "Festival", "1"),
        ("rows_per_event", "Normal", "2"),
    ]
    assert model.preview(df, 2).count() == 2


def test_csv_round_trip_cleans_names(spark, staging, tmp_path):
    df = staging({"sales_event": "FESTIVAL", "state": " Goa "}, {"sales_event": "normal"})
    shuffled = df.select(*reversed(STG_ORDERS.names))
    files.write_csv(shuffled, str(tmp_path / "csv"))
    back = files.read_orders_csv(spark, str(tmp_path / "csv"))
    assert back.schema.simpleString() == STG_ORDERS.simpleString()
    assert sorted((r.state, r.sales_event) for r in back.collect()) == [("Goa", "Festival"), ("Goa", "Normal")]
    assert rows(back.drop("state", "sales_event")) == rows(df.drop("state", "sales_event"))
    files.write_csv(shuffled.drop("zone"), str(tmp_path / "short"))
    with pytest.raises(ValueError, match="zone"):
        files.read_orders_csv(spark, str(tmp_path / "short"))


def test_csv_files_keep_their_own_column_order(spark, staging, tmp_path):
    df = staging({"state": "Goa", "zone": "West"}, {"state": "Delhi", "zone": "North"})
    for i, columns in enumerate((STG_ORDERS.names, [*STG_ORDERS.names[:2], "zone", "state", *STG_ORDERS.names[4:]])):
        files.write_csv(df.where(F.col("order_id") == f"o{i}").select(*columns), str(tmp_path / f"part{i}"))
    back = files.read_orders_csv(spark, [str(tmp_path / "part0"), str(tmp_path / "part1")])
    assert sorted((r.state, r.zone) for r in back.collect()) == [("Delhi", "North"), ("Goa", "West")]


def test_csv_files_that_begin_with_blank_lines_are_read(spark, staging, tmp_path):
    df = staging({"state": "Goa"}, {"state": "Delhi"}, {"state": "Kerala"})
    for i, start in enumerate(("", "\n", "\n  \n\n")):
        files.write_csv(df.where(F.col("order_id") == f"o{i}").coalesce(1), str(tmp_path / f"part{i}"))
        [part] = (tmp_path / f"part{i}").glob("*.csv")
        (tmp_path / f"{i}.csv").write_text(start + part.read_text())
    (tmp_path / "blank.csv").write_text("\n \n")
    back = files.read_orders_csv(spark, str(tmp_path / "*.csv"))
    assert sorted(r.state for r in back.collect()) == ["Delhi", "Goa", "Kerala"]
    with pytest.raises(FileNotFoundError):
        files.read_orders_csv(spark, str(tmp_path / "blank.csv"))
    (tmp_path / "3.csv").write_text("\t\n" + part.read_text())
    with pytest.raises(ValueError, match="order_id"):
        files.read_orders_csv(spark, str(tmp_path / "*.csv"))


def test_import_puts_every_row_in_orders_or_rejects(spark, staging, tmp_path):
    files.write_csv(staging({"state": "Goa"}).coalesce(1), str(tmp_path / "good"))
    [part] = (tmp_path / "good").glob("*.csv")
    header, good = part.read_text().splitlines()
    names, values = header.split(","), good.split(",")

    def line(**changes):
        return ",".join(changes.get(name, value) for name, value in zip(names, values, strict=True))

    bad = {
        line(order_id="b1", units_sold="many"): ["units_sold"],
        line(order_id="b2", order_date="2024-02-30", base_price="12345678901"): ["order_date", "base_price"],
        line(order_id="b3") + ",more": ["wrong number of values"],
        "b4,2024-01-05": ["wrong number of values"],
        line(order_id="b5", customer_age="   x  "): ["customer_age"],
    }
    fine = [good, line(order_id="n1", customer_age="", state=""), line(order_id="n2", units_sold=" 3 "), good]
    (tmp_path / "a.csv").write_text("\n".join([header, *fine[:2], *list(bad)[:3], ""]))
    # Another order of columns, a column more, and one whose name clashes with the reader's own.
    order = [1, 0, *range(2, len(names))]
    turned = [",".join([x.split(",")[i] for i in order] + ["extra"]) for x in [header, *fine[2:], list(bad)[4]]]
    (tmp_path / "b.csv").write_text("\n".join([turned[0].replace("extra", "_line"), *turned[1:], "", list(bad)[3]]))
    orders, rejects = files.import_orders_csv(spark, str(tmp_path / "*.csv"))
    assert orders.schema.simpleString() == STG_ORDERS.simpleString()
    assert sorted((r.order_id, r.units_sold) for r in orders.where("order_id = 'n2'").collect()) == [("n2", 3)]
    assert sorted(r.order_id for r in orders.collect()) == sorted(["n1", "n2", *[values[0]] * 2])
    got = rejects.collect()
    assert sorted(r.reasons for r in got) == sorted(bad.values())
    wrong = {r.line for r in got if r.reasons == ["wrong number of values"]}
    assert wrong == {line(order_id="b3") + ",more", "b4,2024-01-05"}
    assert {r.file.rsplit("/")[-1] for r in got if "units_sold" in r.reasons} == {"a.csv"}
    assert {r.file.rsplit("/")[-1] for r in got if "customer_age" in r.reasons} == {"b.csv"}
    (tmp_path / "none.csv").write_text(header + "\n")
    for result in files.import_orders_csv(spark, str(tmp_path / "none.csv")):
        assert not result.collect()
    (tmp_path / "short.csv").write_text("order_id,state\no1,Goa\n")
    with pytest.raises(ValueError, match="zone"):
        files.import_orders_csv(spark, str(tmp_path / "short.csv"))


def test_left_out_rows_are_reported(staging):
    report = model.load_report(staging({}, {"state": None}, {"sales_event": None}, {"customer_age": None}, {"order_id": "o0"}))
    found = {(r.rule, r["columns"]): r.violations for r in report.where("violations > 0").collect()}
    assert found == {
        ("not loaded", "state"): 1, ("not loaded", "sales_event"): 1,
        ("not loaded", "customer_age, customer_gender"): 1, ("unique", "order_id"): 1,
    }


def test_strict_load_writes_nothing(staging, tmp_path):
    with pytest.raises(ValueError, match="unique"):
        model.write_star(model.star(staging({"order_id": "x"}, {"order_id": "x"})), str(tmp_path / "star"), strict=True)
    assert not (tmp_path / "star").exists()


def test_registration_runs_no_job(spark, small_orders):
    spark.sparkContext.setJobGroup("registration", "views")
    registry.register_views(small_orders)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("registration")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not list(jobs)


def test_spelling_changes_no_report(staging):
    spellings = ("FESTIVAL", "festival", " Festival", "Normal")
    mixed = model.enrich(staging(*[{"sales_event": e, "order_id": f"o{i}"} for i, e in enumerate(spellings)]))
    clean = model.enrich(
        staging(*[{"sales_event": e.strip().capitalize(), "order_id": f"o{i}"} for i, e in enumerate(spellings)])
    )
    reports = (
        adhoc.event_revenue_per_order, adhoc.event_revenue_per_order_by_category, adhoc.festival_lift,
        adhoc.festival_lift_and_discount, adhoc.margin_risk_pockets, views.event_uplift_by_category,
        views.discount_response_quality, views.revenue_quality_risk_hotspots, whatif.results,
    )
    for report in reports:
        assert rows(report(mixed)) == rows(report(clean)), report.__name__
    assert adhoc.event_revenue_per_order(mixed).first().festival_revenue == 240


def test_order_table_round_trip(spark, small_staging, tmp_path):
    path = str(tmp_path / "orders")
    files.write_orders(small_staging, path)
    back = files.read_orders(spark, path)
    assert rows(back.select(STG_ORDERS.names)) == rows(small_staging)
    stored, derived = model.enrich(back), model.enrich(small_staging)
    assert rows(views.monthly_discount_band(stored)) == rows(views.monthly_discount_band(derived))


def test_summary_refresh(staging, orders, tmp_path):
    path = str(tmp_path / "summary")
    first = procedures.refresh_monthly_summary(
        orders({"order_date": "2023-02-01"}, {"order_date": "2024-01-05", "discount_percent": 33}), path
    )
    assert [(r.month_start, float(r.avg_discount)) for r in first.orderBy("month_start").collect()] == [
        (datetime.date(2023, 2, 1), 20.0), (datetime.date(2024, 1, 1), 33.0),
    ]
    changed = orders({"order_date": "2023-02-01", "units_sold": 9}, {"order_date": "2024-01-05", "units_sold": 9})
    part = procedures.refresh_monthly_summary(changed, path, years=[2024])
    assert [r.total_units for r in part.orderBy("month_start").collect()] == [1, 9]
    emptied = procedures.refresh_monthly_summary(changed.where("year = 2024"), path, years=[2023])
    assert [r.total_units for r in emptied.collect()] == [9]
    whole = procedures.refresh_monthly_summary(changed.where("year = 2024"), path)
    assert [r.total_units for r in whole.collect()] == [9]
    broken = changed.withColumn("revenue", F.raise_error(F.lit("fails midway")).cast("decimal(12,2)"))
    for years in (None, [2024]):
        with pytest.raises(Exception, match="fails midway"):
            procedures.refresh_monthly_summary(broken, path, years=years)
        assert [r.total_units for r in procedures.read_monthly_summary(whole.sparkSession, path).collect()] == [9]


def test_views_can_be_queried_in_sql(spark, small_staging, small_orders):
    names = registry.register_views(small_orders, model.star(small_staging))
    names += registry.refresh_ranked_views(small_orders)
    assert len(names) == 20
    assert spark.sql("SELECT discount_band(33)").first()[0] == "31-40%"
    top = spark.sql("SELECT max(total_revenue) AS r FROM v_risk_adjusted_summary WHERE revenue_rank = 1")
    assert top.first().r == small_orders.groupBy("state_name", "category", "brand_type").agg(
        F.sum("revenue").alias("r")
    ).agg(F.max("r")).first()[0]
    by_join = spark.sql(
        "SELECT st.state_name, SUM(f.revenue) AS r FROM fact_orders f "
        "JOIN dim_state st ON st.state_id = f.state_id GROUP BY st.state_name"
    )
    assert by_join.count() == 25


def test_state_performance_for_two_states(small_orders):
    for state in ("NATION_3", "NATION_21"):
        got = procedures.state_performance(small_orders, state).agg(F.sum("revenue")).first()[0]
        assert got == small_orders.where(F.col("state_name") == state).agg(F.sum("revenue")).first()[0]


def test_keys_are_found_without_sorting_the_orders(staging):
    """A sort in the scanning tasks holds five rows an order."""
    text = model._natural_keys(staging({}, {}))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in text and "Sort" not in text


def test_loads_read_the_tables_once(small_staging, monkeypatch):
    """The facts of two loads, from orders that were stored before."""
    seen = []
    load = model.load

    def noted(staging, *rest):
        seen.append(staging.inputFiles())
        return load(staging, *rest)

    monkeypatch.setattr(registry.model, "load", noted)
    facts = registry.FROM_STAGING["S06_appended_facts"](small_staging)
    assert facts.count() == small_staging.count()
    assert not set(small_staging.inputFiles()) & {file for files in seen for file in files}


def test_keys_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    """Repeated, null and uncounted keys over several tasks; their number follows the rows."""
    made = []
    kind = type(spark.range(0))
    repartition = kind.repartition
    monkeypatch.setattr(constraints, "KEYS_PER_TASK", 10)
    monkeypatch.setattr(kind, "repartition", lambda df, n, *keys: made.append(n) or repartition(df, n, *keys))
    df = spark.createDataFrame([(i % 40 if i < 90 else None, i) for i in range(95)], "a int, b int")
    rule = constraints.TableRules(["a"], [("a",), ("a", "b")])
    report = constraints.table_violations({"t": df}, "t", rule, F.col("b") != 3)
    assert made and set(made) == {10}
    assert rows(report) == sorted(
        [("t", "not null", "a", 5), ("t", "unique", "a", 40), ("t", "unique", "a, b", 0)], key=str
    )
