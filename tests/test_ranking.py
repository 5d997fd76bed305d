"""Distributed ranks equal plain windows."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from revq.operators import ranking
from revq.operators.ranking import with_global_ranks

DENSE = {"by_x": [("x", "desc")], "by_xy": [("x", "desc"), ("y", "asc")]}
TOTAL_ORDER = [("x", "desc"), ("id", "asc")]


def table(spark, rows, seed, hot=0.0):
    rnd = random.Random(seed)

    def value():
        return 7 if rnd.random() < hot else rnd.choice([None, *range(20)])

    data = [(i, value(), rnd.choice([None, 0.25, 0.5, 1.0])) for i in range(rows)]
    return spark.createDataFrame(data, "id int, x int, y double").repartition(5)


def with_ranks(df):
    return with_global_ranks(df, DENSE, {"tile": (4, TOTAL_ORDER)}, {"n": TOTAL_ORDER})


def by_id(df):
    return {r["id"]: (r["by_x"], r["by_xy"], r["tile"], r["n"]) for r in df.collect()}


def ranked(df):
    return by_id(with_ranks(df))


@pytest.mark.parametrize("rows, hot", [(0, 0), (1, 0), (3, 0), (10, 0), (997, 0), (1000, 0.4)])
def test_equal_to_plain_windows(spark, rows, hot):
    df = table(spark, rows, seed=rows, hot=hot)
    by_x, total = Window.orderBy(F.desc("x")), Window.orderBy(F.desc("x"), F.asc("id"))
    plain = df.withColumns(
        {
            "by_x": F.dense_rank().over(by_x),
            "by_xy": F.dense_rank().over(Window.orderBy(F.desc("x"), F.asc("y"))),
            "tile": F.ntile(4).over(total),
            "n": F.row_number().over(total),
        }
    )
    got = ranked(df)
    assert len(got) == rows
    assert got == by_id(plain)


def test_rank_tables_hold_no_join_and_no_window_over_rows(spark, monkeypatch):
    written = []
    write = ranking.materialise
    monkeypatch.setattr(ranking, "materialise", lambda df: written.append(df) or write(df))
    text = executed(with_ranks(table(spark, 50, seed=4)))
    for df in written:
        assert "Join" not in executed(df) and "Window" not in executed(df)
    windows = re.findall(r"windowspecdefinition\(([^)]*)", text)
    assert windows and all(w.startswith("_task") for w in windows)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()



def test_tile_sizes_differ_by_one_at_most(spark):
    tiles = [v[2] for v in ranked(table(spark, 1001, seed=2)).values()]
    sizes = [tiles.count(k) for k in (1, 2, 3, 4)]
    assert sizes == [251, 250, 250, 250]


def test_no_gaps(spark):
    ranks = {v[0] for v in ranked(table(spark, 800, seed=3)).values()}
    assert ranks == set(range(1, len(ranks) + 1))
