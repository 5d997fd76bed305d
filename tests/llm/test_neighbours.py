"""Recall and exactness of the neighbour search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from revq.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>"


def exact(ids, x, own, k):
    distance = np.sqrt(((x - x[list(ids).index(own)]) ** 2).sum(axis=1))
    return [(int(ids[i]), float(distance[i])) for i in np.lexsort((ids, distance)) if ids[i] != own][:k]


def by_query(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


@pytest.mark.parametrize("clustered, scale", [(False, 1.0), (True, 1e-6), (True, 1e6)])
def test_recall(spark, monkeypatch, clustered, scale):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 700)
    monkeypatch.setattr(neighbours, "PORTION_ROWS", 20)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 32))
    if clustered:
        x = x * 0.2 + rng.standard_normal((20, 32))[rng.integers(0, 20, 2000)]
    x = (x * scale).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    found = by_query(neighbours.search(vectors, F.col("vec_id") % 50 == 0, 10).collect())
    ids, wide = np.arange(len(x)), x.astype(float)
    recall = []
    for own in range(0, 2000, 50):
        want = dict(exact(ids, wide, own, 10))
        assert len(found[own]) == 10
        recall.append(len(want.keys() & {v for v, _ in found[own]}) / 10)
        for v, score in found[own]:
            assert score == pytest.approx(float(np.sqrt(((wide[v] - wide[own]) ** 2).sum())), rel=1e-12)
    assert np.mean(recall) >= 0.95


def test_ties_gaps_and_few_candidates(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(200)] + [
        (300, None), (301, [0.0, 0.0, 0.0]), (302, [1.0, None, 2.0]), (303, [1.0, float("nan"), 2.0]),
        (304, [float("inf"), 1.0, 2.0]), (305, [1.0]), (None, same), (0, same),
    ]
    vectors = spark.createDataFrame(rows, SCHEMA).withColumns({"rank": F.lit(1), "x": F.lit("x"), "shard": F.lit(0)})
    found = by_query(neighbours.search(vectors, F.col("vec_id") % 100 == 0, 10).collect())
    assert found == {0: [(i, 0.0) for i in range(1, 11)], 100: [(i, 0.0) for i in range(10)]}
    few = by_query(neighbours.search(vectors.where("vec_id < 3"), F.col("vec_id") == 0, 10).collect())
    assert few == {0: [(1, 0.0), (2, 0.0)]}
    assert neighbours.search(vectors.limit(0), F.col("vec_id") == 0).count() == 0
