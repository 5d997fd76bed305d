"""The random field against enumeration; accuracy on the held-out fold."""

import itertools
import zlib

import corpus
import numpy as np

from revq.llm import classifier, crf
from revq.llm.queries import QUERIES


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    lengths = np.array([1, 4, 0, 3, 6])
    score, ties = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    layout = crf.Layout(lengths)
    weight = rng.random(lengths.sum())
    got, pairs = crf.marginals(score, ties, layout, weight)
    want, want_pairs = np.zeros(lengths.sum()), np.zeros((2, 2))
    for a, b in itertools.pairwise(layout.first):
        total, sums, two = 0.0, np.zeros(b - a), np.zeros((2, 2))
        weights = weight[a + 1 : b]
        for states in itertools.product((0, 1), repeat=b - a):
            chance = np.exp(score[a:b] @ states + sum(ties[p] for p in itertools.pairwise(states)))
            total += chance
            sums += chance * np.array(states)
            for p, w in zip(itertools.pairwise(states), weights):
                two[p] += chance * w
        if b > a:
            want[a:b] = sums / total
            want_pairs += two / total
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_neighbours_stay_in_their_document():
    x = np.arange(1.0, 7.0)[:, None]
    got = crf.with_neighbours(x, crf.Layout(np.array([2, 0, 3, 1])))
    assert got.tolist() == [[1, 0, 2], [2, 1, 0], [3, 0, 4], [4, 3, 5], [5, 4, 0], [6, 0, 0]]


def test_one_line_is_read_by_its_neighbours():
    rng = np.random.default_rng(3)
    lengths = np.full(200, 8)
    good = rng.integers(0, 2, 200)
    x = np.repeat(good, 8)[:, None] + rng.normal(size=(1600, 1))
    chain = crf.fit(x, lengths, good)
    odd = np.array([1.0, 1, 1, -0.5, 1, 1, 1, 1])[:, None]
    p = crf.line_scores(chain, odd, crf.Layout(np.array([8])))
    alone = crf.line_scores(chain, odd[3:4], crf.Layout(np.array([1])))
    assert p[3] > alone[0] and p.min() > 0.5


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op9_quality_classifier"](spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    tested = [(labels[i], rows[i].predicted) for i in labels if rows[i].held_out]
    assert np.mean([a == b for a, b in tested]) > 0.97
    again = {r.doc_id: r.score for r in QUERIES["op9_quality_classifier"](spark, folder).collect()}
    assert again == {i: r.score for i, r in rows.items()}


def test_edges(spark):
    docs = spark.read.parquet(f"{corpus.SMALL}/documents.parquet")
    model = classifier.fit(docs, spark.read.parquet(f"{corpus.SMALL}/labels.parquet"))
    texts = [None, "", "\n\n\n", "x " * 200_000, "| | |\n" * 3000, "a plain line."]
    odd = corpus.clashing(corpus.documents(spark, texts, ids=[1, 2, 3, None, 4, 1]))
    rows = classifier.score(odd, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    carried = classifier.with_scores(odd, model)
    assert set(carried.columns) == set(odd.columns) and carried.count() == 6
    assert classifier.score(corpus.documents(spark, []), model).count() == 0
    none = classifier.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert none is None and {r.score for r in classifier.score(odd, none).collect()} == {1.0}
