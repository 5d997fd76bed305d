"""Mixing against plain water-filling and its own promises."""

import random
from collections import defaultdict

import corpus
import pytest

from revq.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """sizes: source -> words. Deal out by weight, cap, deal the excess out again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ = {}, [s for s in order]
    rest = share * sum(sizes.values())
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not full:
            target |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            rest -= target[s]
            open_.remove(s)
    return target


def sample(seed, n=400, sources=7):
    rnd = random.Random(seed)
    names = [None, "é", "z", *(f"s{i}" for i in range(sources))]
    texts = [" ".join("w" * rnd.randint(1, 3) for _ in range(int(rnd.expovariate(1 / 30)))) for _ in range(n)]
    return texts, [rnd.choice(names[: rnd.randint(1, len(names))]) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken(spark, seed):
    texts, sources = sample(seed)
    rows = [(i, t, "en", s, 0) for i, (t, s) in enumerate(zip(texts, sources))]
    docs = spark.createDataFrame(rows, corpus.SCHEMA).repartition(5)
    got = mixing.mix(docs).collect()
    sizes, by_source = defaultdict(int), defaultdict(list)
    for t, s in zip(texts, sources):
        sizes[s] += len(corpus.words(t))
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == len(corpus.words(texts[r.doc_id])) and r.source == sources[r.doc_id]
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        by_source[r.source].append(r)
    for source, docs_of in by_source.items():
        # One document more or less would not come nearer.
        taken = sum(r.taken for r in docs_of)
        assert abs(taken - want[source]) <= max(r["size"] for r in docs_of) / 2 + 1e-6
        # Copies fall along the hash: there is one threshold per source.
        filled = sorted((r.hash, -r.copies) for r in docs_of)
        assert [c for _, c in filled] == sorted(c for _, c in filled)
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.coalesce(1)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_edges(spark):
    docs = corpus.clashing(corpus.documents(spark, ["a b", None, "", "a b", "c"], ids=[1, 2, None, 1, 5]))
    got = sorted(((r.doc_id, r["size"], r.taken) for r in mixing.mix(docs).collect()), key=str)
    assert [x[:2] for x in got] == [(1, 2), (1, 2), (2, 0), (5, 1), (None, 0)]
    assert got[0] == got[1]
    assert mixing.mix(corpus.documents(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(corpus.documents(spark, [None, ""])).collect()] == [0, 0]


def test_weights_of_one_and_exact_budgets(spark):
    docs = corpus.documents(spark, ["a b c d"] * 10, sources=["x", "y"])
    assert {(r.target, r.copies) for r in mixing.mix(docs, weights=(1,), share=1.0).collect()} == {(20.0, 1)}
    assert {(r.target, r.copies) for r in mixing.mix(docs, weights=(1,), share=2.0).collect()} == {(40.0, 2)}


def test_no_python_on_the_way(spark):
    plan = mixing.mix(corpus.documents(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))
