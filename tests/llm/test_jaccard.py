"""The similarity join against all pairs."""

from collections import Counter, defaultdict

import corpus
import pytest

from revq.llm import jaccard
from revq.llm.components import components


def brute(rows, size, numerator, denominator):
    sets = []
    for _, text in rows:
        w = corpus.words(corpus.folded(text))
        sets.append({tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for t in s for j in holders[t])
        for j, c in common.items():
            if denominator * c >= numerator * (len(s) + len(sets[j]) - c):
                parent[max(root(i), root(j))] = min(root(i), root(j))
        for t in s:
            holders[t].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return Counter((d, len(sets[i]), least.get(root(i), d)) for i, (d, _) in enumerate(rows))


def found(docs, *args, **more):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, *args, **more).collect())


@pytest.mark.parametrize("size, numerator, denominator, seed", [(3, 9, 10, 1), (5, 4, 5, 2), (2, 1, 2, 3), (3, 4, 5, 4)])
def test_equals_all_pairs(spark, size, numerator, denominator, seed):
    texts = corpus.copies(seed)
    docs = corpus.documents(spark, texts)
    # Small blocks, so that partners lie in different ones.
    got = found(docs, size, numerator, denominator, block_bytes=2000)
    assert got == brute(list(enumerate(texts)), size, numerator, denominator)


def test_large_family_meets_through_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 4)
    monkeypatch.setattr(jaccard, "QUERY_ROWS", 5)
    texts = corpus.copies(9, families=1, members=150, length=40)
    got = found(corpus.documents(spark, texts), 3, 4, 5, block_bytes=3000)
    assert got == brute(list(enumerate(texts)), 3, 4, 5)


def test_edges(spark):
    texts = ["a b c d", None, "", "a b c d", "A B C D", "a b c d", "q", "q", "long " * 3000 + "end"]
    ids = [5, 6, 7, 3, 9, 5, None, 8, 10]
    docs = corpus.clashing(corpus.documents(spark, texts, ids=ids))
    assert found(docs, 3, 9, 10) == brute(list(zip(ids, texts)), 3, 9, 10)


def test_empty_table(spark):
    assert not found(corpus.documents(spark, []), 3, 9, 10)


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(7, 7), (3, 2)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)}
    assert not components(spark.createDataFrame([], "a long, b long")).collect()
