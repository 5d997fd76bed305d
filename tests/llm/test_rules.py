"""Quality rules against plain Python; the trees' promises; held-out accuracy."""

import re
import zlib
from collections import Counter

import corpus
import numpy as np
import pytest

from revq.llm import boosting, rules
from revq.llm.queries import QUERIES


def plain(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = corpus.words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if corpus.words(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    covered = {i for j in range(len(w) - 7) if windows[tuple(w[j : j + 8])] > 1 for i in range(j, j + 8)}
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered),
        len(w) < 20 or 100 * len(covered) > 30 * len(w),
    )


def test_counts_of_all_documents_and_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: tuple(r) for r in QUERIES["op6_quality_rules"](spark, folder).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    assert all(got[i][1:7] == plain(t) for i, t in texts.items())
    assert not any(r[7] for r in got.values() if r[6])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    tested = [(q, got[i][7]) for i, q in labels.items() if zlib.crc32(str(i).encode()) % 5 == 0 and not got[i][6]]
    assert len(tested) > 40 and np.mean([q == kept for q, kept in tested]) > 0.97


def test_edges(spark):
    repeated = "one two three four five six seven eight " * 5
    texts = [None, "", "\n\n", "short", repeated, "é# | a\n\né# | a\n a", "x " * 30_000, "line\nline\nline"]
    docs = corpus.clashing(corpus.documents(spark, texts, ids=[1, 2, 3, 4, 5, 6, None, 8]))
    got = Counter(tuple(r)[:8] for r in rules.judge(docs, None).collect())
    ids = [1, 2, 3, 4, 5, 6, None, 8]
    assert got == Counter((i, *plain(t), not plain(t)[5]) for i, t in zip(ids, texts))
    assert rules.judge(corpus.documents(spark, []), None).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(None, 0, 0), (1, None, 0)]])
def test_labels_without_two_classes(spark, labels):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert rules.fit(corpus.documents(spark, ["a b", "c"]), table) is None


def test_trees_learn_and_keep_their_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (rng.random(3000) < 0.1) | (x[:, 1] > 0.9)).astype(float)
    # The second feature truly raises the label; it is held to fall or not at all.
    trees = boosting.fit(x, y, np.array([1, -1, 0, 0]))
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.85
    line = np.repeat(rng.random((40, 4)), 50, axis=0)
    for feature, sign in ((0, 1), (1, -1)):
        moved = line.copy()
        moved[:, feature] = np.tile(np.linspace(0, 1, 50), 40)
        p = trees.probability(moved).reshape(40, 50)
        assert (sign * np.diff(p, axis=1) >= -1e-12).all()


def test_flat_nodes_equal_a_walk_down_each_tree():
    rng = np.random.default_rng(1)
    x = rng.random((500, 3))
    trees = boosting.fit(x, (x.sum(axis=1) > 1.5).astype(float), np.zeros(3), trees=10)

    def walk(row):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                low = row[trees.feature[node]] <= trees.threshold[node]
                node = trees.left[node] if low else trees.right[node]
            total += trees.value[node]
        return total

    assert np.allclose(trees.logit(x[:50]), [walk(r) for r in x[:50]])
