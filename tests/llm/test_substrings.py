"""Substring dedup against every window of every document."""

import itertools
import random

import corpus
import pytest

from revq.llm import substrings


def brute(rows, size):
    """rows: (doc_id, text), ids distinct or None."""
    first = {}
    for doc_id, text in rows:
        w = corpus.words(text)
        for j in range(len(w) - size + 1):
            if doc_id is not None:
                k = tuple(w[j : j + size])
                first[k] = min(first.get(k, doc_id), doc_id)
    out = {}
    for doc_id, text in rows:
        w = corpus.words(text)
        gone = set()
        for j in range(len(w) - size + 1):
            if doc_id is not None and first[tuple(w[j : j + size])] < doc_id:
                gone.update(range(j, j + size))
        out[doc_id] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def found(docs, size, **more):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs, size, **more).collect()}


def passages(seed):
    rnd = random.Random(seed)
    pool = [[rnd.choice("abcdefghijklmnop") + str(rnd.randint(0, 50)) for _ in range(rnd.randint(5, 40))] for _ in range(12)]
    texts = []
    for _ in range(80):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            own = [str(rnd.random()) for _ in range(rnd.randint(1, 20))]
            parts += rnd.choice(pool)[rnd.randint(0, 3) :] if rnd.random() < 0.7 else own
        texts.append(rnd.choice([" ", "\n", "  "]).join(parts))
    return texts


def test_cover_meets_every_pair_of_positions():
    for i, j in itertools.product(range(substrings.PERIOD), repeat=2):
        assert any(
            (i + d) % substrings.PERIOD in substrings.COVER and (j + d) % substrings.PERIOD in substrings.COVER
            for d in range(substrings.PERIOD)
        )


@pytest.mark.parametrize("size, seed", [(13, 1), (13, 2), (20, 3)])
def test_equals_every_window(spark, size, seed):
    texts = passages(seed)
    ids = random.Random(seed).sample(range(-500, 500), len(texts))
    got = found(corpus.documents(spark, texts, ids=ids), size, block_bytes=1500)
    assert got == brute(list(zip(ids, texts)), size)


def test_edges(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    texts = [None, "", "a", passage, passage + " tail", passage, f"{passage} {passage}", passage.upper()]
    ids = [0, 1, 2, 9, 4, None, 5, 6]
    got = found(corpus.clashing(corpus.documents(spark, texts, ids=ids)), 13)
    assert got == brute(list(zip(ids, texts)), 13)
    assert got[9][1] == 15 and got[4][1] == 0 and got[None][1] == 0


def test_rows_with_the_same_id_and_an_empty_table(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    rows = substrings.remove_repeats(corpus.documents(spark, [passage] * 3, ids=[2, 2, 1])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 0), (2, 15), (2, 15)]
    assert substrings.remove_repeats(corpus.documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(corpus.documents(spark, []), 12)
