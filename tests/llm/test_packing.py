"""Packing against a plain best fit, and what must hold for any packing."""

import random
from collections import defaultdict

import corpus
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from revq.llm import packing

LENGTHS = (8, 16, 40)
COST = lambda c: c + 3 + c * c / 100


def plain(sizes, lengths, cost):
    """Best fit by looking at every open bin."""
    bins, left = [], sum(sizes)  # [room, used]
    where = []
    for size in sizes:
        open_ = [(room, -i) for i, (room, _, _) in enumerate(bins) if room >= size]
        if open_:
            room = min(open_)[0]
            last = max((turn, i) for i, (r, _, turn) in enumerate(bins) if r == room)[1]
            where.append((last, bins[last][1]))
            bins[last] = [room - size, bins[last][1] + size, len(where)]
        else:
            _, c = min((cost(c) / min(c, left), c) for c in lengths if c >= size)
            where.append((len(bins), 0))
            bins.append([c - size, size, len(where)])
        left -= size
    final = [min(c for c in lengths if c >= used) for _, used, _ in bins]
    return [(b, p, final[b]) for b, p in where]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_equals_plain_best_fit(sizes):
    sizes = sorted(sizes, reverse=True)
    assert list(zip(*map(list, packing.best_fit(sizes, LENGTHS, COST)))) == plain(sizes, LENGTHS, COST)


def test_last_bins_are_small_and_all_lengths_are_weighed():
    assert packing.best_fit([5], LENGTHS, COST)[2].tolist() == [8]
    assert set(packing.best_fit([30, 16, 16, 8, 8, 8, 2], LENGTHS, COST)[2].tolist()) <= set(LENGTHS)


@pytest.mark.parametrize("group_words", [50, 100_000])
def test_every_word_lies_in_one_place(spark, group_words):
    rnd = random.Random(3)
    counts = [rnd.choice([0, 1, 3, 8, 9, 39, 40, 41, 200]) for _ in range(150)]
    docs = corpus.documents(spark, [" ".join(["w"] * c) for c in counts])
    rows = packing.pack(docs, LENGTHS, COST, group_words).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.first_word, r["size"]))
        if r["size"]:
            by_bin[r.bin_group, r.bin_number].append((r.position, r["size"], r.bin_length))
        else:
            assert r.bin_number is None
    for i, count in enumerate(counts):
        pieces = sorted(by_doc[i])
        assert sum(n for _, n in pieces) == count
        assert [a for a, _ in pieces] == [40 * k for k in range(len(pieces))] and len(pieces) == max(1, -(-count // 40))
    for content in by_bin.values():
        end = 0
        for position, size, length in sorted(content):
            assert position == end
            end += size
        assert length == min(c for c in LENGTHS if c >= end)


def test_edges(spark):
    docs = corpus.clashing(corpus.documents(spark, ["a b", "a b", None, "c d e", ""], ids=[1, 1, 2, None, 3]))
    rows = packing.pack(docs, LENGTHS, COST).collect()
    assert sorted(((r.doc_id, r.copy, r["size"]) for r in rows), key=str) == sorted(
        [(1, 1, 2), (1, 2, 2), (2, 1, 0), (None, 1, 3), (3, 1, 0)], key=str
    )
    assert packing.pack(corpus.documents(spark, [])).count() == 0
