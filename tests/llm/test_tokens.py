"""Words, hashes and windows against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from revq.llm import stats, tokens

TEXTS = st.lists(st.one_of(st.none(), st.text("aAbé \t\n\x0b\x0c\r  |", max_size=40)), max_size=8)


def plain(text):
    return (text or "").encode().split()


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_bytes_split(texts):
    found = tokens.find_words(pa.array(texts, pa.string()))
    got = [[] for _ in texts]
    for a, b, d in zip(found.start, found.end, found.doc):
        got[d].append(found.data[a:b].tobytes())
    assert got == [plain(t) for t in texts]
    assert found.count.tolist() == [len(plain(t)) for t in texts]
    assert found.place.tolist() == [i for t in texts for i in range(len(plain(t)))]


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_equal_words_and_only_they_have_equal_hashes(texts):
    found = tokens.find_words(pa.array(texts, pa.string()))
    flat = [w for t in texts for w in plain(t)]
    for fold in (False, True):
        names = [w.lower() if fold else w for w in flat]
        assert len(set(zip(names, found.hashes(fold).tolist()))) == len(set(names)) == len(set(found.hashes(fold).tolist()))


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    text = pa.array(["alpha beta  gamma " * 50, "beta", "x" * 5000])
    whole = tokens.find_words(text).hashes()
    monkeypatch.setattr(tokens, "_PIECE", 16)
    assert (tokens.find_words(text).hashes() == whole).all()


def test_sliced_and_chunked_columns():
    column = pa.chunked_array([pa.array(["a b", None]), pa.array(["c", "d e f"])]).slice(1, 3)
    assert tokens.find_words(column).count.tolist() == [0, 1, 3]
    assert tokens.find_words(pa.array([], pa.string())).count.tolist() == []


def test_windows_stay_inside_a_text():
    found = tokens.find_words(pa.array(["a b c", "a b", "c a b c"]))
    keys, at = found.windows(found.hashes(), 3)
    assert at.tolist() == [0, 5, 6]
    assert keys[0] == keys[2] != keys[1]


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (0, 10, 50, 3, 3, 90)] + [None]})
    parts = list(tokens.slices(batch, most=20))
    assert sum(p.num_rows for p in parts) == 7 and len(parts) > 2


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_lines(texts):
    found = tokens.find_words(pa.array(texts, pa.string()))
    start, end, doc = stats.line_bounds(found)
    got = [[] for _ in texts]
    for a, b, d in zip(start, end, doc):
        got[d].append(found.data[a:b].tobytes().decode())
    assert got == [(t or "").split("\n") for t in texts]
    repeats = [
        sum(bool(plain(x)) and x in lines[:i] for i, x in enumerate(lines)) for lines in got
    ]
    assert stats.repeated_lines(found).tolist() == repeats
    c = stats.counts(found, found.hashes(), start, end)
    flat = [x for lines in got for x in lines]
    assert c["chars"].tolist() == [len(x) for x in flat]
    assert c["words"].tolist() == [len(plain(x)) for x in flat]
    assert c["repeats"].tolist() == [len(plain(x)) - len(set(plain(x))) for x in flat]
    assert np.all(c["word_chars"] == [sum(len(w.decode()) for w in plain(x)) for x in flat])
