"""Periodic runs against plain Python."""

import hashlib
import random
import zlib

import corpus
import numpy as np
import pytest

from revq.llm import periods, queries


def brute(codes, least=24):
    """Every stretch of each period, kept where the period is its smallest."""
    n, out = len(codes), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and codes[j] == codes[j + q]:
                j += 1
            start, length = i, j - i + q
            if length >= max(least, 3 * q) and not any(
                all(codes[k] == codes[k + d] for k in range(start, start + length - d)) for d in range(1, q)
            ):
                out.append((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(seed):
    """Random words, powers, powers of powers, and runs with a changed word."""
    rnd = random.Random(seed)
    out = []
    for _ in range(40):
        base = [rnd.randrange(3) for _ in range(rnd.randint(1, 12))]
        inner = base * rnd.randint(1, 12)
        whole = (inner + [rnd.randrange(4) for _ in range(rnd.randint(0, 3))]) * rnd.randint(1, 6)
        cut = whole[rnd.randrange(len(whole)) :] if rnd.random() < 0.5 else whole
        row = [rnd.randrange(3) for _ in range(rnd.randint(0, 20))] + cut + [rnd.randrange(3) for _ in range(9)]
        if rnd.random() < 0.4:
            row[rnd.randrange(len(row))] = 9
        out.append(row[:400])
    return out + [[], [1], [1] * 23, [1] * 24, [1] * 300, [1, 2] * 200, list(range(50)) * 3, list(range(50)) * 2]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_plain_python(seed):
    for row in sequences(seed):
        assert periods.runs_in(np.array(row, np.int64), len(row)) == brute(row), row


def test_random_letters_of_a_small_alphabet():
    for seed in range(60):
        rnd = random.Random(seed)
        row = [rnd.randrange(1 + seed % 2) for _ in range(rnd.randint(20, 200))]
        assert periods.runs_in(np.array(row, np.int64), len(row)) == brute(row)


def test_suffixes_and_range_successors():
    rnd = np.random.default_rng(3)
    codes = rnd.integers(0, 2, 300)
    suffixes = periods.SuffixArray(codes, 4)
    for level in range(5):
        m = 1 << level
        low, high = suffixes.ranges(level)
        for b, (x, y) in enumerate(zip(low, high)):
            block = codes[b * m : b * m + m]
            same = [i for i in range(len(codes) - m + 1) if (codes[i : i + m] == block).all()]
            assert sorted(suffixes.order[x:y]) == same
    matrix = periods.WaveletMatrix(suffixes.order)
    low = rnd.integers(0, 300, 500)
    high = np.array([rnd.integers(x, 301) for x in low])
    value = rnd.integers(0, 301, 500)
    below = matrix.count_below(low, high, value)
    assert below.tolist() == [int((suffixes.order[a:b] < v).sum()) for a, b, v in zip(low, high, value)]
    held = high > low
    k = np.array([rnd.integers(0, n) for n in (high - low)[held]])
    assert matrix.nth(low[held], high[held], k).tolist() == [
        int(np.sort(suffixes.order[a:b])[i]) for a, b, i in zip(low[held], high[held], k)
    ]


def kept(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_documents(spark):
    texts = [
        "a b " * 20, None, "", " \n\t ", "one", "é\x0bü " * 30, "x " * 5000, "p q r s t u v w " * 3,
        "a b " * 20, "no run in here at all", "w " * 23, " ".join(map(str, range(3000))),
        " ".join(" ".join(f"u{i}" for i in range(700)) for _ in range(4)) + " end",
    ]
    ids = [5, 1, 2, 3, None, 6, 7, 8, 5, 9, 10, 11, 12]
    docs = corpus.clashing(corpus.documents(spark, texts, ids=ids))
    got = sorted(
        ((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.find(docs).collect()), key=str
    )
    want = []
    for i, t in zip(ids, texts):
        ws = corpus.words(t)
        small = len(ws) < 500 or len(set(ws)) == 1
        runs = brute(ws) if small and len(ws) < 500 else ([(0, 5000, 1)] if i == 7 else [(0, 2800, 700)] if i == 12 else [])
        want.append((i, len(ws), runs, kept(ws, runs)))
    assert got == sorted(want, key=str)
    assert periods.find(corpus.documents(spark, [])).collect() == []


def planted(doc_id, words):
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    words = planted(doc_id, corpus.words(text))
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(kept(words, runs)),
    )


def test_query(spark):
    rows = queries.op13_periodic_runs(spark, corpus.SMALL)
    got = sorted(map(tuple, rows.collect()))
    docs = spark.read.parquet(f"{corpus.SMALL}/documents.parquet").collect()
    short = {r.doc_id for r in docs if len(corpus.words(r.text)) <= 900}
    assert [r for r in got if r[0] in short] == sorted(digest(r.doc_id, r.text) for r in docs if r.doc_id in short)
    assert len(got) == len(docs) and len(short) > 150 and sum(r[1] > 0 for r in got) > 5


def test_query_gaps(spark, tmp_path):
    ids = [*range(200), 4, None, None]
    texts = ["w " * (i % 90) + f"x{i} y" for i in range(200)] + ["w " * 30, "w " * 30, None]
    corpus.documents(spark, texts, ids=ids).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((digest(i, t) for i, t in zip(ids, texts)), key=str)
