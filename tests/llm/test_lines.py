"""Line dedup against plain Python, and the runs it keeps."""

import random

import corpus
import pytest
from pyspark.sql import functions as F

from revq.llm import lines
from revq.llm.lines import LineRuns

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows, min_chars, min_docs):
    key = lambda line: corpus.folded(line.strip(BLANKS))
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        ls = (text or "").split("\n")
        kept = [
            x for x in ls
            if doc_id is None or len(holders.get(key(x), ())) < min_docs or doc_id == max(holders[key(x)])
        ]
        out.append((doc_id, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(docs, **more):
    rows = lines.drop_repeated_lines(docs, **more).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in rows), key=str)


def sample(seed):
    rnd = random.Random(seed)
    pool = [f"line number {i} " + "é" * rnd.randint(0, 12) for i in range(25)]
    texts = []
    for _ in range(120):
        parts = [rnd.choice(pool) if rnd.random() < 0.6 else str(rnd.random()) * 3 for _ in range(rnd.randint(0, 6))]
        texts.append("\n".join(rnd.choice(["", "  ", "\t"]) + (p.upper() if rnd.random() < 0.2 else p) for p in parts))
    return texts + [None, "", "\n", "\n\n"]


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (5, 3)])
def test_equals_plain_python(spark, batches, fanout):
    texts = sample(batches)
    got = found(corpus.documents(spark, texts), min_chars=20, min_docs=4, batches=batches, fanout=fanout)
    assert got == brute(list(enumerate(texts)), 20, 4)


def test_edges(spark):
    long = "x" * 50
    texts = [long, long, long, long, long, long + "\n" + long, None, long, long]
    ids = [1, 2, 3, 4, 5, 9, 7, None, 3]
    docs = corpus.clashing(corpus.documents(spark, texts, ids=ids))
    assert found(docs) == brute(list(zip(ids, texts)), 40, 5)
    assert lines.drop_repeated_lines(docs).columns[: len(docs.columns)] == [
        c for c in lines.drop_repeated_lines(docs).columns if c in docs.columns
    ]
    assert found(corpus.documents(spark, [])) == []


def test_runs_are_compacted_and_later_batches_see_them(spark):
    runs = LineRuns(spark, buckets=3, fanout=2)

    def batch(ids, keys):
        return spark.createDataFrame([(k, k, i) for i in ids for k in keys], "h1 long, h2 long, doc_id long")

    assert runs.add(batch([9], [1, 2])).where("keeper IS NULL").count() == 0
    runs.add(batch([7, 8], [2, 3]))
    third = runs.add(batch([5, 6], [3, 4]))
    assert {(r.h1, r.keeper) for r in third.collect()} == {(3, None), (4, 6)}
    assert [len(level) for level in runs.levels] == [1, 1]
    assert {r.h1: (r.docs, r.keeper) for r in runs.totals().collect()} == {1: (1, 9), 2: (3, 9), 3: (4, 8), 4: (2, 6)}
    runs.add(batch([1], [1]))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    runs.close()


def test_no_python_on_the_way(spark):
    cut = lines.drop_repeated_lines(corpus.documents(spark, sample(1))).select("doc_id", F.sha2("text", 256))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))
