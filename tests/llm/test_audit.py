"""The filter audit against plain Python, in any order of files and batches."""

import random
from collections import Counter
from itertools import permutations

import corpus
import pytest
from pyspark.sql import functions as F

from revq.llm import audit


def fails(text):
    words = corpus.words(text)
    out = {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
        "D": any(c in "#$%&*|" for c in text),
    }
    return sum(1 << i for i, failed in enumerate(out.values()) if failed)


def brute_counters(rows, labels):
    """rows: (doc_id, text, lang); labels: doc_id -> (good, toxic)."""
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    counts = Counter()
    for doc_id, text, lang in rows:
        copy = doc_id is not None and doc_id > least[text or ""]
        counts[(lang or "", fails(text or "") | 16 * copy, *labels.get(doc_id, (0, 0)))] += 1
    return counts


def texts(rnd, n):
    pool = []
    for _ in range(n):
        words = [rnd.choice("abcdefgh") * rnd.randint(1, 3) + rnd.choice(["", "é", "#", "X", "|"] + [""] * 9)
                 for _ in range(rnd.choice([0, 1, 20, 90, 110, 140]))]
        if rnd.random() < 0.4:
            words = [w + str(i) for i, w in enumerate(words)]
        pool.append(rnd.choice([" ", "\n", " \t"]).join(words))
    return pool + [None, "", "A" * 30, "A b c d e f g h i j"]


def sample(seed):
    rnd = random.Random(seed)
    pool = texts(rnd, 25)
    rows = [(rnd.randrange(300), rnd.choice(pool), rnd.choice(["en", "de", None, ""])) for _ in range(400)]
    rows += [(None, rnd.choice(pool), "en") for _ in range(8)] + [rows[0]] * 3
    rows += [(2**60 + i, pool[0], "en") for i in (0, 1)] + [(-5, pool[1], "fr")]
    rnd.shuffle(rows)
    labels = {i: (rnd.randint(0, 1), rnd.randint(0, 1)) for i in range(0, 300, 2)} | {-5: (1, 1)}
    return rows, labels


def write_files(spark, rows, path, files):
    """One file per part of the rows; the stream takes files in the order they were written."""
    for i in range(files):
        part = rows[i::files]
        docs = corpus.documents(spark, [t for _, t, _ in part], ids=[d for d, _, _ in part])
        langs = [lang for _, _, lang in part]
        docs = spark.createDataFrame([(*r[:2], lang, *r[3:]) for r, lang in zip(docs.collect(), langs)], corpus.SCHEMA)
        corpus.clashing(docs).withColumn("mask", F.lit("x")).withColumn("key", F.lit(1)).coalesce(1).write.mode("append").parquet(path)


def label_table(spark, labels):
    rows = [(i, g, t) for i, (g, t) in labels.items()]
    rows += [(None, 1, 1), (1, 0, 0), (1, None, 1)] + [(i, 0, 0) for i in labels]
    labels[1] = (labels.get(1, (0, 0))[0], 1)
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def counted(df):
    return Counter({(r.part, r.mask, r.good, r.toxic): r.docs for r in df.collect()})


@pytest.mark.parametrize("seed, files, batches", [(1, 1, 1), (2, 5, 5), (3, 5, 2)])
def test_counters(spark, tmp_path, seed, files, batches):
    rows, labels = sample(seed)
    marks = label_table(spark, labels)
    write_files(spark, rows, str(tmp_path / "docs"), files)
    got = counted(audit.audited(spark, str(tmp_path / "docs"), marks, batches=batches))
    assert got == brute_counters(rows, labels)


def test_later_files_retract(spark, tmp_path):
    """Descending ids: every batch makes copies of what was counted before."""
    path, marks = str(tmp_path / "docs"), label_table(spark, {})
    stream = audit.FilterAudit(spark, path, marks, "lang", str(tmp_path / "audit"))
    rows = []
    for batch, ids in enumerate([(9, 9, 8), (7, 3), (5, 3, 1)]):
        new = [(i, "same text", "en" if i % 2 else "de") for i in ids]
        rows += new
        write_files(spark, new, path, 1)
        stream.update(files_per_batch=1)
        assert counted(stream.counters()) == brute_counters(rows, {1: (0, 1)}), batch
    changes = spark.read.parquet(str(tmp_path / "audit/changes"))
    assert changes.where("docs < 0").count() >= 2
    stream.update(files_per_batch=1)  # nothing new: nothing counted twice
    assert counted(stream.counters()) == brute_counters(rows, {1: (0, 1)})


def test_interactions(spark, tmp_path):
    rows, labels = sample(7)
    counts = brute_counters(rows, labels)
    table = spark.createDataFrame([(*k, n) for k, n in counts.items()], audit.CHANGES)
    got = sorted(map(tuple, audit.interactions(table).collect()))
    want, shapley = [], Counter()
    for part in {k[0] for k in counts}:
        mine = [(m, g, t, n) for (p, m, g, t), n in counts.items() if p == part]
        for order in permutations("ABCDE"):
            earlier = 0
            for step, name in enumerate(order, 1):
                bit = 1 << "ABCDE".index(name)
                removed = [(m, g, t, n) for m, g, t, n in mine if m & bit and not m & earlier]
                want.append([
                    part, "".join(order), step,
                    sum(n for m, _, _, n in mine if not m & (bit | earlier)),
                    sum(n for *_, n in removed),
                    sum(n for m, _, _, n in mine if m & bit and m & earlier),
                    sum(n for m, _, _, n in mine if m == bit),
                    sum(n for _, g, _, n in removed if g), sum(n for _, _, t, n in removed if t),
                ])
                shapley[part, name] += want[-1][4]
                earlier |= bit
    assert got == sorted((*w, shapley[w[0], w[1][w[2] - 1]]) for w in want)


def test_empty_table(spark, tmp_path):
    corpus.documents(spark, []).write.parquet(str(tmp_path / "docs"))
    counters = audit.audited(spark, str(tmp_path / "docs"), label_table(spark, {}))
    assert audit.interactions(counters).collect() == []


def test_copies_are_combined_before_they_meet():
    import pyarrow as pa

    n = 1000
    batch = pa.RecordBatch.from_pydict({
        "bucket": [5] * n, "key": [b"k"] * n, "doc_id": list(range(n, 0, -1)), "part": ["en"] * n,
        **{name: pa.array([value] * n, pa.int32()) for name, value in (("mask", 1), ("good", 0), ("toxic", 0))},
    })
    (out,) = audit._combine(iter([batch]))
    same = {"bucket": 5, "part": "en", "good": 0, "toxic": 0}
    assert sorted(out.to_pylist(), key=lambda r: r["docs"]) == [
        same | {"key": b"k", "doc_id": 1, "mask": 1, "docs": 1},
        same | {"key": None, "doc_id": 0, "mask": 17, "docs": n - 1},
    ]
