"""Small corpora and plain-Python versions of what the operators compute."""

from __future__ import annotations

import random

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

# Rows with every kind of gap; the last columns clash with names the operators use inside.
CLASHING = ", block long, n long, node string, tokens string, hash long, size long, copies int, rank int, _id long, score int"


def words(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().split()]


def folded(text: str | None) -> str:
    return (text or "").translate({c: c + 32 for c in range(ord("A"), ord("Z") + 1)})


def documents(spark, texts, sources=None, schema=SCHEMA, ids=None):
    rows = [
        (i if ids is None else ids[i], t, "en", (sources or ["s"])[i % len(sources or ["s"])], None if t is None else len(t))
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, schema)


def clashing(docs):
    """The same documents with further columns, named as the operators name their own."""
    from pyspark.sql import functions as F

    for part in CLASHING.strip(", ").split(", "):
        name, kind = part.split()
        docs = docs.withColumn(name, F.lit(None).cast(kind))
    return docs


def copies(seed: int, families: int = 6, members: int = 12, length: int = 60, passage: bool = True) -> list[str]:
    """Families of near copies, each a base with random changes, and unrelated texts that share a passage."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 6)))
    shared = [word() for _ in range(20)]
    texts = []
    for _ in range(families):
        base = [word() for _ in range(length)]
        for _ in range(members):
            new = list(base)
            for _ in range(rnd.randint(0, 5)):
                new[rnd.randrange(len(new))] = word()
            texts.append(" ".join(new))
    for _ in range(families * 3):
        own = [word() for _ in range(rnd.randint(1, 40))]
        texts.append(" ".join(own + (shared if passage else [])))
    texts += texts[:3] + [None, "", " \t\n", "one", "one two", "One  TWO", "x y z"]
    rnd.shuffle(texts)
    return texts
