"""Samples for fitting: bounded, repeatable, outside the held-out fold."""

import zlib

import corpus

from revq.llm.training import labelled, sampled


def test_samples_are_bounded_and_repeatable(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    assert sampled(rows, ["doc_id"], 20_000).count() == 20_000
    some = {r.doc_id for r in sampled(rows, ["doc_id"], 2000).collect()}
    assert 1600 < len(some) <= 2000
    assert some == {r.doc_id for r in sampled(rows.repartition(7), ["doc_id"], 2000).collect()}


def test_only_labelled_documents_outside_the_fold(spark):
    docs = corpus.documents(spark, [f"text {i}" for i in range(300)])
    labels = spark.createDataFrame(
        [(i, i % 2 if i % 7 else None, 0) for i in range(400)] + [(None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int"
    )
    got = {r.doc_id: r.label for r in labelled(docs, labels, "quality", 1000).collect()}
    assert got == {i: i % 2 for i in range(300) if i % 7 and zlib.crc32(str(i).encode()) % 5}
