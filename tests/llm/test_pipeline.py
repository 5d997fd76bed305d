"""The pipeline's stages against plain Python, each on its own input; the registered queries."""

from collections import defaultdict

import compare
import corpus
import pytest
import test_jaccard
import test_lines

import __spark_entry__ as entry
import corpus_pipeline
from revq.llm import classifier, oracle, queries

COMPARE_TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and returned."""
    folder = str(tmp_path_factory.mktemp("stages"))
    docs, seen = spark.read.parquet(f"{corpus.SMALL}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, corpus.SMALL).write.parquet(f"{folder}/{i}")
        after = spark.read.parquet(f"{folder}/{i}")
        seen.append((docs, after))
        docs = after
    return seen


def texts(df):
    return [(r.doc_id, r.text) for r in df.orderBy("doc_id", "text").collect()]


def test_stage_columns(stages):
    for _, after in stages[:-1]:
        assert after.columns == corpus_pipeline.COLUMNS


def test_rejected_documents_go(spark, stages):
    before, after = stages[0]
    model = classifier.fit(before, spark.read.parquet(f"{corpus.SMALL}/labels.parquet"))
    kept = {r.doc_id for r in classifier.score(before, model).collect() if r.predicted}
    assert {i for i, _ in texts(after)} == kept and 0 < len(kept) < before.count()
    assert set(texts(after)) <= set(texts(before))


def test_repeated_lines_go(stages):
    before, after = stages[1]
    want = test_lines.brute(texts(before), 40, 5)
    assert texts(after) == sorted((i, text) for i, _, _, text in want)
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_one_of_each_group_stays(stages):
    before, after = stages[2]
    components = test_jaccard.brute(texts(before), 5, 4, 5)
    assert {i for i, _ in texts(after)} == {i for i, _, component in components if i == component}
    assert set(texts(after)) <= set(texts(before)) and after.count() < before.count()


def test_sources_are_mixed(stages):
    before, after = stages[3]
    size = {i: len(corpus.words(t)) for i, t in texts(before)}
    source = {r.doc_id: r.source for r in before.collect()}
    total = defaultdict(int)
    for i, n in size.items():
        total[source[i]] += n
    from test_mixing import plain_targets

    target, taken, rows = plain_targets(total), defaultdict(int), defaultdict(int)
    for i, _ in texts(after):
        taken[source[i]] += size[i]
        rows[i] += 1
    assert max(rows.values()) <= 2
    for s in total:
        assert abs(taken[s] - target[s]) <= max(n for i, n in size.items() if source[i] == s) / 2 + 1e-6


def test_every_word_is_packed(stages):
    before, after = stages[4]
    want = sorted((i, len(corpus.words(t))) for i, t in texts(before))
    got = defaultdict(int)
    for r in after.collect():
        got[r.doc_id, r.copy] += r["size"]
    assert sorted((i, n) for (i, _), n in got.items()) == want


def gaps(spark):
    """Nulls in every column, repeated rows, ties, ids with several texts, empty and long texts, clashing columns."""
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    near = a.replace("w30", "x")
    rows = [
        (1, a, "en", "s"), (1, a, "en", "s"), (None, a, "de", None), (2, a, None, "t"), (2, b, "en", "t"),
        (3, near, "en", "s"), (None, b, "en", "s"), (None, b, "en", "s"), (4, None, None, None), (4, None, None, None),
        (5, "", "en", "s"), (6, " \n", "en", "t"), (7, "one two", "en", "t"), (7, "one two", "en", "s"),
        (8, "long " * 30_000, "en", "s"), (None, None, None, None),
    ]
    table = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], corpus.SCHEMA)
    return rows, corpus.clashing(table)


def test_gaps(spark):
    rows, docs = gaps(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, corpus.SMALL).columns == corpus_pipeline.COLUMNS
    kept = corpus_pipeline.near_dedup(spark, docs, corpus.SMALL)
    assert sorted(((r.doc_id, (r.text or "")[:7], r.source) for r in kept.collect()), key=str) == sorted([
        (1, "w0 w1 w", "s"), (2, "v0 v1 v", "t"), (4, "", None), (4, "", None), (5, "", "s"), (6, " \n", "t"),
        (7, "one two", "s"), (8, "long lo", "s"), (None, "", None),
    ], key=str)
    verdict = {}
    for r in corpus_pipeline.quality(spark, docs, corpus.SMALL).collect():
        verdict[r.text] = verdict.get(r.text, 0) + 1
    assert all(n == sum(t == text for _, t, *_ in rows) for text, n in verdict.items())
    cut = corpus_pipeline.line_dedup(spark, docs, corpus.SMALL).collect()
    assert sorted((r.doc_id or 0, r.text) for r in cut) == sorted((i or 0, t or "") for i, t, *_ in rows)
    mixed = corpus_pipeline.source_mix(spark, docs, corpus.SMALL).collect()
    times = defaultdict(int)
    for r in mixed:
        times[r.doc_id, r.text, r.source] += 1
    given = defaultdict(int)
    for i, t, _, s in rows:
        given[i, t, s] += 1
    assert mixed and all(n % given[k] == 0 and n <= 2 * given[k] for k, n in times.items())
    packed = defaultdict(int)
    for r in corpus_pipeline.sequences(spark, docs, corpus.SMALL).collect():
        packed[r.doc_id, r.copy] += r["size"]
    assert sum(packed.values()) == sum(len(corpus.words(t)) for _, t, *_ in rows)


def test_empty_table(spark):
    empty = corpus.documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, corpus.SMALL).collect() == []


def test_run_equals_its_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, corpus.SMALL).collect()), key=str) == sorted(
        map(tuple, stages[-1][1].collect()), key=str
    )


def test_all_operators_are_registered():
    assert {k.split("_")[0] for k in queries.QUERIES} == {*(f"op{n}" for n in range(1, 14)), "pipeline"}
    assert set(queries.QUERIES) <= set(entry.queries()) and set(oracle.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", oracle.SQL)
def test_equal_to_sql(spark, name, monkeypatch):
    monkeypatch.setattr(compare, "TABLES", compare.TABLES + COMPARE_TABLES)
    ours = compare.spark_rows(queries.QUERIES[name](spark, corpus.SMALL))
    assert ours[1]
    assert compare.difference(ours, compare.duck_rows(compare.connect(corpus.SMALL), oracle.SQL[name])) is None
