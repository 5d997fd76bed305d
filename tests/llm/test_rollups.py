"""Delta-maintained totals against a recount, replays and failures."""

import random
from collections import Counter

import corpus
import pytest
from pyspark.sql import functions as F

from revq.llm import queries, rollups
from revq.llm.rollups import LEDGER, TokenRollup


def plain(batches):
    state = {}
    for batch in batches:
        now = {}
        for doc, tok, source, lang, tokens, deleted in batch:
            new = (deleted, tokens or 0, source or "", lang or "", source, lang)
            now[doc, tok] = max(now.get((doc, tok), new), new)
        state |= now
    docs, tokens = Counter(), Counter()
    for (_, tok), (deleted, n, _, _, source, lang) in state.items():
        if not deleted:
            docs[source, lang, tok] += 1
            tokens[source, lang, tok] += n
    return {k: (docs[k], tokens[k]) for k in docs}


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_random_batches_equal_a_recount(spark, tmp_path):
    rnd = random.Random(5)
    rollup, batches = TokenRollup(spark, str(tmp_path / "r")), []
    assert totals(rollup) == {}
    for i in range(4):
        batch = [
            (
                rnd.randint(0, 60), rnd.choice("vw"), rnd.choice(["a", "b", None]), "en",
                rnd.choice([None, 3, 10]), rnd.random() < 0.2,
            )
            for _ in range(80)
        ]
        batches.append(batch)
        assert rollup.commit(f"b{i}", spark.createDataFrame(batch, LEDGER))
        assert not rollup.commit(f"b{i}", spark.createDataFrame(batch[:10], LEDGER))
        assert totals(rollup) == plain(batches)
    assert rollup.batches() == ["b0", "b1", "b2", "b3"]
    assert totals(TokenRollup(spark, str(tmp_path / "r"))) == plain(batches)


def test_a_commit_that_fails_changes_nothing(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path / "r"))
    good = spark.createDataFrame([(1, "v", "s", "en", 5, False)], LEDGER)
    rollup.commit("one", good)
    bad = good.withColumn("source", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        rollup.commit("two", bad)
    assert rollup.batches() == ["one"] and totals(rollup) == {("s", "en", "v"): (1, 5)}
    with pytest.raises(ValueError):
        rollup.commit("../x", good)


def test_edges(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path / "r"))
    rollup.commit("empty", spark.createDataFrame([], LEDGER))
    assert totals(rollup) == {}
    rows = [(None, "v", None, None, 2, False)] * 2 + [(7, "v", "s", None, None, None), (8, "v", "s", None, 1, True)]
    rollup.commit("odd", spark.createDataFrame(rows, LEDGER).withColumn("seq", F.lit(9)))
    assert totals(rollup) == {(None, None, "v"): (2, 4), ("s", None, "v"): (1, 0)}


def test_tokenizers(spark):
    docs = corpus.documents(spark, ["a bé  c", None, "<|endoftext|> x"])
    counted = rollups.counted(docs, {"w": rollups.words(F.col("text")), "b": rollups.utf8_bytes(F.col("text"))})
    assert sorted((r.doc_id, r.tokenizer, r.tokens) for r in counted.collect()) == [
        (0, "b", 8), (0, "w", 3), (1, "b", 0), (1, "w", 0), (2, "b", 15), (2, "w", 2),
    ]
    path = "/opt/tokenizers/byte_bpe_50k.json"
    by_file = {r.doc_id: r.tokens for r in rollups.counted_by_file(docs, "bpe-50k", path).collect()}
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    texts = ["a bé  c", "", "<|endoftext|> x"]
    assert by_file == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_loaded_counts_hold_every_document(spark):
    docs = spark.read.parquet(f"{corpus.SMALL}/documents.parquet").collect()
    want = {}
    for d in docs:
        for name, n in (("words-1", len(corpus.words(d.text))), ("bytes-1", len((d.text or "").encode()))):
            k = (d.source, d.lang, name)
            want[k] = (want.get(k, (0, 0))[0] + 1, want.get(k, (0, 0))[1] + n)
    got = queries.QUERIES["op2_loaded_counts"](spark, corpus.SMALL).collect()
    assert {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in got} == want
