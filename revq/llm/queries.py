"""One query per corpus operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from revq.llm import (
    audit, classifier, jaccard, lines, mixing, neighbours, oracle, packing, periods, personal, rollups, rules,
    stats, substrings, tokens, urls,
)
from revq.llm.tables import table
from revq.llm.training import held_out
from revq.session import materialise, new_path


def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents"), 3, 9, 10)


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after loading all documents, recounting the poor ones without symbols, and taking out toxic ones.

    The second batch is sent twice, as after a failure.
    """
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    text = F.col("text")
    clean = F.translate(text, stats.SYMBOLS, "")
    counts = materialise(
        docs.select(
            "doc_id", "source", "lang",
            rollups.words(text).alias("words"), rollups.utf8_bytes(text).alias("bytes"),
            rollups.words(clean).alias("clean_words"), rollups.utf8_bytes(clean).alias("clean_bytes"),
        )
    )
    poor = counts.join(labels.where("quality = 0").select("doc_id").distinct(), "doc_id", "left_semi")
    toxic = counts.join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    by = {"words-1": F.col("words"), "bytes-1": F.col("bytes")}
    clean_by = {"words-1": F.col("clean_words"), "bytes-1": F.col("clean_bytes")}
    rollup = rollups.TokenRollup(spark, new_path(spark))
    rollup.commit("load", rollups.counted(counts, by))
    rollup.commit("recount", rollups.counted(poor, clean_by))
    rollup.commit("recount", rollups.counted(poor, clean_by))
    rollup.commit("retract", rollups.counted(toxic, by).withColumn("deleted", F.lit(True)))
    return rollup.totals()


def op2_loaded_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of all documents as they are: the state after the load alone."""
    text = F.col("text")
    by = {"words-1": rollups.words(text), "bytes-1": rollups.utf8_bytes(text)}
    rollup = rollups.TokenRollup(spark, new_path(spark))
    rollup.commit("load", rollups.counted(table(spark, folder, "documents"), by))
    return rollup.totals()


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op5_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return rules.judge(docs, rules.fit(docs, labels))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cut = lines.drop_repeated_lines(docs)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.judge(pages, urls.fit(pages))


def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = classifier.score(docs, classifier.fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    return audit.interactions(audit.audited(spark, f"{folder}/documents.parquet", labels))


def op12_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and digest of the plain spans; `spans` lists these and the disguised ones."""
    found = personal.find(table(spark, folder, "documents"))
    plain = F.filter("spans", lambda s: s["plain"])

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in personal.KINDS]
    added = (F.size("spans") - F.size(plain)).cast("long")
    return found.select(
        "doc_id", *counts, F.sha2(listed(plain), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        added.alias("n_disguised"),
    )


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document in ten repeats a stretch of its words to its end.

    Documents are chosen by a hash of the id; a null id is not chosen.
    """
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    seed = F.expr("h div 10")
    rows = docs.select("doc_id", "text", hashed.alias("h")).withColumn("chosen", F.coalesce(F.col("h") % 10 == 0, F.lit(False)))
    split = rows.withColumn("words", F.when(F.col("chosen"), tokens.word_list(F.col("text"))))
    sized = split.withColumns({"n": F.size("words"), "g": seed}).withColumn(
        "a", F.expr("CASE WHEN n > 0 THEN cast(g % n AS int) END")
    )
    period = sized.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) AS int)"))
    repeated = F.expr(
        "array_join(slice(concat(slice(words, 1, a), flatten(array_repeat(slice(words, a + 1, p), "
        "cast(ceil((n - a) / p) AS int)))), 1, n), ' ')"
    )
    return period.select("doc_id", F.when(F.col("chosen") & (F.col("n") > 0), repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periods.find(_with_planted_runs(table(spark, folder, "documents")))
    # Exact comparison of quotients; runs come by start and period, so ties keep the first.
    best = F.expr(
        "aggregate(runs, cast(null AS struct<start: bigint, length: bigint, period: bigint>), "
        "(b, r) -> if(b IS NULL OR r.length * b.period > b.length * r.period, r, b))"
    )
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return rows.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_token_counts": op2_token_counts,
    "op2_loaded_counts": op2_loaded_counts,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_quality_rules": op6_quality_rules,
    "op7_line_dedup": op7_line_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_source_mix": op10_source_mix,
    "op11_filter_audit": op11_filter_audit,
    "op12_personal_data": op12_personal_data,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = oracle.SQL
