"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, folder) and returns a DataFrame that is written as
Parquet and read again as the next one's documents. All but the last return the
columns of documents; other columns of their input, whatever their names, are left out.
Rows repeat after the fourth stage, once per copy in the mix. An empty table passes
through all stages. What nulls, repeated rows and ties give is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revq.llm import classifier, jaccard, lines, mixing, packing
from revq.llm.tables import table
from revq.session import materialise, new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the line classifier does not reject.

    Each row is judged by its text alone, so repeated rows and texts share a verdict; a
    null text is judged as an empty one, and a null in any other column changes nothing.
    """
    model = classifier.fit(table(spark, folder, "documents"), table(spark, folder, "labels"))
    scored = classifier.with_scores(docs.select(COLUMNS), model, "_score")
    return scored.where(F.col("_score") >= classifier.LEAST_SCORE).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without the lines that many documents share.

    A null text becomes an empty one. Rows with one doc_id are one document: a line that
    they keep stays in each. Rows with a null doc_id keep all lines and count for none.
    """
    cut = lines.drop_repeated_lines(docs.select(COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of near copies (five words, similarity 0.8).

    It is the one with the smallest doc_id (a null is the last), then with the smallest
    hash of its text. Of rows that repeat it in both one stays, with the smallest of
    the other columns. Rows with one doc_id but different texts are documents of their
    own. Texts without words are in no group: all of their rows stay.
    """
    docs = docs.select(COLUMNS)
    copies = materialise(jaccard.copies(docs).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    kept = docs.join(copies.hint("shuffle_hash"), same, "left_anti")
    repeated = copies.where("first")
    if repeated.isEmpty():
        return kept
    once = (
        docs.join(repeated, same).groupBy("doc_id", "text")
        .agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest")).select("doc_id", "text", "rest.*")
    )
    return kept.unionByName(once)


def source_mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Repeated rows are taken alike. A null source is a source of its own, a null text has
    no words. Documents without words go or stay by their hash like all others.
    """
    return mixing.taken(docs.select(COLUMNS))


def sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Where every word of the mix lies in the packed sequences.

    Repeated rows are told apart by `copy`. A document without words has one row with no
    place. A null doc_id is packed like any other. Ties go by doc_id, copy and piece.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", sequences),
]

# The classifier's verdicts have no form in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of a folder, written to the shared folder between stages."""
    docs = table(spark, folder, "documents")
    work = new_path(spark)
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, folder).write.parquet(f"{work}/{number}")
        docs = spark.read.parquet(f"{work}/{number}")
    return docs
