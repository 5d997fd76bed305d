"""Mix sources to target weights by thresholds on a hash of each document.

Every source has a target of words. A document is taken once for every whole time
its source's words fit the target, and once more if its hash lies below the source's
threshold. The threshold comes from sums of words by source and hash bucket: the
first level splits the hash range of each source into 4,096 buckets, and every
further level splits only the bucket in which the budget ends, until that bucket
holds one hash value. Nothing is sorted but bucket sums, and nothing is drawn at
random, so reruns agree.

All of it is DataFrame functions. A hot source is summed inside the scanning tasks.

A null text has size 0. A null source is a source of its own, the last. Sources
without words have the target 0. Repeated rows of a document are taken alike. An
empty table gives an empty result. Input columns other than doc_id, text and source
are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revq.llm.tokens import BLANKS
from revq.operators.ranking import with_global_ranks
from revq.session import materialise

# Bits of the hash that each level adds. Later levels see one bucket of a source only, so that
# most of their buckets hold one document and hardly ever a third level is needed.
LEVEL_BITS = (12, 24, 24)
HASH_BITS = sum(LEVEL_BITS)
MOST_COPIES = 2
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5


def word_count(text: Column) -> Column:
    """Number of words, that is of runs of other characters than ASCII blanks."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, BLANKS))).otherwise(0).cast("long")


def document_hash() -> Column:
    """A hash of HASH_BITS bits that stands for a document in all thresholds."""
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.col("text")), 64 - HASH_BITS)


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Add `target` to one row per source with its `place` (from 0) and `source_size`.

    The budget, `share` of all words, is dealt out by weight; targets that exceed
    `most` times their source stop there, and what they leave is dealt out among
    the others, until none exceeds.
    """
    table = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(table, (F.col("place") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight)
    cap = F.col("source_size") * F.lit(float(most))
    # A source is full when its words per weight do not exceed `level`. Each round
    # sees one row, and every round but the last fills a source.
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        taken, rest = rows.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        if not rest or (total * share - taken) / rest <= level:
            break
        level = (total * share - taken) / rest
    return rows.withColumn("target", F.least(cap, F.col("weight") * F.lit(level))).drop("weight")


def _thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the `threshold` below which hashes add up to about `budget` words."""
    state = budgets.select("source", F.col("budget").alias("rest"), F.lit(0).cast("long").alias("low"))
    found, shift = [], HASH_BITS
    while True:
        # The bucket that is refined holds the hashes with low >> shift in their first bits.
        last, shift = shift, shift - LEVEL_BITS[len(found)]
        inside = F.shiftright("hash", last) == F.shiftright("low", last)
        buckets = (
            docs.join(state, docs["source"].eqNullSafe(state["source"]))
            .where(inside)
            .groupBy(state["source"], "rest", F.shiftright("hash", shift).alias("bucket"))
            .agg(F.sum("size").alias("words"), F.min("hash").alias("first"), F.max("hash").alias("last"))
        )
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        ends = (
            buckets.withColumn("upto", F.sum("words").over(upto))
            .where(F.col("upto") > F.col("rest"))
            .groupBy("source")
            .agg(F.min_by(F.struct("rest", "bucket", "words", "first", "last", "upto"), "bucket").alias("b"))
            .select("source", "b.*")
        )
        ends = materialise(
            ends.select(
                "source",
                (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"),
                F.shiftleft("bucket", shift).alias("low"),
                F.shiftleft(F.col("bucket") + 1, shift).alias("high"),
                "words",
                (F.col("first") == F.col("last")).alias("single"),
            )
        )
        # One hash value is left: it goes to the side that comes nearer to the budget.
        single = F.col("single") if shift else F.lit(True)
        nearer = F.when(F.col("rest") * 2 >= F.col("words"), F.col("high")).otherwise(F.col("low"))
        found.append(ends.where(single).select("source", nearer.alias("threshold")))
        state = ends.where(~single).select("source", "rest", "low")
        if state.isEmpty():
            break
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def _sized(docs: DataFrame) -> DataFrame:
    """What the mix needs of the documents, written."""
    return materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            document_hash().alias("hash"),
        )
    )


def _plan(sized: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """Per source: size, target, whole copies of each document, and threshold of one more."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn(
        "last", F.col("source").isNull().cast("int")
    )
    ranked = with_global_ranks(sums, numbers={"place": [("last", "asc"), ("source", "asc")]})
    placed = materialise(ranked.withColumn("place", F.col("place") - 1).drop("last"))
    aimed = targets(placed, weights, share, most)
    # Quotients in double can fall short of a whole number by a few parts in 10^16.
    times = F.col("target") / F.nullif("source_size", F.lit(0))
    whole = F.coalesce(F.floor(times + F.lit(1e-12)), F.lit(0)).cast("int")
    plan = aimed.withColumn("whole", whole)
    budget = F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))
    cuts = _thresholds(sized, plan.where("whole < " + str(int(most))).withColumn("budget", budget))
    return plan.join(cuts, plan["source"].eqNullSafe(cuts["source"]), "left").select(
        plan["source"].alias("_source"), "source_size", "target", "whole",
        F.coalesce("threshold", F.lit(0)).alias("threshold"),
    )


def _copies(hash_: Column) -> Column:
    return F.col("whole") + (hash_ < F.col("threshold")).cast("int")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies and taken words.

    Weights go to the sources in code point order (null last) and repeat.
    """
    sized = _sized(docs)
    plan = _plan(sized, weights, share, most)
    return (
        sized.join(plan, sized["source"].eqNullSafe(plan["_source"]))
        .withColumn("copies", _copies(F.col("hash")))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", "taken", "hash")
    )


def taken(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
) -> DataFrame:
    """The documents themselves, each as often as the mix takes it.

    A document's hash and its source's line of the plan decide, so texts are not moved.
    """
    plan = _plan(_sized(docs), weights, share, most)
    plan = plan.select("_source", F.col("whole").alias("_whole"), F.col("threshold").alias("_threshold"))
    below = (document_hash() < F.col("_threshold")).cast("int")
    return (
        docs.join(plan, F.col("source").cast("string").eqNullSafe(F.col("_source")))
        .withColumn("_copies", F.col("_whole") + below)
        .where("_copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies")))
        .select([docs[c] for c in docs.columns])
    )
