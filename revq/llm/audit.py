"""How document filters interact: an audit by incremental retraction streaming.

Each document fails some of five filters; which ones is its mask. All questions about
the order of filters are answered from counters of documents by part and mask. They are
kept by a stream over the files of a table, read as available-now micro-batches:

* filters that look at one document alone are evaluated where it is read;
* whether a smaller doc_id has the same text depends on files that may come later. So
  the state holds for each text (by its SHA-256) the least doc_id and what was counted
  for that. A larger id is counted as a copy at once. When a smaller id arrives, the
  count made before is retracted, made again as a copy's, and the new least is held;
* each micro-batch appends its changes to the counters. Sums of them are right after
  every batch, whatever the order of the files, and a restart repeats no batch.

A state key is a range of hashes with about a thousand texts, which are revised together
as columns; the number of ranges is fixed when a stream starts. Documents of one text
meet in a task only after each has combined its own: of every ten thousand rows, only
the one with the least id; the others are copies for sure and are summed up at once. So
a text that a third of all rows share is no hot key. The state grows with the distinct
texts, by about 80 bytes each, and is saved in the checkpoint folder. The session's state
store keeps it: by default in the executors' memory; where that is too small, set
`spark.sql.streaming.stateStore.providerClass` to the RocksDB provider.

A null text is an empty one. A null doc_id is no smaller than any other and none is
smaller than it: such rows are no copies and make none. Rows with the same doc_id and
text are no copies of each other. A null part is the empty string. A document's labels
are the highest given to its id. An empty table gives an empty result. Other columns
than doc_id, text and the part's are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations
from math import factorial
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revq.llm.tokens import word_list
from revq.session import materialise, new_path

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
BATCHES = 4

TEXTS_PER_RANGE = 1024
# Rows without a text's key are counted as they are; of the others, only the least id is no copy.
ROWS = "bucket long, key binary, doc_id long, part string, mask int, good int, toxic int, docs long"
CHANGES = "part string, mask int, good int, toxic int, docs long"
STATE = "held binary"
COUNTED = ["part", "mask", "good", "toxic"]
HELD = ["key", "doc_id", *COUNTED, "docs"]


def own_mask(text: Column, words: Column) -> Column:
    """Bits of the filters A to D that a text with these words fails."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = {
        "A": n < 100,
        "B": 100 * distinct.cast("long") < 80 * n.cast("long"),
        "C": 100 * upper.cast("long") > 10 * F.length(text).cast("long"),
        "D": F.length(F.translate(text, "#$%&*|", "")) < F.length(text),
    }
    mask = F.lit(0)
    for name, failed in fails.items():
        mask = mask + F.when(failed, 1 << FILTERS.index(name)).otherwise(0)
    return mask


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text in a batch the rows with the least id stay; all others become sums."""
    schema = pa.schema(
        [("bucket", pa.int64()), ("key", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string())]
        + [(name, pa.int32()) for name in COUNTED[1:]] + [("docs", pa.int64())]
    )
    for batch in batches:
        if not batch.num_rows:
            continue
        names = ["bucket", "key", "doc_id", *COUNTED]
        rows = list(zip(*(batch[name].to_pylist() for name in names)))
        least: dict[bytes, int] = {}
        for _, key, doc_id, *_ in rows:
            if doc_id is not None and doc_id <= least.get(key, doc_id):
                least[key] = doc_id
        counts: Counter = Counter()
        for bucket, key, doc_id, part, mask, good, toxic in rows:
            if doc_id is not None and doc_id == least[key]:
                counts[bucket, key, doc_id, part, mask, good, toxic] += 1
            else:
                mask |= 0 if doc_id is None else COPY
                counts[rows[0][0], None, 0, part, mask, good, toxic] += 1
        columns = zip(*((*row, n) for row, n in counts.items()))
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)


def _revised(held: pd.DataFrame, new: pd.DataFrame) -> tuple[pd.DataFrame, list[pd.DataFrame]]:
    """What is held after new rows of some texts, and the changes to the counters."""
    sure = new["key"].isna()
    changes = [new[sure]]
    both = pd.concat([held, new.loc[~sure, HELD]], ignore_index=True)
    before = both.index < len(held)
    first = (both["doc_id"] == both.groupby("key")["doc_id"].transform("min")).to_numpy()
    changes.append(both[first & ~before])
    copies = both[~first]
    changes.append(copies.assign(mask=copies["mask"] | COPY))
    gone = both[~first & before]
    changes.append(gone.assign(docs=-gone["docs"]))
    kept = both[first]
    return kept.groupby(HELD[:-1], as_index=False, sort=False)["docs"].sum(), changes


def _packed(held: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(held, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _revise(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    """Changes to the counters by new rows of a range of texts, and its new state."""
    held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else None
    changes = []
    for frame in frames:
        held, more = _revised(frame.loc[[], HELD] if held is None else held, frame)
        summed = pd.concat([m[[*COUNTED, "docs"]] for m in [*changes, *more]])
        changes = [summed.groupby(COUNTED, as_index=False)["docs"].sum()]
    state.update((_packed(held),))
    yield changes[0][changes[0]["docs"] != 0]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes added up within each batch."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(COUNTED).aggregate([("docs", "sum")])
        yield from table.rename_columns([*COUNTED, "docs"]).cast(batch.schema).to_batches()


class FilterAudit:
    """Counters of a folder of documents, kept by a stream in a folder of its own.

    `update` reads the files that have come since the last call. The number of state
    ranges must not change as long as the folder is used.
    """

    def __init__(
        self, spark: SparkSession, documents: str, labels: DataFrame, part: str, folder: str, ranges: int = 1024
    ):
        self.spark, self.documents, self.labels = spark, documents, labels
        self.part, self.folder, self.ranges = part, folder, ranges

    def _changes(self, files_per_batch: int) -> DataFrame:
        schema = self.spark.read.parquet(self.documents).schema
        # As a pattern, the path may be a single file as well as a folder.
        path = self.documents.rstrip("/")
        path = f"{path[:-1]}[{path[-1]}]"
        docs = (
            self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .parquet(path)
            .select(
                F.col("doc_id").cast("long").alias("doc_id"),
                F.coalesce(F.col(self.part).cast("string"), F.lit("")).alias("part"),
                F.coalesce("text", F.lit("")).alias("text"),
            )
            .withColumn("words", word_list(F.col("text")))
            .select(
                F.pmod(F.xxhash64("text"), F.lit(self.ranges)).alias("bucket"),
                F.unhex(F.sha2("text", 256)).alias("key"),
                "doc_id", "part",
                own_mask(F.col("text"), F.col("words")).alias("mask"),
            )
        )
        marks = (
            self.labels.where("doc_id IS NOT NULL")
            .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(*[F.max((F.col(c) == 1).cast("int")).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
        )
        flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
        rows = docs.join(materialise(marks), "doc_id", "left").select(
            "bucket", "key", "doc_id", "part", "mask", *flags
        )
        return (
            rows.mapInArrow(_combine, ROWS)
            .groupBy("bucket")
            .applyInPandasWithState(_revise, CHANGES, STATE, "append", "NoTimeout")
            .mapInArrow(_summed, CHANGES)
        )

    def update(self, files_per_batch: int) -> None:
        """Process all files that are there, so many per micro-batch, and return when done."""
        query = (
            self._changes(files_per_batch)
            .writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{self.folder}/changes")
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def counters(self) -> DataFrame:
        """Documents by part, mask, good and toxic."""
        changes = self.spark.read.schema(CHANGES).parquet(f"{self.folder}/changes")
        return (
            changes.groupBy("part", "mask", "good", "toxic").agg(F.sum("docs").alias("docs")).where("docs <> 0")
        )


def audited(
    spark: SparkSession, documents: str, labels: DataFrame, part: str = "lang", batches: int = BATCHES
) -> DataFrame:
    """Counters of all documents of a Parquet folder or file, read in about `batches` micro-batches."""
    docs = spark.read.parquet(documents)
    files, ranges = len(docs.inputFiles()), docs.count() // TEXTS_PER_RANGE + 1
    audit = FilterAudit(spark, documents, labels, part, new_path(spark), ranges)
    audit.update(max(1, -(-files // batches)))
    return audit.counters()


def _steps() -> str:
    """An SQL array with the order, step, filter's bit and earlier filters' bits of all orders and steps."""
    rows = []
    for order in permutations(FILTERS):
        earlier = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            rows.append(f"struct('{''.join(order)}', {step}, {bit}, {earlier})")
            earlier |= bit
    return f"array({', '.join(rows)})"


def interactions(counters: DataFrame) -> DataFrame:
    """What each filter does at each step of each order, per part: 600 rows a part.

    A part's counters become arrays by mask. A document that fails k filters is removed
    by each of them in one k-th of all orders, which gives the Shapley sums.
    """
    masks = range(1 << len(FILTERS))

    def by_mask(chosen: str) -> Column:
        return F.array(*[F.sum(F.expr(f"if(mask = {m} AND {chosen}, docs, 0L)")) for m in masks])

    def total(counts: str, chosen: str, times: str = "1") -> Column:
        return F.expr(
            f"aggregate(sequence(0, {masks[-1]}), 0L, "
            f"(s, m) -> s + if({chosen}, element_at({counts}, m + 1) * {times}, 0L))"
        )

    parts = counters.groupBy("part").agg(
        by_mask("true").alias("all"), by_mask("good = 1").alias("good"), by_mask("toxic = 1").alias("toxic")
    )
    rows = parts.selectExpr("*", f"inline({_steps()}) AS (filter_order, step, bit, earlier)")
    removed = "m & bit <> 0 AND m & earlier = 0"
    return rows.select(
        "part", "filter_order", "step",
        total("all", "m & (bit | earlier) = 0").alias("kept"),
        total("all", removed).alias("removed"),
        total("all", "m & bit <> 0 AND m & earlier <> 0").alias("redundant"),
        total("all", "m = bit").alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("all", "m & bit <> 0", f"({factorial(len(FILTERS))} div bit_count(m))").alias("shapley"),
    )
