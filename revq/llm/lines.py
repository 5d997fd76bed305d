"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches. `LineRuns` keeps what earlier batches held as runs: tables
of line hashes, bucketed and sorted by hash, with the number of documents per hash
and the keeper, the largest doc_id that holds the line. A new batch is merge-anti-
joined with the runs, which shares their buckets and so moves only the batch: hashes
that no run holds are new and get their keeper from the batch. The batch then becomes
a run of the lowest level. When a level holds `fanout` runs they are compacted into
one run of the next, so a line is rewritten once per level, and there are
logarithmically many runs to join.

`drop_repeated_lines` feeds a whole table in batches of descending doc_id. So the
batch that sees a line first holds its largest doc_id. Then it drops every line that
`min_docs` documents or more hold, except from the keeper.

All of it is DataFrame functions. Counts are made per batch by document and hash before
anything meets by hash, so a line that a third of all documents hold is spread over
tasks. Hashes have 128 bits.

A null or empty text is one empty line. Rows with a null doc_id keep all lines and
count for none. Rows with the same doc_id are one document. An empty table gives an
empty result. Other columns of the input are carried along by `drop_repeated_lines`.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revq.session import materialise, new_path

BLANK_SET = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HASH = ["h1", "h2"]
RUN = "h1 long, h2 long, docs long, keeper long"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK_SET)), UPPER, UPPER.lower())


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def _long_keys(text: Column, min_chars: int) -> Column:
    keys = F.transform(split_lines(text), line_key)
    return F.filter(keys, lambda k: F.length(k) >= min_chars)


class LineRuns:
    """Levelled sorted runs of line hashes in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 2):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.folder = new_path(spark)
        self.levels: list[list[str]] = []
        self.retired: list[str] = []

    def _write(self, run: DataFrame) -> str:
        """Store rows that a join or an aggregate has placed by hash, one sorted file per bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        (
            run.write.option("path", f"{self.folder}/{name}")
            .bucketBy(self.buckets, *HASH)
            .sortBy(*HASH)
            .saveAsTable(name)
        )
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of (h1, h2, doc_id), one row per line and document; return its run.

        The run's `keeper` is null for hashes an earlier batch has brought. It can be
        read until the next batch is added, also if it is compacted now.
        """
        self._forget_retired()
        own = lines.groupBy(*HASH).agg(
            F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("keeper")
        )
        marked = own
        if self.levels:
            # The batch's exchange by hash serves both sides, and the runs lie in the same buckets.
            fresh = own.select(*HASH, "keeper")
            for run in self.runs():
                fresh = fresh.join(run.select(*HASH).hint("merge"), HASH, "left_anti")
            marked = own.select(*HASH, "docs").join(fresh, HASH, "left")
        name = self._write(marked)
        self._place(name)
        return self.spark.read.schema(RUN).parquet(f"{self.folder}/{name}")

    def _place(self, name: str) -> None:
        """Put a run into the lowest level; levels that are full by that are merged, all at once."""
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        full = 0
        while full < len(self.levels) and len(self.levels[full]) + (full > 0) >= self.fanout:
            full += 1
        if full:
            old = sum(self.levels[:full], [])
            merged = self._write(self._merged(old))
            self.levels[:full] = [[] for _ in range(full)]
            if len(self.levels) == full:
                self.levels.append([])
            self.levels[full].append(merged)
            self.retired += old

    def _forget_retired(self) -> None:
        """Remove the runs that were compacted, and their files."""
        for name in self.retired:
            self.spark.sql(f"DROP TABLE {name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.retired = []

    def _merged(self, names: list[str]) -> DataFrame:
        # The files are read as plain files: Spark takes a union of bucketed tables for placed
        # by bucket, though it may read them without their buckets, and would split groups.
        runs = [self.spark.read.schema(RUN).parquet(f"{self.folder}/{name}") for name in names]
        rows = reduce(DataFrame.unionByName, runs, self.spark.createDataFrame([], RUN))
        return rows.groupBy(*HASH).agg(
            F.sum("docs").alias("docs"), F.max("keeper").alias("keeper")
        )

    def totals(self) -> DataFrame:
        """Documents and keeper per hash over all runs."""
        return self._merged(sum(self.levels, []))

    def close(self) -> None:
        self.retired += sum(self.levels, [])
        self.levels = []
        self._forget_retired()


def _batch(docs: DataFrame, batches: int) -> Column:
    """The batch of a doc_id, from 0; batch 0 has the largest ids. Bounds are quantiles."""
    shares = [i / batches for i in range(1, batches)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] if shares else None
    batch = F.lit(0)
    for bound in sorted(set(bounds or [])):
        batch = batch + (F.col("doc_id") <= F.lit(bound)).cast("int")
    return batch


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2
) -> DataFrame:
    """The documents with `text` cut, and n_lines (before) and n_dropped beside it."""
    spark = docs.sparkSession
    batch = _batch(docs, batches)
    found = (
        docs.where("doc_id IS NOT NULL")
        .select(
            "doc_id",
            F.explode(F.array_distinct(F.transform(_long_keys(F.col("text"), min_chars), key_hash))).alias("h"),
            batch.alias("batch"),
        )
        .select("doc_id", "h.*", "batch")
    )
    # One folder per batch, so that each batch reads its own rows only.
    path = new_path(spark)
    found.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(found.schema).parquet(path)
    runs = LineRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    try:
        for b in range(batches):
            runs.add(lines.where(F.col("batch") == b).select("doc_id", *HASH))
        repeated = materialise(runs.totals().where(F.col("docs") >= min_docs).select(*HASH, "keeper"))
    finally:
        runs.close()
    dropped = (
        lines.join(repeated, HASH)
        .where(F.col("doc_id") != F.col("keeper"))
        .groupBy(F.col("doc_id").alias("_lines_id"))
        .agg(F.collect_set(F.struct(*HASH)).alias("_lines_dropped"))
    )
    lines_of = split_lines(F.col("text"))

    def stays(line: Column) -> Column:
        key = line_key(line)
        return (F.length(key) < min_chars) | ~F.array_contains(F.col("_lines_dropped"), key_hash(key))

    whole = F.col("_lines_dropped").isNull()
    kept = F.when(whole, lines_of).otherwise(F.filter(lines_of, stays))
    joined = docs.join(dropped.hint("shuffle_hash"), F.col("doc_id") == F.col("_lines_id"), "left")
    return (
        joined.withColumns({"_lines_kept": kept, "n_lines": F.size(lines_of).cast("long")})
        .withColumn("n_dropped", F.col("n_lines") - F.size("_lines_kept"))
        .withColumn("text", F.array_join("_lines_kept", "\n"))
        .drop("_lines_id", "_lines_dropped", "_lines_kept")
    )
