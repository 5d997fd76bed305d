"""Token totals by source, language and tokenizer version, maintained by deltas.

A batch says what documents hold now: one row per document and tokenizer version with
its source, language and token count, or with `deleted`. `TokenRollup.commit` looks up
what earlier batches said about these documents and nets the two: the new count with
sign +1, the count it replaces with sign -1. The sums of these signed rows by source,
language and tokenizer are the batch's delta; totals are the sum of all deltas. So a
commit reads and writes in proportion to its batch, and a revised count or a moved
source corrects the totals without counting anything anew.

A commit writes its delta and its ledger rows into a staging folder, which one rename
makes part of the rollup under the batch's id. A batch whose id is there already is
left alone, so a replay changes nothing; a commit that fails midway leaves no trace.

Null sources and languages are groups of their own. A null token count is 0. Rows with
a null doc_id are added, but cannot be revised or deleted. Of several rows in a batch
for one document and tokenizer a deletion counts, else the largest count. Deleting an
unknown document changes nothing. An empty batch is committed and changes nothing.
Further columns of a batch are not looked at.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revq.llm.blocks import Batches
from revq.llm.mixing import word_count
from revq.llm.tokens import slices

GROUP = ["source", "lang", "tokenizer"]
KEY = ["doc_id", "tokenizer"]
LEDGER = "doc_id long, tokenizer string, source string, lang string, tokens long, deleted boolean"
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


class TokenRollup:
    """Totals in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Ids of the committed batches, oldest first."""
        if not self._files.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self.folder))]
        found = [m for m in (re.fullmatch(r"(\d{9})-(.+)", n) for n in names) if m]
        return [m[2] for m in sorted(found, key=lambda m: m[1])]

    def _folders(self) -> list[str]:
        return [f"{self.folder}/{i:09d}-{b}" for i, b in enumerate(self.batches())]

    def _read(self, part: str, schema: str) -> DataFrame:
        parts = [
            self.spark.read.schema(schema).parquet(f"{f}/{part}").withColumn("seq", F.lit(i))
            for i, f in enumerate(self._folders())
        ]
        rows = parts[0] if parts else self.spark.createDataFrame([], schema).withColumn("seq", F.lit(0))
        for more in parts[1:]:
            rows = rows.unionByName(more)
        return rows

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Add a batch of LEDGER rows; False if the id was committed before."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        done = self.batches()
        if batch in done:
            return False
        staged = f"{self.folder}/_staged-{uuid.uuid4().hex}"
        state = F.struct(F.col("deleted"), F.col("tokens"), F.col("source"), F.col("lang"))
        given = rows.select(
            F.col("doc_id").cast("long").alias("doc_id"), "tokenizer", "source", "lang",
            F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")).alias("tokens"),
            F.coalesce("deleted", F.lit(False)).alias("deleted"),
        )
        known = given.where("doc_id IS NOT NULL").groupBy(*KEY).agg(F.max(state).alias("s")).select(*KEY, "s.*")
        names = [part.split()[0] for part in LEDGER.split(", ")]
        known.select(names).write.parquet(f"{staged}/ledger")
        known = self.spark.read.schema(LEDGER).parquet(f"{staged}/ledger")
        before = (
            self._read("ledger", LEDGER)
            .join(known.select(*KEY), KEY, "left_semi")
            .groupBy(*KEY)
            .agg(F.max_by(state, "seq").alias("s"))
            .select(*KEY, "s.*")
        )
        added = known.unionByName(given.where("doc_id IS NULL").select(known.columns))
        signed = added.where("NOT deleted").select(*GROUP, "tokens", F.lit(1).alias("sign")).unionByName(
            before.where("NOT deleted").select(*GROUP, "tokens", F.lit(-1).alias("sign"))
        )
        delta = signed.groupBy(*GROUP).agg(
            F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens")
        )
        delta.where("docs <> 0 OR tokens <> 0").write.parquet(f"{staged}/delta")
        target = self._path(f"{self.folder}/{len(done):09d}-{batch}")
        if not self._files.rename(self._path(staged), target):
            raise RuntimeError(f"batch {batch} was not committed: {target} cannot be made")
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer."""
        return (
            self._read("delta", DELTA).groupBy(*GROUP)
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            .where("docs <> 0 OR tokens <> 0")
        )


def counted(docs: DataFrame, tokenizers: dict[str, Column]) -> DataFrame:
    """LEDGER rows of documents: a count by each tokenizer, given as a column."""
    pairs = [F.struct(F.lit(k).alias("tokenizer"), c.cast("long").alias("tokens")) for k, c in tokenizers.items()]
    return docs.select("doc_id", "source", "lang", F.inline(F.array(*pairs))).withColumn("deleted", F.lit(False))


def words(text: Column) -> Column:
    return word_count(text)


def utf8_bytes(text: Column) -> Column:
    """Tokens of a byte-level tokenizer without merges."""
    return F.coalesce(F.octet_length(text), F.lit(0))


def counted_by_file(docs: DataFrame, version: str, path: str) -> DataFrame:
    """LEDGER rows counted by a tokenizer file (JSON) that every executor finds at `path`."""

    def count(batches: Batches) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part["text"].to_pylist()]
                tokens = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
                yield pa.RecordBatch.from_pydict(
                    {n: part[n] for n in ("doc_id", "source", "lang")} | {"tokens": pa.array(tokens, pa.int64())}
                )

    rows = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "source", "lang", "text").mapInArrow(
        count, "doc_id long, source string, lang string, tokens long"
    )
    return rows.withColumns({"tokenizer": F.lit(version), "deleted": F.lit(False)})
