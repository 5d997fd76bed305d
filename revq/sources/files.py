"""Order files in, tables and result files out."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revq.functions.labels import one_spelling
from revq.schema import STG_ORDERS, require_columns

OPEN_NAMES = ("order_id", "state", "zone", "category", "customer_gender")


def _headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """The CSV files under `paths`, by their first line that is not blank; no more of each file is read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: dict[str, list[str]] = {}

    def visit(files, status) -> None:
        if status.getPath().getName().startswith(("_", ".")):
            return
        if status.isDirectory():
            for inner in files.listStatus(status.getPath()):
                visit(files, inner)
            return
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(files.open(status.getPath()), "UTF-8"))
        header = lines.readLine()
        # Spark skips empty lines and lines of spaces, and so does this.
        while header is not None and not header.strip(" "):
            header = lines.readLine()
        lines.close()
        if header is not None:
            found.setdefault(header.removeprefix("\ufeff"), []).append(status.getPath().toString())

    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(conf)
        for status in files.globStatus(place) or []:
            visit(files, status)
    return found


def read_orders_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Typed staging rows from CSV files with a header, each in a column order of its own.

    Files are read together where their headers agree. Columns are matched by name
    and nothing is inferred. A value that is none of its type fails the read instead of
    turning into NULL; decimals with more places than their type are rounded half up.
    """
    headers = _headers(spark, [path] if isinstance(path, str) else list(path))
    if not headers:
        raise FileNotFoundError(f"no CSV file with a header in {path}")
    parts = []
    for files in headers.values():
        # Only the header is read here: without inference every column is a string.
        raw = spark.read.option("header", True).csv(files)
        require_columns(raw)
        parts.append(raw.select([F.trim(F.col(f.name)).cast(f.dataType).alias(f.name) for f in STG_ORDERS]))
    return clean_names(reduce(DataFrame.unionByName, parts))


def import_orders_csv(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(orders, rejects) of CSV files with a header; a bad row costs nothing but itself.

    Every row of the files is in exactly one of the two. Rejects are `file`, `line` and
    `reasons`: the columns whose value is none of their type, in the order of the schema,
    or "wrong number of values" alone. The line is as it stands in the file where the
    number is wrong, else written anew from its values. Both results read the files; a
    file that lacks a column still fails the import as a whole.
    """
    headers = _headers(spark, [path] if isinstance(path, str) else list(path))
    if not headers:
        raise FileNotFoundError(f"no CSV file with a header in {path}")
    kept, left = [], []
    for files in headers.values():
        names = require_columns(spark.read.option("header", True).csv(files)).columns
        line = "_line"
        while line in names:
            line += "_"
        text = T.StructType([T.StructField(name, T.StringType()) for name in [*names, line]])
        raw = spark.read.schema(text).option("header", True).option("columnNameOfCorruptRecord", line).csv(files)
        typed, bad = [], []
        for field in STG_ORDERS:
            value = F.trim(F.col(f"`{field.name}`"))
            cast = value.try_cast(field.dataType)
            typed.append(cast.alias(field.name))
            if field.dataType != T.StringType():
                bad.append(F.when(value.isNotNull() & cast.isNull(), F.lit(field.name)))
        whole = F.col(line).isNull()
        reasons = F.when(whole, F.array_compact(F.array(*bad))).otherwise(F.array(F.lit("wrong number of values")))
        judged = raw.withColumn("_reasons", reasons)
        kept.append(judged.where(F.size("_reasons") == 0).select(typed))
        written = F.to_csv(F.struct([F.col(f"`{name}`") for name in names]))
        left.append(
            judged.where(F.size("_reasons") > 0).select(
                F.col("_metadata.file_path").alias("file"), F.coalesce(line, written).alias("line"),
                F.col("_reasons").alias("reasons"),
            )
        )
    return clean_names(reduce(DataFrame.unionByName, kept)), reduce(DataFrame.unionByName, left)


def clean_names(orders: DataFrame) -> DataFrame:
    """Trim names; write closed vocabularies one way ('FESTIVAL' -> 'Festival')."""
    return one_spelling(orders.withColumns({name: F.trim(F.col(name)) for name in OPEN_NAMES}))


def write_orders(orders: DataFrame, path: str) -> None:
    """Replace the order table at `path`: one folder per month, clean names, sorted by state and category.

    Rebalancing puts the rows of small months together and splits a month with
    a large share of the rows, so files come out evenly sized. A filter on the state
    skips the row groups of other states within each file.
    """
    (
        clean_names(orders)
        .withColumn("month_start", F.trunc("order_date", "MM"))
        .hint("rebalance", "month_start")
        .sortWithinPartitions("month_start", "state", "category")
        .write.mode("overwrite")
        .partitionBy("month_start")
        .parquet(path)
    )


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """The order table written by `write_orders`; months prune to folders.

    Its names are clean: `model.enrich` need not spell them again (`spelled=True`).
    """
    by_month = T.StructType([*STG_ORDERS, T.StructField("month_start", T.DateType())])
    return spark.read.schema(by_month).parquet(path)


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a parquet table beside `path`, then put it there; on a failure the old table stays."""
    staged = _staged(path)
    df.write.partitionBy(*partition_by).parquet(staged)
    _swap(df.sparkSession, {path: staged})


def _staged(path: str) -> str:
    head, _, name = path.rstrip("/").rpartition("/")
    return f"{head}/_{name}-{uuid.uuid4().hex}"


def _swap(spark: SparkSession, moves: dict[str, str]) -> None:
    """Move each staged folder, if there is one, to its place; old folders go last."""
    make, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    old = []
    for target, staged in moves.items():
        place, source = make(target), make(staged)
        files = place.getFileSystem(conf)
        if files.exists(place):
            aside = make(_staged(target))
            files.rename(place, aside)
            old.append(aside)
        if files.exists(source):
            files.mkdirs(place.getParent())
            if not files.rename(source, place):
                raise OSError(f"{staged} cannot be moved to {target}")
    for aside in old:
        aside.getFileSystem(conf).delete(aside, True)


def write_csv(df: DataFrame, path: str) -> None:
    """Replace a CSV result; the order of a sorted result is kept across its files."""
    df.write.mode("overwrite").option("header", True).csv(path)
