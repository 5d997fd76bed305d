"""Session settings and the shared folder for results that are used more than once."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("revq")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # Without this every column expression looks up its line in the caller's code.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one beside the tables.

    Both are seen by the driver and all executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir") + "/_revq"
    return folder.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A new place in the shared folder, removed by `release` or when the application ends."""
    path = f"{shared_folder(spark)}/revq-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` as a table at a new place in the shared folder and read it back.

    Later reads survive a lost executor and know the table's size.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove what was written to new places; results that still read it end here."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for entry in [e for e in _written if e[0] is spark]:
        path = jvm.org.apache.hadoop.fs.Path(entry[1])
        path.getFileSystem(conf).delete(path, True)
        _written.remove(entry)


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        try:
            release(spark)
        except Exception:  # the session has ended, and its JVM with it
            _written[:] = [e for e in _written if e[0] is not spark]
