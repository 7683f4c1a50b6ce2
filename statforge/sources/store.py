"""Tables that the library writes for itself: where they go, and what goes when the session does."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_home(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which goes when the driver ends. Where that is unset, one of our own, in
    local mode only: executors of a cluster don't share theirs."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="statforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    home = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return home


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, sort: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """JOIN-01, AGG-03, WIN-03 without a shuffle: a table of the warehouse in `buckets` files by key, sorted by it (and
    `sort`). Tables of one number of buckets join on their keys as they lie; windows and sums by the key and more
    columns need no shuffle either. Rows are dealt once, so that each bucket is one file. `path`: where the table lies, if
    not in the warehouse."""
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, *sort).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)
