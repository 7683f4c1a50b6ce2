"""Tables written on the way, in the shared folder that the cluster names.

They lie in a folder of the application, which goes when the driver's JVM ends: a lazy result may be read
at any time until then. Stages of a pipeline delete theirs earlier (see staged)."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1500

#: Of each thread, so that pipelines in several threads leave each other's tables alone.
_of_thread = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a folder of our own, in local mode only: executors
    of a cluster don't share theirs."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="statforge-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh() -> str:
    return uuid.uuid4().hex


def _path(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    home = f"{shared_dir(spark)}/statforge-{spark.sparkContext.applicationId}"
    at, fs = _path(spark, home)
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{home}/{name}-{fresh()}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: its lineage ends there, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    if hasattr(_of_thread, "written"):
        _of_thread.written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path that the stages leave alone."""
    return new_path(spark, f"stage-{name}")


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it doesn't exist."""
    at, fs = _path(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def staged(stage):
    """For stages whose results the caller writes before it calls the next: what one stage has written
    on the way is deleted when the next begins in the same thread, and nothing else is. Whole texts go to
    Python in batches of BATCH_ROWS at most from then on in this session, for an executor keeps the buffers
    of the largest batch it has sent (the setting is read when a result is run, so it can't be put back here)."""

    @functools.wraps(stage)
    def run(spark, docs, sf_dir):
        if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
            spark.conf.set(_BATCH, BATCH_ROWS)
        for path in getattr(_of_thread, "written", []):
            delete(spark, path)
        _of_thread.written = []
        return stage(spark, docs, sf_dir)

    return run
