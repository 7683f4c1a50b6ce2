"""Rows that arrive in batches (SRC-21's effect on data): each batch once, and of each row the latest (WIN-03)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..operators.boxscore import latest_gamelog


def append_batch(rows: DataFrame, home: str, batch: int | str) -> None:
    """A batch in a folder of its own: written again, it takes its own place, whatever was left of it."""
    rows.write.mode("overwrite").parquet(f"{home.rstrip('/')}/batch={batch}")


def appended(spark: SparkSession, home: str) -> DataFrame:
    """All batches' rows, without the column that names them."""
    return spark.read.parquet(home).drop("batch")


def latest(spark: SparkSession, home: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Of each game and player the latest row of all batches."""
    return latest_gamelog(appended(spark, home), ties)


def ingest(stream: DataFrame, home: str, checkpoint: str, then: Callable[[DataFrame, str], None] | None = None) -> DataStreamWriter:
    """A writer that appends a stream's micro-batches under `home`. A micro-batch that is run again after a failure has
    its number, and so its folder. `then` gets each batch's rows, as written, and its name (PartialStates.put, for one)."""

    def put(rows: DataFrame, number: int) -> None:
        append_batch(rows, home, number)
        if then:
            then(rows.sparkSession.read.parquet(f"{home.rstrip('/')}/batch={number}"), str(number))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
