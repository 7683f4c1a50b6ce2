"""Metrics from partial states that merge (SNK-06, CACHE-02, CACHE-03): a new batch does not read the old rows.

A state is a player's sums, and numbers of values, of the columns in one season and one batch. A batch's states are
written in a folder of its own, so that writing it again puts the same in its place; a metric is evaluated over the
states of all batches of a season.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import rnd
from .metrics import MetricSpec, keyed


def partial_states(rows: DataFrame, specs: list[MetricSpec], key: str = "player_id", season_col: str = "season") -> DataFrame:
    """(season, key, c, c__n for each column c of the specs): sums and numbers of values; rows without a key go."""
    columns = tuple(dict.fromkeys(c for s in specs for c in s.columns))
    numbers = keyed(rows, key, (*columns, season_col))
    states = [x for c in columns for x in (F.sum(c).alias(c), F.count(c).alias(f"{c}__n"))]
    return numbers.groupBy(F.col(season_col).cast("int").alias("season"), key).agg(*states)


class PartialStates:
    """The states under `home`, by season and batch."""

    def __init__(self, home: str, specs: list[MetricSpec], key: str = "player_id"):
        if lost := [s.name for s in specs if s.merged is None]:
            raise ValueError(f"metrics that do not say how they are merged: {', '.join(lost)}")
        if not specs:
            raise ValueError("no metrics given")
        self.home, self.specs, self.key = home.rstrip("/"), specs, key

    def put(self, batch: str, rows: DataFrame) -> None:
        """A batch's rows, all of them: reads nothing else. The same batch again takes its own place."""
        if not batch or "/" in batch or "=" in batch:
            raise ValueError(f"not a batch's name: {batch!r}")
        partial_states(rows, self.specs, self.key).write.mode("overwrite").parquet(f"{self.home}/batch={batch}")

    def states(self, spark: SparkSession, season: int) -> DataFrame:
        return spark.read.parquet(self.home).filter(F.col("season") == season)

    def evaluate_many(self, spark: SparkSession, season: int, names: list[str] | None = None) -> DataFrame:
        """As metrics.evaluate_many() over all rows of the season: one aggregation of the states."""
        by_name = {s.name: s for s in self.specs}
        specs = [by_name[n] for n in names] if names else self.specs
        return self.states(spark, season).groupBy(self.key).agg(*(rnd(s.merged(), s.precision).alias(s.name) for s in specs))
