"""Substring search (SRC-08, FLT-09) by an index of trigrams instead of a scan.

A pattern's literal runs of three characters and more must be in a text that it matches. The index has a row for each
distinct trigram of each text, in shards that are read for the trigrams asked for; texts that have them all are looked
up in their ranges of the table, and verified. Patterns without such a run scan, as before.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SHARDS = 64
#: Ranges of the table that a search names in its filter; with more, it scans.
MOST_RANGES = 1000
_GRAMS = "__range int, __at long, field int, gram string, shard int"


def literal_runs(pattern: str) -> list[str]:
    """The runs of a LIKE pattern between wildcards, in lower case: % and _ end a run, a backslash takes the next
    character as it is."""
    runs, run = [], []
    for m in re.finditer(r"\\(.)|(.)", pattern.lower(), re.S):
        if m[2] in ("%", "_"):
            runs.append("".join(run))
            run = []
        else:
            run.append(m[1] or m[2])
    return [r for r in [*runs, "".join(run)] if r]


def _shard(gram: str, shards: int) -> int:
    return zlib.crc32(gram.encode()) % shards


def _grams(text: Column) -> Column:
    """Distinct trigrams of a text in lower case; none of shorter ones."""
    low = F.lower(text)
    at = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2))
    return F.array_distinct(F.transform(at, lambda i: F.substring(low, i, 3)))


@dataclass(frozen=True)
class TrigramIndex:
    home: str
    columns: tuple[str, ...]
    shards: int
    schema: StructType

    def _rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.home}/rows")

    def _candidates(self, spark: SparkSession, grams: list[str]) -> DataFrame:
        """(__range, __at) of rows with a column that has all of these trigrams."""
        shards = sorted({_shard(g, self.shards) for g in grams})
        found = spark.read.schema(_GRAMS).parquet(f"{self.home}/grams").filter(F.col("shard").isin(shards) & F.col("gram").isin(grams))
        return found.groupBy("__range", "__at", "field").count().filter(F.col("count") == len(grams)).select("__range", "__at").distinct()

    def search(self, spark: SparkSession, name: str, order: list[str], limit: int = 20) -> DataFrame:
        """The same rows as catalog.search() over the table: case does not matter, % and _ are wildcards, `limit` is
        held within 1..100. Runs one job to learn which ranges of the table have candidates."""
        name = name.strip()
        if len(name) < 2:
            raise ValueError("a search needs two characters")
        hit = F.lit(False)
        for c in self.columns:
            hit = hit | F.col(c).ilike(f"%{name}%")
        grams = sorted({r[i : i + 3] for r in literal_runs(name) for i in range(len(r) - 2)})
        rows = self._rows(spark)
        if grams:
            ranges = self._candidates(spark, grams).select("__range").distinct().limit(MOST_RANGES + 1).collect()
            if len(ranges) <= MOST_RANGES:
                rows = rows.filter(F.col("__range").isin([r["__range"] for r in ranges]))
        out = rows.filter(hit).orderBy(*(F.col(c).asc_nulls_last() for c in order))
        return out.limit(max(1, min(limit, 100))).drop("__range", "__at")


def write_trigrams(df: DataFrame, home: str, columns: list[str], cluster_by: str, rows: int = 100_000, shards: int = SHARDS) -> TrigramIndex:
    """df and its index under `home`: the table in ranges of `cluster_by` of about `rows` rows, and (gram, field,
    __range, __at) in `shards` folders. A shard is dealt by gram and place, so that a gram which many texts have is
    in several files."""
    spark = df.sparkSession
    n = max(1, -(-df.count() // rows))
    placed = df.repartitionByRange(n, F.col(cluster_by).asc_nulls_last()).withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    placed.write.mode("overwrite").partitionBy("__range").parquet(f"{home}/rows")
    fields = F.array(*(F.struct(F.lit(i).alias("field"), _grams(F.col(c)).alias("grams")) for i, c in enumerate(columns)))
    index = TrigramIndex(home, tuple(columns), shards, placed.schema)
    table = index._rows(spark).select("__range", "__at", F.explode(fields).alias("x"))
    grams = table.select("__range", "__at", F.col("x.field").alias("field"), F.explode("x.grams").alias("gram"))
    grams = grams.withColumn("shard", F.pmod(F.crc32(F.encode("gram", "UTF-8")), F.lit(shards)).cast("int"))
    sized = grams.repartitionByRange(max(shards, 2 * n), "shard", "gram", "__range", "__at").sortWithinPartitions("shard", "gram")
    sized.write.mode("overwrite").partitionBy("shard").parquet(f"{home}/grams")
    return index
