"""Pages of a table in an order (SYS-01, SRT-07) without sorting it for each: ranges and a sparse index.

The table is written once, range-partitioned by the order, and a row for each range says how many rows lie before
it and where it ends. A page by number or after a key reads the ranges that it lies in, and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a range, about, and of a page, at most.
ROWS, MOST = 100_000, 500


@dataclass(frozen=True)
class By:
    """A column of the order. Ascending: NULL last; descending: NULL first."""

    column: str
    descending: bool = False

    def order(self) -> Column:
        return F.col(self.column).desc_nulls_first() if self.descending else F.col(self.column).asc_nulls_last()

    def beyond(self, x: Column, key: Column) -> Column:
        """x comes after key; never NULL."""
        later = F.coalesce(x < key if self.descending else x > key, F.lit(False))
        nulls = (key.isNull() & x.isNotNull()) if self.descending else (x.isNull() & key.isNotNull())
        return later | nulls


def _beyond(order: tuple[By, ...], x, key) -> Column:
    """The row of x(column) comes after that of key(column), column by column."""
    out = F.lit(False)
    for by in reversed(order):
        a, b = x(by.column), key(by.column)
        out = by.beyond(a, b) | (a.eqNullSafe(b) & out)
    return out


@dataclass(frozen=True)
class PagedTable:
    home: str
    order: tuple[By, ...]
    schema: StructType

    def _table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.home}/rows")

    def _index(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.home}/index")

    def _ranges(self, spark: SparkSession, numbers: list[int]) -> DataFrame:
        """The rows of these ranges: their folders are read, the others aren't."""
        return self._table(spark).filter(F.col("__range").isin(numbers))

    def _ordered(self, rows: DataFrame) -> DataFrame:
        return rows.orderBy(*(by.order() for by in self.order))

    def page(self, spark: SparkSession, page: int = 1, size: int = 50) -> DataFrame:
        """Page `page` (from 1) of `size` rows: the same as sorting all and skipping. Beyond the end: no rows."""
        size, page = max(1, min(size, MOST)), max(1, page)
        first = (page - 1) * size
        touched = self._index(spark).filter((F.col("__ahead") < first + size) & (F.col("__ahead") + F.col("__rows") > first))
        found = touched.select("__range", "__ahead").orderBy("__range").collect()  # ranges that hold `size` rows
        rows = self._ranges(spark, [r["__range"] for r in found])
        skip = first - found[0]["__ahead"] if found else 0
        return self._ordered(rows).offset(skip).limit(size).drop("__range", "__at")

    def after(self, spark: SparkSession, key: dict, size: int = 50) -> DataFrame:
        """The `size` rows that follow the row with this key, its values by the order's columns."""
        size = max(1, min(size, MOST))
        types = dict(self._table(spark).dtypes)
        wanted = lambda c: F.lit(key[c]).cast(types[c])
        ends = self._index(spark).filter(_beyond(self.order, lambda c: F.col(f"__last.{c}"), wanted))
        # The first range may hold but one row that follows; after it, ranges until they have `size` rows.
        least = ends.agg(F.min("__range")).first()[0]
        before = F.sum(F.when(F.col("__range") > least, F.col("__rows")).otherwise(0)).over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
        found = ends.withColumn("__before", F.coalesce(before, F.lit(0))).filter(F.col("__before") < size).select("__range").collect() if least is not None else []
        rows = self._ranges(spark, [r["__range"] for r in found])
        return self._ordered(rows.filter(_beyond(self.order, F.col, wanted))).limit(size).drop("__range", "__at")

    def count(self, spark: SparkSession) -> int:
        """Rows of the table, from the index."""
        return self._index(spark).agg(F.coalesce(F.sum("__rows"), F.lit(0))).first()[0]


def write_paged(df: DataFrame, home: str, key: list[str], sort: str | None = None, descending: bool = False, rows: int = ROWS) -> PagedTable:
    """df under `home`, in the order of browse(): by `sort`, if there is such a column, then by `key`, which makes
    rows differ. One shuffle by range, and one pass over what is written for the index (a row for each range)."""
    order = tuple(By(k) for k in key)
    if sort in df.columns:
        order = (By(sort, descending), *order)
    n = max(1, -(-df.count() // rows))
    by = [b.order() for b in order]
    placed = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    placed = placed.withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    placed.write.mode("overwrite").partitionBy("__range").parquet(f"{home}/rows")
    table = PagedTable(home, order, placed.schema)
    last = F.max_by(F.struct(*(b.column for b in order)), "__at").alias("__last")
    index = table._table(df.sparkSession).groupBy("__range").agg(F.count("*").alias("__rows"), last)
    ahead = F.sum("__rows").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    index.withColumn("__ahead", F.coalesce(ahead, F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{home}/index")
    return table
