"""What each filter removes at each place of each order, and its Shapley share.

Every document fails some of the filters: a mask of bits. Only the numbers of documents by part, mask and label
are needed (mask cells). The walk visits every order of the filters by swaps of neighbours, and a swap changes
two steps only, those of the two filters: all other steps have the same filters before them. Shapley values are
summed along the walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

SPACES = "\t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Runs without white space (space and \\t to \\r), in order."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of the registered query that look at one text."""
    found = words(text)
    n_upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(found) < 200,
        "B": 100 * F.size(F.array_distinct(found)) < 50 * F.size(found),
        "C": 100 * n_upper > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def adjacent_orders(n: int) -> Iterator[tuple[tuple[int, ...], int | None]]:
    """Every order of range(n), each from the one before by a swap of the places (i, i + 1); with i, None at first."""
    order, way = list(range(n)), [-1] * n
    yield tuple(order), None
    while True:
        # The largest element that points to a smaller neighbour moves; all larger ones turn round.
        movable = [(x, i) for i, x in enumerate(order) if 0 <= i + way[x] < n and order[i + way[x]] < x]
        if not movable:
            return
        x, i = max(movable)
        j = i + way[x]
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, n):
            way[y] = -way[y]
        yield tuple(order), min(i, j)


MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


class Walk:
    """cells: parts x masks x (documents, good ones, toxic ones). Steps of the present order, all parts at once."""

    def __init__(self, cells: np.ndarray, n: int):
        self.cells, self.n, self.masks = cells, n, np.arange(1 << n)
        self.steps = np.zeros((len(cells), n, len(MEASURES)), np.int64)
        self.shapley = np.zeros((len(cells), n), np.int64)
        self.updated = 0

    def step(self, order: tuple[int, ...], i: int) -> None:
        """What the filter at place i does, from the cells that reach it."""
        before = sum(1 << f for f in order[:i])
        me = 1 << order[i]
        fails, reach = self.masks & me != 0, self.masks & before == 0
        removed = self.cells[:, fails & reach].sum(1)
        docs = self.cells[:, :, 0]
        self.steps[:, i] = np.stack(
            [
                docs[:, reach & ~fails].sum(1),
                removed[:, 0],
                docs[:, fails & ~reach].sum(1),
                docs[:, self.masks == me].sum(1),
                removed[:, 1],
                removed[:, 2],
            ],
            1,
        )
        self.updated += 1

    def run(self) -> list[tuple[tuple[int, ...], np.ndarray]]:
        """(order, steps) of every order."""
        out = []
        for order, swapped in adjacent_orders(self.n):
            for i in range(self.n) if swapped is None else (swapped, swapped + 1):
                self.step(order, i)
            self.shapley[:, list(order)] += self.steps[:, :, 1]
            out.append((order, self.steps.copy()))
        return out


def mask_cells(docs: DataFrame, labels: DataFrame, part: str, id_col: str, text_col: str, filters, duplicates: str | None) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the filters that they fail, bit i for the i-th."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters(F.col("__text")).values())), F.lit(0))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("__text"))
    rows = rows.select("__id", "part", bits.cast("int").alias("mask"), F.unhex(F.sha2("__text", 256)).alias("__digest"))
    rows = materialise(rows, "masks")
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id"))
    marks = marks.agg(F.max(F.col("quality").eqNullSafe(1).cast("int")).alias("good"), F.max(F.col("toxic").eqNullSafe(1).cast("int")).alias("toxic"))
    known, unknown = rows.filter("__id IS NOT NULL"), rows.filter("__id IS NULL")
    found = known.join(marks, "__id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    cell = ["part", "mask"]
    counts = [F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    if duplicates is None:
        rest = unknown.withColumns({"good": F.lit(0), "toxic": F.lit(0)})
        return found.unionByName(rest, allowMissingColumns=True).groupBy(*cell).agg(*counts)
    bit = 1 << len(filters(F.col("__text")))
    # A text's first document passes: texts are grouped with partial minima, and the join goes by the id, which no
    # group of copies shares.
    first = rows.groupBy("__digest").agg(F.min("__id").alias("__first"))
    mine = first.filter("__first IS NOT NULL").select(F.col("__first").alias("__id"), F.col("__digest").alias("__of"))
    found = found.join(mine, (found["__id"] == mine["__id"]) & (found["__digest"] == mine["__of"]), "left")
    found = found.withColumn("mask", F.col("mask") + F.when(F.col("__of").isNull(), bit).otherwise(0)).groupBy(*cell).agg(*counts)
    # Rows without an id are later than all others, and none is smaller than another.
    groups = unknown.groupBy("__digest", *cell).agg(F.count("*").alias("n"))
    groups = groups.join(first, "__digest").withColumn("mask", F.col("mask") + F.when(F.col("__first").isNotNull(), bit).otherwise(0))
    zero = F.lit(0).cast("long")
    return found.unionByName(groups.select(*cell, "n", zero.alias("good"), zero.alias("toxic"))).groupBy(*cell).agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def filter_audit(docs: DataFrame, labels: DataFrame, filters=text_filters, duplicates: str | None = "E", part: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each part, order of the filters and step: MEASURES and shapley (removed, over all orders).

    `filters`: from the text's column to conditions by letter; `duplicates`: the letter, after them, of the filter
    that a text fails which a row with a smaller id has (None: no such filter). A null text is empty, a null part the
    empty string. Labels: (id, quality, toxic); several of one id count once, as good or toxic if one of them says so.
    A row without an id has no label, and is a copy of any row with an id and the same text. Rows that share id and
    text are no copies of each other. An empty table has no parts and no rows. Other columns are ignored.

    What goes to a worker are mask cells, at most 2 ** filters for each part, however many documents there are.
    """
    letters = [*filters(F.col(text_col)), *([duplicates] if duplicates else [])]
    n = len(letters)
    cells = mask_cells(docs, labels, part, id_col, text_col, filters, duplicates)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def walk(batches):
        for batch in batches:
            names = batch.column("part").to_pylist()
            grid = np.zeros((len(names), 1 << n, 3), np.int64)
            for p, found in enumerate(batch.column("cells").to_pylist()):
                for c in found:
                    grid[p, c["mask"]] = c["n"], c["good"], c["toxic"]
            walked = Walk(grid, n)
            orders = walked.run()
            for p, name in enumerate(names):
                rows = [(name, "".join(letters[f] for f in order), i + 1, *map(int, steps[p, i]), int(walked.shapley[p, f])) for order, steps in orders for i, f in enumerate(order)]
                columns = list(zip(*rows, strict=True))
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * (len(MEASURES) + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "filter_order", "step", *MEASURES, "shapley"])

    return parts.mapInArrow(walk, SCHEMA)


#: The same for DuckDB.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
good AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(first < doc_id, first IS NOT NULL)::INT AS mask
    FROM t JOIN firsts USING (text) LEFT JOIN good USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT i, substr('ABCDE', i + 1, 1) AS letter, (1 << i)::INT AS bit FROM range(5) r(i)),
orders AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, list_sum(list_prepend(0, bits[1:step - 1]))::INT AS before FROM orders, range(1, 6) r(step)),
s AS (SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
    FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM s"""
