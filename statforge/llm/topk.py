"""Exact top-k by inner product, with no random access.

Candidates are packed into blocks, and so are queries; a row of work is one block of each. Of a block,
each dimension is a list of (row, value) sorted by value, of which a query uses the end that suits its
sign. The lists are read in ranges, to growing depths, once for all queries of the block. What is read of
a vector counts as it is; what isn't can give at most what was read last (its upper bound) and at least
the list's last value (its lower bound); vectors that no list has named share one upper bound. The k-th
score that a query has from the blocks before, or the k-th lower bound in this one, is the bar: a vector
whose upper bound stays below it cannot qualify. Once few are left, their final scores are resolved;
lists that are read to the end leave no bounds open. The bars of a task's queries go from
block to block, and so does the depth at which the block before was done.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise

#: Rows of a block, candidate blocks that a task takes one after the other, and bytes of queries that may be broadcast.
CANDIDATES, QUERIES, RUN, SMALL = 8192, 1024, 16, 16 << 20
#: Shares of a list that are read before its end.
DEPTHS = (1 / 16, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 15 / 16)
#: Query blocks of which a task remembers the best at a time.
HELD = 8
_BLOCK = "block long, dims long, ids binary, values binary"
_QUERY = "q_block long, q_dims long, q_rows binary, q_ids binary, q_values binary"


def _packed(scale: int):
    """Valid vectors, scaled, rounded down and packed. floor(scale * x) of a double is a double without a fraction."""

    def pack(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def out(dims):
            nonlocal n
            ids, values = (np.concatenate(x) for x in zip(*held.pop(dims), strict=True))
            for lo in range(0, len(ids), CANDIDATES):
                n += 1
                yield pa.RecordBatch.from_pydict({"block": [part * 2**32 + n], "dims": [dims], "ids": [ids[lo : lo + CANDIDATES].tobytes()], "values": [values[lo : lo + CANDIDATES].tobytes()]})

        for batch in batches:
            vec, ids = batch.column("v"), batch.column("id")
            if isinstance(vec, pa.ChunkedArray):
                vec = vec.combine_chunks()
            lens = np.asarray(pc.list_value_length(vec).fill_null(-1).to_numpy(zero_copy_only=False))
            good = (lens > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
            x = vec.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * x)
            offs = np.concatenate(([0], np.cumsum(np.maximum(lens, 0))))
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
            good &= bad[offs[1:]] == bad[offs[:-1]]
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for dims in np.unique(lens[good]).tolist():
                row = np.flatnonzero(good & (lens == dims))
                held.setdefault(dims, []).append((ids[row], x[offs[row][:, None] + np.arange(dims)]))
                if sum(len(a) for a, _ in held[dims]) >= CANDIDATES:
                    yield from out(dims)
        for dims in list(held):
            yield from out(dims)

    return pack


def _query_rows(every: int):
    """Of candidate blocks, the rows that are queries, packed anew; q_rows: (block, place) of each."""

    def pick(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def out(dims):
            nonlocal n
            rows, ids, values = (np.concatenate(x) for x in zip(*held.pop(dims), strict=True))
            for lo in range(0, len(ids), QUERIES):
                n += 1
                some = slice(lo, lo + QUERIES)
                yield pa.RecordBatch.from_pydict({"q_block": [part * 2**32 + n], "q_dims": [dims], "q_rows": [rows[some].tobytes()], "q_ids": [ids[some].tobytes()], "q_values": [values[some].tobytes()]})

        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    rows = np.stack((np.full(len(at), r["block"]), at), 1)
                    held.setdefault(r["dims"], []).append((rows, ids[at], np.frombuffer(r["values"], np.float64).reshape(-1, r["dims"])[at]))
                    if sum(len(x[1]) for x in held[r["dims"]]) >= QUERIES:
                        yield from out(r["dims"])
        for dims in list(held):
            yield from out(dims)

    return pick


class Best:
    """The k best of each query so far: scores descending, ties to the smaller id."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k, self.depth = q, k, 0
        self.query, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64)
        self.bar = np.full(len(q), -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        query, ids, scores = np.concatenate((self.query, query)), np.concatenate((self.ids, ids)), np.concatenate((self.scores.astype(scores.dtype), scores))
        order = sorted(range(len(ids)), key=lambda i: (query[i], -scores[i], ids[i])) if scores.dtype == object else np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        first = np.searchsorted(query, np.arange(len(self.q) + 1))
        keep = np.arange(len(query)) - first[query] < self.k
        self.query, self.ids, self.scores = query[keep], ids[keep], scores[keep]
        full = np.flatnonzero(np.diff(first) >= self.k)
        if scores.dtype != object:
            self.bar[full] = scores[first[full] + self.k - 1]


def largest_score(x: np.ndarray, q: np.ndarray) -> int:
    return int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * x.shape[1]


class Lists:
    """Each dimension of a block as a list of (row, value) by value, read in ranges from both ends.

    What was read lies in `top` (from the large values down) and `bottom` (from the small ones up), at infinity where
    nothing was; `met` are the rows that some list has named so far."""

    def __init__(self, x: np.ndarray):
        self.rows = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, self.rows, 0)
        self.top, self.bottom = np.full(x.shape, -np.inf), np.full(x.shape, np.inf)
        self.met, self.depth = np.zeros(len(x), bool), 0

    def read_to(self, depth: int) -> None:
        n = len(self.rows)
        for into, part in ((self.top, slice(n - depth, n - self.depth)), (self.bottom, slice(self.depth, depth))):
            np.put_along_axis(into, self.rows[part], self.values[part], 0)
            self.met[self.rows[part]] = True
        self.depth = depth

    def known(self) -> np.ndarray:
        """The rows met, or all of them without a copy."""
        return slice(None) if self.met.all() else np.flatnonzero(self.met)


def block_top_k(ids: np.ndarray, x: np.ndarray, own: tuple[np.ndarray, np.ndarray], best: Best, lists: Lists | None = None) -> np.ndarray:
    """Add what a block has to the best of each query; the share of the lists that was read when each was done.

    Bounds come from the lists alone, for rows met; one threshold holds for all others. x gives the final scores of the
    few that may qualify. own: (row, query) of queries that are rows of this block. Sums stay below 2 ** 53, so that
    doubles are exact."""
    n, k = len(ids), best.k
    lists = Lists(x) if lists is None else lists
    read, todo, stops = np.ones(len(best.q)), np.arange(len(best.q)), []
    for place in range(max(0, best.depth - 1), len(DEPTHS)):
        depth = int(n * DEPTHS[place])
        if depth < max(1, lists.depth) or not len(todo):
            continue
        lists.read_to(depth)
        known = lists.known()
        at_row = np.arange(n)[known]
        top, bottom = lists.top[known], lists.bottom[known]
        high, low = lists.values[n - depth], lists.values[depth - 1]
        up, down = np.maximum(best.q[todo], 0).T, np.minimum(best.q[todo], 0).T
        upper = np.maximum(top, high) @ up + np.minimum(bottom, low) @ down
        bar = best.bar[todo]
        if len(at_row) > k and not np.isfinite(bar).all():
            lower = np.maximum(top, lists.values[0]) @ up + np.minimum(bottom, lists.values[-1]) @ down
            row, query = _own(own, todo, len(best.q))
            here = lists.met[row]
            lower[np.searchsorted(at_row, row[here]), query[here]] = -np.inf
            bar = np.maximum(bar, np.partition(lower, len(at_row) - k, axis=0)[len(at_row) - k])
        alive = upper >= bar
        few = alive.sum(0) <= 8 * k
        if len(at_row) < n:  # rows that no list has named yet
            few &= high @ up + low @ down < bar
        row, at = np.nonzero(alive[:, few])
        done = todo[few]
        _resolve(ids, x, own, best, at_row[row], done[at])
        read[done] = DEPTHS[place]
        stops += [place] * len(done)
        todo = todo[~few]
    if len(todo):  # every list is read to its end
        lists.read_to(n)
        scores = lists.top @ best.q[todo].T
        scores[_own(own, todo, len(best.q))] = -np.inf
        bar = np.maximum(best.bar[todo], np.partition(scores, n - k, axis=0)[n - k] if n > k else -np.inf)
        row, at = np.nonzero((scores >= bar) & np.isfinite(scores))
        best.add(todo[at], ids[row], scores[row, at])
        stops += [len(DEPTHS)] * len(todo)
    best.depth = int(np.median(stops)) if stops else 0
    return read


def _own(own, todo: np.ndarray, n: int):
    at = np.full(n, -1)
    at[todo] = np.arange(len(todo))
    keep = at[own[1]] >= 0
    return own[0][keep], at[own[1][keep]]


def _resolve(ids, x, own, best: Best, row, query) -> None:
    mine = np.isin(row * len(best.q) + query, own[0] * len(best.q) + own[1])
    row, query = row[~mine], query[~mine]
    best.add(query, ids[row], np.einsum("ij,ij->i", x[row], best.q[query]))


def every_score(ids: np.ndarray, x: np.ndarray, own, best: Best) -> None:
    """For sums beyond 2 ** 53, which doubles don't hold: all scores, in whole numbers of any size."""
    whole = np.frompyfunc(int, 1, 1)
    big, small = whole(x), whole(best.q)
    best.scores = whole(best.scores).astype(object)
    for j in range(len(best.q)):
        scores = big @ small[j]
        rows = np.setdiff1d(np.arange(len(ids)), own[0][own[1] == j])
        best.add(np.full(len(rows), j), ids[rows], scores[rows])


def sortable(n: int) -> str:
    """A text in whose order whole numbers of any size come (below 10,000 digits)."""
    digits = str(abs(n))
    if n >= 0:
        return f"1{len(digits):04}{digits}"
    return f"0{9999 - len(digits):04}{digits.translate(str.maketrans('0123456789', '9876543210'))}"


def _search(k: int):
    """(candidate block, query block) rows -> the best of each query, over all blocks that this task has met."""

    def out(rows, query_ids, best):
        limit = np.iinfo(np.int64)
        scores = np.array([min(max(int(s), limit.min), limit.max) for s in best.scores.tolist()], np.int64)
        true = [sortable(int(s)) if s != n else None for s, n in zip(best.scores.tolist(), scores.tolist(), strict=True)]
        at = best.query
        return pa.RecordBatch.from_pydict({"query_id": query_ids[at], "row_block": rows[at, 0], "row_place": rows[at, 1], "vec_id": best.ids, "score": scores, "true": pa.array(true, pa.string())})

    def search(batches):
        held: OrderedDict = OrderedDict()
        last = (None, None)
        for batch in batches:
            for r in batch.to_pylist():
                ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["values"], np.float64).reshape(-1, r["dims"])
                name = r["q_block"]
                if name not in held:
                    rows = np.frombuffer(r["q_rows"], np.int64).reshape(-1, 2)
                    held[name] = rows, np.frombuffer(r["q_ids"], np.int64), Best(np.frombuffer(r["q_values"], np.float64).reshape(-1, r["dims"]), k)
                    if len(held) > HELD:
                        yield out(*held.popitem(last=False)[1])
                held.move_to_end(name)
                rows, _, best = held[name]
                here = np.flatnonzero(rows[:, 0] == r["block"])
                own = rows[here, 1], here
                if best.scores.dtype == object or largest_score(x, best.q) >= 2**53:
                    every_score(ids, x, own, best)
                    continue
                if last[0] != r["block"]:
                    last = r["block"], Lists(x)
                block_top_k(ids, x, own, best, last[1])
        for one in held.values():
            yield out(*one)

    return search


def _grid(cands: DataFrame, queries: DataFrame, n_blocks: int) -> DataFrame:
    """Every candidate block beside every query block of its length, in cells of RUN candidate blocks and HELD query
    blocks: a candidate block is shipped once for each HELD query blocks, a query block once for each RUN candidate
    blocks. What is broadcast has a row for each group of query blocks and length."""
    runs = -(-n_blocks // RUN)
    groups = max(1, -(-queries.count() // HELD))
    queries = queries.withColumn("q_group", F.pmod(F.xxhash64("q_block"), F.lit(groups)))
    names = queries.select(F.col("q_dims").alias("dims"), F.col("q_group").alias("group")).distinct()
    meets = cands.withColumn("run", F.pmod(F.xxhash64("block"), F.lit(runs))).join(F.broadcast(names), "dims")
    every_run = queries.withColumn("q_run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    return meets.join(every_run, (F.col("group") == F.col("q_group")) & (F.col("run") == F.col("q_run")) & (F.col("dims") == F.col("q_dims")))


def exact_top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: of each query the k other rows with the largest inner products.

    Components are turned into floor(scale * x); scores are exact whole numbers. Queries: rows whose id is
    divisible by `every`. Ties go to the smaller id. Vectors that are null or empty, hold a null or a
    component that isn't finite (scaled), or have no id, take no part; vectors of different lengths don't
    meet. Rows that share an id are queries and candidates of their own: each has its ranks, and only the
    row itself is no candidate of its query. A score beyond 64 bits is ranked by its true value and
    returned as the nearest 64-bit number. Fewer than k candidates: all of them. Empty table: no rows.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    cands = materialise(rows.mapInArrow(_packed(scale), _BLOCK), "candidates")
    n_blocks = max(1, cands.count())
    queries = cands.repartition(max(1, n_blocks * CANDIDATES // (QUERIES * every)), "block").mapInArrow(_query_rows(every), _QUERY)
    queries = materialise(queries, "queries")
    size = queries.agg(F.sum(F.octet_length("q_values")).alias("n")).first()["n"] or 0
    # Query blocks are the stated query set: every candidate block of their length meets each of them.
    if size <= SMALL:
        pairs = cands.join(F.broadcast(queries), F.col("dims") == F.col("q_dims"))
    else:
        pairs = _grid(cands, queries, n_blocks)
    pairs = pairs.select("block", "dims", "ids", "values", "q_block", "q_rows", "q_ids", "q_values")
    best = pairs.mapInArrow(_search(k), "query_id long, row_block long, row_place long, vec_id long, score long, true string")
    rank = F.row_number().over(Window.partitionBy("query_id", "row_block", "row_place").orderBy(F.desc("score"), F.desc_nulls_last("true"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
