"""Suffix-array deduplication: a logarithmic family of sparse suffix arrays.

Each batch of new documents gets a suffix array: its anchors' suffixes (see repeats), sorted byte by
byte. When an array arrives it is merge-scanned for long matches within itself and against every level
of the family; then it becomes a level, and levels of about equal size merge, so that n batches leave
about log2(n) levels and every suffix is merged about log2(n) times. Each bucket of suffixes has a
family of its own. A family can be kept in a folder (`index`): later calls scan their documents against
its levels, write one new level and take over the levels that have grown equal to it.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats as rp
from . import scratch
from . import textcodes as tc

#: Suffixes that make a batch, unless there are fewer.
BATCH = 1 << 16


def grams(x: rp.Suffixes, rule: rp.Rule) -> np.ndarray:
    """A fingerprint of the first k bytes of each suffix: unequal ones have nothing to compare."""
    code = np.zeros(len(x), np.uint64)
    letters = tc.byte_symbols(np.arange(256, dtype=np.uint8))
    for j in range(rule.k):
        code = code * np.uint64(0x9FB21C651E98DF25) + letters[x.table[:, j]]
    return tc.mix(code)


class Levels:
    """Sorted suffix arrays, the largest first; neighbours differ in size by a factor of two at least. `kept`
    are levels of earlier calls, which are scanned but don't merge."""

    def __init__(self, rule: rp.Rule, kept: list[rp.Suffixes] = ()):
        self.rule, self.levels, self.spans = rule, [], []
        self.kept = [(x, grams(x, rule)) for x in ([rp.joined(list(kept)).sorted()] if kept else [])]

    def add(self, batch: rp.Suffixes) -> None:
        """Sort a batch, scan it against itself and every level, and let equal levels merge."""
        new = self._merged(batch)
        new.seen |= rp.shared_windows(new, self.rule)
        codes = grams(new, self.rule)
        for level, its in (*self.kept, *self.levels):
            self._scan(new, codes, level, its)
        self.levels.append((new, codes))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            one, two = self.levels.pop()[0], self.levels.pop()[0]
            both = self._merged(rp.joined([two, one]))
            self.levels.append((both, grams(both, self.rule)))

    def _merged(self, x: rp.Suffixes) -> rp.Suffixes:
        x, spans, _ = rp.merged(x.sorted(), self.rule)
        self.spans.append(spans)
        return x

    def _scan(self, new: rp.Suffixes, codes: np.ndarray, level: rp.Suffixes, its: np.ndarray) -> None:
        mine, theirs = np.flatnonzero(np.isin(codes, its)), np.flatnonzero(np.isin(its, codes))
        if not len(mine) or not len(theirs):
            return
        both = rp.joined([new.take(mine), level.take(theirs)])
        order = rp.suffix_order(both.table)
        found = np.empty_like(both.seen)
        found[order] = rp.shared_windows(both.take(order), self.rule)
        new.seen[mine] |= found[: len(mine)]
        level.seen[theirs] |= found[len(mine) :]

    def close(self) -> tuple[list[rp.Suffixes], tuple[np.ndarray, ...]]:
        """The levels, and every span that has been found."""
        rows = [x for x, _ in self.levels]
        return rows, tuple(np.concatenate(x) for x in zip(rp.no_spans(), *self.spans, *(rp.seen_spans(x, self.rule) for x in rows), strict=True))


def family(batches: list[rp.Suffixes], kept: list[rp.Suffixes], rule: rp.Rule):
    levels, held, size = Levels(rule, kept), [], 0
    for i, x in enumerate(batches):
        held.append(x)
        size += len(x)
        if size >= BATCH or i == len(batches) - 1:
            levels.add(rp.joined(held))
            held, size = [], 0
    return levels.close()


# A family in a folder: level-<documents>-<buckets>-<id>, each a table of rows by bucket.


def stored_levels(spark: SparkSession, index: str) -> list[tuple[int, int, str]]:
    """(documents, buckets, path) of the levels in a folder, the largest first."""
    names = [n for n in scratch.listed(spark, index) if n.startswith("level-")]
    return sorted(((int(n.split("-")[1]), int(n.split("-")[2]), f"{index}/{n}") for n in names), reverse=True)


SCHEMA = "doc_id long, n_bytes long, n_removed long, span_starts array<int>, span_ends array<int>, kept binary"


def _finish(raw_ids, keys, texts, spans, whole: bool = False) -> pa.Table:
    buf, offs = tc.buffer_of(pa.array(texts, pa.large_binary()))
    _, begin, size = rp.places_of(keys, offs, spans)
    gone = tc.covered(len(buf), begin, begin + size) if len(buf) else np.zeros(0, bool)
    if whole:
        char = np.cumsum((buf & 0xC0) != 0x80) - 1
        hit = np.zeros(len(buf), bool)
        hit[char[gone]] = True
        gone = hit[char] if len(buf) else gone
    before = np.zeros(len(buf) + 1, bool)
    before[1:] = gone
    before[offs[:-1]] = False
    first = np.flatnonzero(gone & ~before[:-1])
    after = np.zeros(len(buf) + 1, bool)
    after[: len(buf)] = gone
    after[offs[1:]] = False
    past = np.flatnonzero(gone & ~after[1:]) + 1
    cut = np.searchsorted(first, offs)
    n_removed = tc.counts_between(gone, offs)
    kept = buf[~gone]
    koffs = offs - np.concatenate(([0], np.cumsum(n_removed)))
    home = np.repeat(offs[:-1], np.diff(cut))
    lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array((x - home).astype(np.int32))) for x in (first, past)]
    data = kept.tobytes()
    return pa.table({
        "doc_id": raw_ids.combine_chunks() if isinstance(raw_ids, pa.ChunkedArray) else raw_ids,
        "n_bytes": np.diff(offs), "n_removed": n_removed, "span_starts": lists[0], "span_ends": lists[1],
        "kept": pa.array([data[a:b] for a, b in zip(koffs[:-1], koffs[1:], strict=True)], pa.binary()),
    })


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 50, anchor: int = 20, carry: tuple[str, ...] = (), whole_characters: bool = False, index: str | None = None) -> DataFrame:
    """Remove bytes covered by a `min_bytes` string that also starts in a document with a smaller id.

    Texts are UTF-8 bytes; matches do not cross documents and are judged on the input. Result: a row
    for each input row: doc_id, n_bytes, n_removed, the removed runs (span_starts, span_ends, in
    bytes) and `kept`, the remaining bytes. A null text is empty. A null id is smaller than all others.
    Rows that share an id, or have none, are texts of their own, and none of them is smaller than
    another, so that a repeated row keeps what no other document has. Very long texts are taken whole.
    Empty table: no rows. Other columns are ignored, but for those named in `carry`, which come back.
    `whole_characters`: a character of which a byte goes, goes whole. `anchor` (k) trades index size
    against what sorting has to look at. `index`: a folder that keeps the suffix arrays of all calls;
    documents of earlier calls are then matched against as well, but not judged again. The folder must
    have been filled with the same min_bytes and anchor.
    """
    if not 1 <= anchor <= min_bytes <= 250:
        raise ValueError("1 <= anchor <= min_bytes <= 250")
    spark, finish = docs.sparkSession, partial(_finish, whole=whole_characters)
    rule = lambda parts, buckets: rp.Rule(min_bytes, anchor, False, parts, buckets)
    if index is None:
        return rp.repeated(docs, id_col, text_col, rp.Bytes(), rule, family, finish, SCHEMA, "suffix", tuple(carry), two_rounds=True)[0]
    stored, size = stored_levels(spark, index), max(1, docs.count())
    buckets, taken = stored[0][1] if stored else 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), []
    while stored and stored[-1][0] <= 2 * size:
        taken.append(stored.pop())
        size += taken[-1][0]
    levels = spark.createDataFrame([], rp.ROW)
    for kind, some in ((rp.LEVEL, taken), (rp.KEPT, stored)):
        for _, _, path in some:
            levels = levels.unionByName(spark.read.schema(rp.ROW).parquet(path).withColumn("kind", F.lit(kind)))
    out, found = rp.repeated(docs, id_col, text_col, rp.Bytes(), rule, family, finish, SCHEMA, "suffix", tuple(carry), levels, buckets)
    found.filter(F.col("kind") == rp.LEVEL).write.parquet(f"{index}/level-{size}-{buckets}-{scratch.fresh()}")
    for _, _, path in taken:
        scratch.delete(spark, path)
    return out
