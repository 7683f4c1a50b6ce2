"""Substring deduplication with prefix-partitioned suffix trees over words.

Suffixes start at anchors (see repeats). They are split by prefixes of variable length until a group
fits in memory, and each group's suffixes, sorted word by word, are the leaves of its subtree: an
internal node of depth d is a run of leaves that have d words in common. A node as deep as the window
asks that has two leaves is a repeat; two leaves below it with the same way back make it a window that
begins before the anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats as rp
from . import textcodes as tc


def subtree(batches: list[rp.Suffixes], kept: list[rp.Suffixes], rule: rp.Rule):
    """([the rows], the spans) of one group, from the deep internal nodes of its subtree."""
    rows, spans, _ = rp.merged(rp.joined([*batches, *kept]).sorted(), rule)
    rows.seen |= rp.shared_windows(rows, rule)
    return [rows], tuple(np.concatenate(x) for x in zip(spans, rp.seen_spans(rows, rule), strict=True))


SCHEMA = "doc_id long, n_words long, n_removed long, span_starts array<int>, span_ends array<int>, kept string"


def _finish(raw_ids, keys, texts, spans) -> pa.Table:
    buf, offs = tc.buffer_of(pa.array(texts, pa.large_binary()))
    starts, ends, woffs = tc.words(buf, offs)
    n = len(starts)
    _, begin, size = rp.places_of(keys, woffs, spans)
    gone = tc.covered(n, begin, begin + size) if n else np.zeros(0, bool)
    edge = np.zeros(n + 1, bool)
    edge[woffs] = True
    first = np.flatnonzero(gone & (np.concatenate(([True], ~gone[:-1])) | edge[:-1])) if n else np.zeros(0, np.int64)
    past = np.flatnonzero(gone & (np.concatenate((~gone[1:], [True])) | edge[1:])) + 1 if n else np.zeros(0, np.int64)
    cut = np.searchsorted(first, woffs)
    home = np.repeat(woffs[:-1], np.diff(cut))
    lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array((x - home).astype(np.int32))) for x in (first, past)]
    keep = np.flatnonzero(~gone)
    kdoc = np.searchsorted(woffs, keep, "right") - 1
    more = np.zeros(len(keep), bool)
    more[:-1] = kdoc[1:] == kdoc[:-1]  # a kept word follows in the same document: one space goes between
    spaced = np.append(buf, np.uint8(0x20)).copy()
    spaced[:-1][tc.IS_SPACE[buf]] = 0x20
    inside = tc.covered(len(buf) + 1, starts[keep], ends[keep] + more)
    out = spaced[inside]
    size = np.bincount(kdoc, ends[keep] - starts[keep] + more, minlength=len(offs) - 1).astype(np.int64)
    koffs = np.concatenate(([0], np.cumsum(size)))
    return pa.table({
        "doc_id": raw_ids.combine_chunks() if isinstance(raw_ids, pa.ChunkedArray) else raw_ids,
        "n_words": np.diff(woffs), "n_removed": tc.counts_between(gone, woffs), "span_starts": lists[0], "span_ends": lists[1],
        "kept": pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(koffs.astype(np.int64)), pa.py_buffer(out.tobytes())).cast(pa.string()),
    })


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 35, anchor: int = 8) -> DataFrame:
    """Remove words covered by a window of `min_words` words that also starts anywhere else.

    Words are runs without white space, compared unchanged; "anywhere else" includes the same
    document, and all places of a repeat are removed. Windows are judged on the input. Result: a row
    for each input row: doc_id, n_words, n_removed, the removed runs (span_starts, span_ends, in
    words) and `kept`, the remaining words joined by one space. A null or empty text has no words. Rows
    that share an id, and rows with null ids, are places of their own, so that a repeated row loses all
    that is long enough. Very long texts are taken whole. Empty table: no rows. Other columns are
    ignored. `anchor` (k) trades index size against what sorting has to look at.
    """
    if not 1 <= anchor <= min_words <= 250:
        raise ValueError("1 <= anchor <= min_words <= 250")
    return rp.repeated(docs, id_col, text_col, rp.Words(), lambda parts, buckets: rp.Rule(min_words, anchor, True, parts, buckets), subtree, _finish, SCHEMA, "substring", two_rounds=True)[0]
