"""Exact search for repeated windows, shared by the substring and the suffix-array operators.

Both ask which windows of `width` consecutive symbols also start elsewhere. Indexing every suffix
would move some fifty times the input, so the index is sparse: of the `width - k + 1` k-grams in a
window the one with the smallest hash is its anchor, and only suffixes that start at anchors are kept.
Equal windows have equal anchors at equal offsets, so anchors find every repeat. Consecutive windows
with one anchor form a *unit*: a suffix row holds the symbols that its windows span, from the anchor
to the right (the suffix) and from the anchor to the left (its way back). Rows are sorted by the
suffix, symbol by symbol. A window that begins o symbols before its anchor is a node of the suffixes
as deep as `width - o` and a node of the ways back as deep as o; two windows are equal if both nodes are.

A row costs some forty bytes, compressed, for each sixteen bytes of text, and most rows have a k-gram
that nothing else has. So a first round can pick the units that have company: of every unit it moves two
fingerprints only, of the k-gram and of the whole unit. Rows are made of the units whose k-gram begins
other units, or other documents, as well. Of units that are equal as a whole, two get rows; further
copies share what the comparison of those two says.

What moves is (kind, key, blob): rows of one batch for one bucket of k-grams, compressed. Equal rows
of a task are merged before they move. Buckets larger than a task should hold are split by prefixes
of growing length; what is still too many with k symbols in common is dealt out once more, window by
window, by 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from . import textcodes as tc
from .scratch import materialise

ENTRY, SPAN, WINDOW, LEVEL, KEPT, ASK = range(6)
ROW = "kind int, key long, blob binary"
_ARROW = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("blob", pa.binary())])
NULL_ID = np.iinfo(np.int64).min
#: Bytes of suffix rows that a task sorts at once and of a group that it loads, and bytes of text of a part.
FLUSH, GROUP, PART = 24 << 20, 32 << 20, 4 << 20
#: Symbols of a long text that are taken at once.
SEGMENT = 1 << 20
#: Units of the first round that a task settles at once, and that a bucket may have to be looked at as one.
UNITS, BUCKET = 600_000, 3_000_000
#: Bytes of text for each partition, where the session has fewer partitions than that takes.
SHARE = 64 << 20
_SLICE = 1 << 18
_SPAN_COLUMNS = (("key", np.uint64, 8), ("at", np.int64, 5), ("size", np.int64, 4))
_UNIT_COLUMNS = (("a", np.uint64, 5), ("g", np.uint64, 8), ("doc", np.int64, 8), ("salt", np.uint64, 4), ("at", np.int64, 5), ("more", np.uint8, 1), ("back", np.uint8, 1))
_ASK_COLUMNS = (("key", np.uint64, 8), ("at", np.int64, 5), ("more", np.int64, 1), ("back", np.int64, 1))
_WINDOW_COLUMNS = (("code", np.uint64, 8), ("doc", np.int64, 8), ("key", np.uint64, 8), ("at", np.int64, 5), ("many", np.uint8, 1))


@dataclass(frozen=True)
class Rule:
    """width: symbols in a window. k: symbols in an anchor. elsewhere: True if any other place counts
    (then all places are covered), False if only documents with a smaller id do."""

    width: int
    k: int
    elsewhere: bool
    parts: int
    buckets: int

    @property
    def before(self) -> int:
        """The most symbols of a window that come before its anchor."""
        return self.width - self.k


def pack(columns, spec) -> bytes:
    planes = [np.array([len(columns[0])], np.int64).tobytes()]
    for values, (_, kind, size) in zip(columns, spec, strict=True):
        planes.append(planes_of(values.astype(kind), size))
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def planes_of(values: np.ndarray, size: int) -> bytes:
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)[:, :size]
    return np.ascontiguousarray(raw.T).tobytes()


def unpack(blob: bytes, spec) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, at, out = int(raw[:8].view(np.int64)[0]), 8, []
    for _, kind, size in spec:
        out.append(from_planes(raw[at : at + n * size], n, kind, size))
        at += n * size
    return out


def from_planes(raw: np.ndarray, n: int, kind, size: int) -> np.ndarray:
    wide = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    wide[:, :size] = raw.reshape(size, n).T
    return wide.reshape(-1).view(kind)


def first_of_runs(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def rows_by(kind: int, keys: np.ndarray, columns, spec) -> Iterator[tuple[int, int, bytes]]:
    """A row for each key, with what belongs to it."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys, columns = keys[order], [c[order] for c in columns]
    heads = np.flatnonzero(first_of_runs(keys))
    for lo, hi in zip(heads, [*heads[1:], len(keys)], strict=True):
        yield kind, int(keys[lo]), pack([c[lo:hi] for c in columns], spec)


def to_batches(rows) -> Iterator[pa.RecordBatch]:
    kinds, keys, blobs, size = [], [], [], 0
    for kind, key, blob in rows:
        kinds.append(kind)
        keys.append(key)
        blobs.append(blob)
        size += len(blob)
        if size > 8 << 20 or len(keys) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], schema=_ARROW)
            kinds, keys, blobs, size = [], [], [], 0
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], schema=_ARROW)


def ids(batch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def unzipped(column) -> list[bytes]:
    d = zstandard.ZstdDecompressor()
    return [d.decompress(x.as_py()) for x in column]


def salts(batch) -> np.ndarray:
    return batch.column("salt").to_numpy(zero_copy_only=False).astype(np.int64)


def row_keys(doc: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A key for each row: rows that share an id differ in it, unless their texts are equal as well."""
    return tc.mix(doc.view(np.uint64)) + (salt.view(np.uint64) & np.uint64(0xFFFFFFFF))


# Suffix rows


def suffix_strings(table: np.ndarray) -> np.ndarray:
    """Rows as byte strings that compare as the rows do."""
    table = table if table.dtype == np.uint8 else table.byteswap()
    table = np.ascontiguousarray(table)
    return table.view(f"S{table.shape[1] * table.dtype.itemsize}").reshape(-1)


def _head(table: np.ndarray) -> np.ndarray:
    """What 64 bits hold of each row's first symbols, in the order of the rows."""
    if table.dtype == np.uint64:
        return table[:, 0]
    if table.shape[1] < 8:
        table = np.concatenate((table, np.zeros((len(table), 8), np.uint8)), 1)
    return np.ascontiguousarray(table[:, :8]).view(">u8").reshape(-1).astype(np.uint64)


def suffix_order(table: np.ndarray) -> np.ndarray:
    """The order of the rows, symbol by symbol: by their heads, and in full only where heads are equal."""
    head = _head(table)
    order = np.argsort(head, kind="stable")
    same = head[order[1:]] == head[order[:-1]]
    tied = np.zeros(len(order), bool)
    tied[1:] = same
    tied[:-1] |= same
    at = np.flatnonzero(tied)
    if len(at):
        rows = order[at]
        order[at] = rows[np.argsort(suffix_strings(table[rows]), kind="stable")]
    return order


def common_prefix(table: np.ndarray) -> np.ndarray:
    """Of each row but the first, the symbols it has in common with the row before."""
    differ = table[1:] != table[:-1]
    return np.where(differ.any(1), differ.argmax(1), table.shape[1]) if table.shape[1] else np.zeros(max(0, len(table) - 1), np.int64)


class Suffixes:
    """Suffix rows. table: `width` symbols of the suffix, then `before` symbols of the way back, 0 beyond
    what the unit spans. Its windows begin lo to hi symbols before the anchor. doc: the row's document;
    many: 1 if the row stands for several places. seen: which windows are known to repeat. unit: where a row
    comes from, as long as that is in memory. The places that are not settled yet: place_row, place_at (of the unit's first window) and place_key (row_keys)."""

    FIELDS = ("table", "lo", "hi", "doc", "many", "seen", "unit")

    def __init__(self, table, lo, hi, doc, many, seen, unit, place_row, place_at, place_key):
        self.table, self.lo, self.hi, self.doc, self.many, self.seen, self.unit = table, lo, hi, doc, many, seen, unit
        self.place_row, self.place_at, self.place_key = place_row, place_at, place_key

    def __len__(self) -> int:
        return len(self.lo)

    def take(self, rows: np.ndarray) -> Suffixes:
        to = np.full(len(self), -1, np.int64)
        to[rows] = np.arange(len(rows))
        place = to[self.place_row]
        keep = place >= 0
        return Suffixes(*(getattr(self, f)[rows] for f in self.FIELDS), place[keep], self.place_at[keep], self.place_key[keep])

    def sorted(self) -> Suffixes:
        return self.take(suffix_order(self.table))

    def without_places(self) -> Suffixes:
        none = np.zeros(0, np.int64)
        return Suffixes(*(getattr(self, f) for f in self.FIELDS), none, none, none.view(np.uint64))


def joined(parts: list[Suffixes]) -> Suffixes:
    if len(parts) == 1:
        return parts[0]
    base = np.cumsum([0, *(len(p) for p in parts)])
    fields = (np.concatenate([getattr(p, f) for p in parts]) for f in Suffixes.FIELDS)
    return Suffixes(*fields, np.concatenate([p.place_row + b for p, b in zip(parts, base, strict=False)]), *(np.concatenate([getattr(p, f) for p in parts]) for f in ("place_at", "place_key")))


def no_spans():
    return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)


def merged(x: Suffixes, rule: Rule):
    """Sorted rows, with equal ones merged: (rows, (key, at, size) of the places that this settles, where the runs
    of equal rows began)."""
    if not len(x):
        return x, no_spans(), np.zeros(0, np.int64)
    head = _head(x.table)
    same = np.zeros(len(x), bool)
    at = np.flatnonzero(head[1:] == head[:-1])
    same[at + 1] = (x.table[at] == x.table[at + 1]).all(1) & (x.lo[at] == x.lo[at + 1]) & (x.hi[at] == x.hi[at + 1])
    run = np.cumsum(~same) - 1
    heads = np.flatnonzero(~same)
    own = run[x.place_row]
    if rule.elsewhere:
        twice = (np.diff(np.append(heads, len(x))) + np.maximum.reduceat(x.many, heads)) > 1
        rest, settled = heads, twice[own]
        many, seen = np.where(twice, 1, x.many[heads]).astype(np.uint8), np.logical_or.reduceat(x.seen, heads, axis=0)
    else:
        least = np.minimum.reduceat(x.doc, heads)
        first = np.flatnonzero(x.doc == least[run])
        rest = first[first_of_runs(run[first])]
        settled = x.doc[x.place_row] > least[own]
        many, seen = x.many[rest], np.logical_or.reduceat(x.seen[first], np.searchsorted(run[first], np.arange(len(heads))), axis=0)
    spans = x.place_key[settled], x.place_at[settled], (x.hi - x.lo)[x.place_row[settled]].astype(np.int64) + rule.width
    out = Suffixes(x.table[rest], x.lo[rest], x.hi[rest], x.doc[rest], many, seen, x.unit[rest], own[~settled], x.place_at[~settled], x.place_key[~settled])
    return out, spans, heads


def shared_windows(x: Suffixes, rule: Rule) -> np.ndarray:
    """Of sorted rows that all differ, which windows (by offset) repeat, as the rule has it."""
    found = np.zeros((len(x), rule.before + 1), bool)
    if len(x) < 2:
        return found
    depth = common_prefix(x.table[:, : rule.width])
    near = np.zeros(len(x), bool)
    near[1:] = depth >= rule.k
    near[:-1] |= depth >= rule.k
    rows = np.flatnonzero(near)
    n = len(rows)
    if not n:
        return found
    depth = np.where(rows[1:] == rows[:-1] + 1, depth[rows[1:] - 1], 0)
    lo, hi, doc, back = x.lo[rows], x.hi[rows], x.doc[rows], x.table[rows, rule.width :]
    way = np.argsort(suffix_strings(back), kind="stable") if rule.before else np.arange(n)
    back_depth = common_prefix(back[way])
    path = np.empty(n, np.int64)
    for o in range(rule.before + 1):
        use = np.flatnonzero((lo <= o) & (hi >= o))
        if len(use) < 2:
            continue
        node = np.concatenate(([0], np.cumsum(depth < rule.width - o)))
        path[way] = np.concatenate(([0], np.cumsum(back_depth < o)))
        both = node[use] * n + path[use]
        order = np.argsort(both)
        heads = np.flatnonzero(first_of_runs(both[order]))
        sizes = np.diff(np.append(heads, len(use)))
        if rule.elsewhere:
            hit = np.repeat(sizes > 1, sizes)
        else:
            d = doc[use[order]]
            hit = d > np.repeat(np.minimum.reduceat(d, heads), sizes)
        found[rows[use[order[hit]]], o] = True
    return found


def seen_spans(x: Suffixes, rule: Rule):
    """(key, at, size) of the runs of windows that are seen, at each unsettled place."""
    some = np.flatnonzero(x.seen.any(1)[x.place_row]) if len(x) else np.zeros(0, np.int64)
    flags = np.zeros((len(some), rule.before + 3), np.int8)
    flags[:, 1:-1] = x.seen[x.place_row[some]][:, ::-1]  # from the window that begins first
    step = np.diff(flags, axis=1)
    (place, begin), (_, past) = np.nonzero(step == 1), np.nonzero(step == -1)
    first = rule.before - x.hi[x.place_row[some]].astype(np.int64)  # the column of the unit's first window
    return x.place_key[some][place], x.place_at[some][place] + begin - first[place], past - begin + rule.width - 1


def spans_out(spans, rule: Rule):
    yield from rows_by(SPAN, (spans[0] % np.uint64(rule.parts)).astype(np.int64), spans, _SPAN_COLUMNS)


# Units


def units(symbols: np.ndarray, offs: np.ndarray, rule: Rule) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor, k-gram, whole unit) of every unit of a slice."""
    n, w = len(symbols), rule.before + 1
    lengths = np.diff(offs)
    if n < rule.width or not (lengths >= rule.width).any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    win = tc.Windows(symbols, 16)
    code = tc.mix(win.all(rule.k))
    key = code & np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(len(key), dtype=np.uint64)
    size = 1
    while size * 2 <= w:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if w > size:
        key = np.minimum(key[: len(key) - (w - size)], key[w - size :])
    change = np.zeros(n - rule.width + 2, np.int8)
    long = lengths >= rule.width
    first, past = offs[:-1][long], offs[1:][long] - rule.width + 1
    change[first] += 1
    change[past] -= 1
    valid = np.flatnonzero(np.cumsum(change[:-1], dtype=np.int8) > 0)
    anchor = (key[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(valid), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(valid)) - 1
    s, e, a = valid[head], valid[tail], anchor[head]
    # A document boundary always ends a unit: no window crosses it, so valid starts are not adjacent there.
    g = tc.mix(win.at(s, rule.width)) * np.uint64(0x9FB21C651E98DF25) + tc.mix(win.at(e, rule.width))
    return np.searchsorted(offs, s, "right") - 1, s, e, a, code[a], tc.mix(g + ((e - s) * 256 + (a - s)).astype(np.uint64))


def all_units(symbols, letters: np.ndarray, offs: np.ndarray, rule: Rule) -> tuple[np.ndarray, ...]:
    """units() of a slice; a long text is taken in segments, each with the windows that begin in it. That cuts units,
    but leaves every window in one of them."""
    if len(offs) != 2 or len(letters) <= SEGMENT + rule.width:
        return units(symbols.letters(letters), offs, rule)
    found = []
    for lo in range(0, len(letters) - rule.width + 1, SEGMENT):
        part = symbols.letters(letters[lo : lo + SEGMENT + rule.width - 1])
        d, s, e, a, code, g = units(part, np.array([0, len(part)]), rule)
        found.append((d, s + lo, e + lo, a + lo, code, g))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def suffix_table(symbols: np.ndarray, s: np.ndarray, e: np.ndarray, a: np.ndarray, rule: Rule) -> np.ndarray:
    """The rows of units (see Suffixes); symbols as numbers above 0 or as bytes."""
    width, before = rule.width, rule.before
    padded = np.concatenate((np.zeros(before, symbols.dtype), symbols, np.zeros(width, symbols.dtype)))
    view = np.lib.stride_tricks.sliding_window_view(padded, before + width)[a]
    out = np.zeros((len(a), width + before), symbols.dtype)
    np.multiply(view[:, before:], np.arange(width) < (e + width - a)[:, None], out=out[:, :width])
    np.multiply(view[:, :before][:, ::-1], np.arange(before) < (a - s)[:, None], out=out[:, width:])
    return out


def spanned(lo: np.ndarray, hi: np.ndarray, rule: Rule) -> np.ndarray:
    """Which cells of a table the units span."""
    out = np.empty((len(lo), rule.width + rule.before), bool)
    out[:, : rule.width] = np.arange(rule.width) < (rule.width - lo.astype(np.int64))[:, None]
    out[:, rule.width :] = np.arange(rule.before) < hi.astype(np.int64)[:, None]
    return out


class Bytes:
    """Symbols are the bytes of a text."""

    dtype = np.uint8

    def slices(self, buf, offs):
        """(symbols, first and past byte of each symbol where that isn't its place, offsets) of a slice."""
        return buf, None, None, offs

    def put(self, x: Suffixes, rule: Rule, *source) -> bytes:
        return x.table[spanned(x.lo, x.hi, rule)].tobytes()

    def get(self, raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: Rule) -> np.ndarray:
        table = np.zeros((len(lo), rule.width + rule.before), np.uint8)
        table[spanned(lo, hi, rule)] = raw
        return table

    def letters(self, column: np.ndarray) -> np.ndarray:
        """64-bit codes of symbols, by which anchors are chosen."""
        return tc.byte_symbols(column)


class Words:
    """Symbols are the 64-bit fingerprints of words; the words themselves are what moves."""

    dtype = np.uint64

    def slices(self, buf, offs):
        starts, ends, woffs = tc.words(buf, offs)
        return tc.span_codes(buf, starts, ends), starts, ends, woffs

    def put(self, x: Suffixes, rule: Rule, held: bytes, begin, end) -> bytes:
        texts = [held[i:j] for i, j in zip(begin[x.unit].tolist(), end[x.unit].tolist(), strict=True)]
        return planes_of(np.array([len(t) for t in texts], np.uint32), 4) + b"".join(texts)

    def get(self, raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: Rule) -> np.ndarray:
        n = len(lo)
        offs = np.concatenate(([0], np.cumsum(from_planes(raw[: 4 * n], n, np.uint32, 4), dtype=np.int64)))
        buf = raw[4 * n :]
        starts, ends, woffs = tc.words(buf, offs)
        first = woffs[:-1]
        return suffix_table(tc.span_codes(buf, starts, ends), first, first + hi - lo, first + hi, rule)

    def letters(self, column: np.ndarray) -> np.ndarray:
        return column


def freeze(x: Suffixes, rule: Rule, symbols, *source) -> bytes:
    """Rows as a blob: their number, then all that Suffixes has but `seen` and `unit`."""
    order = np.argsort(x.place_row, kind="stable")
    body = symbols.put(x, rule, *source)
    raw = [np.array([len(body), len(order)], np.int64).tobytes(), body, x.lo.astype(np.uint8).tobytes(), x.hi.astype(np.uint8).tobytes(), planes_of(x.doc, 8), x.many.tobytes()]
    raw += [planes_of(np.bincount(x.place_row, minlength=len(x)).astype(np.uint32), 4), planes_of(x.place_at[order], 5), planes_of(x.place_key[order] - _doc_keys(x.doc[x.place_row[order]], rule), 8)]
    return len(x).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _doc_keys(doc: np.ndarray, rule: Rule) -> np.ndarray:
    """What of a place's key follows from its document; without it four bytes are left."""
    return np.zeros(len(doc), np.uint64) if rule.elsewhere else tc.mix(doc.view(np.uint64))


def size_of(blob: bytes) -> int:
    return int.from_bytes(blob[:8], "little")


def thaw(blob: bytes, rule: Rule, symbols) -> Suffixes:
    n = size_of(blob)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), np.uint8)
    n_body, n_places = (int(v) for v in raw[:16].copy().view(np.int64))
    at = 16 + n_body

    def next_(count, kind, size):
        nonlocal at
        at += count * size
        return from_planes(raw[at - count * size : at], count, kind, size)

    lo, hi, doc, many, counts = next_(n, np.uint8, 1), next_(n, np.uint8, 1), next_(n, np.int64, 8), next_(n, np.uint8, 1), next_(n, np.uint32, 4)
    place_row = np.repeat(np.arange(n), counts)
    place_at, place_key = next_(n_places, np.int64, 5), next_(n_places, np.uint64, 8) + _doc_keys(doc[place_row], rule)
    table = symbols.get(raw[16 : 16 + n_body], lo.astype(np.int64), hi.astype(np.int64), rule)
    return Suffixes(table, lo, hi, doc, many, np.zeros((n, rule.before + 1), bool), np.zeros(n, np.int64), place_row, place_at, place_key)


def flushed(found: list, rule: Rule, symbols):
    """Sorted suffix rows of units, by bucket, and the spans that equal rows show.

    found: (table, text, lo, hi, k-gram, doc, at, key, first byte, past byte) of slices, which is emptied."""
    tables, texts, *columns = zip(*found, strict=True)
    found.clear()
    lo, hi, code, doc, at, key, begin, end = (np.concatenate(c) for c in columns)
    n = len(code)
    x = Suffixes(np.concatenate(tables), lo, hi, doc, np.zeros(n, np.uint8), np.zeros((n, 1), bool), np.arange(n), np.arange(n), at, key)
    del tables
    base = np.repeat(np.cumsum([0, *map(len, texts)])[:-1], [len(c) for c in columns[0]])
    source = b"".join(texts), begin + base, end + base
    bucket = ((code >> np.uint64(20)) % np.uint64(rule.buckets)).astype(np.int64)
    order = suffix_order(x.table)
    order = order[np.argsort(bucket[order].astype(np.uint16 if rule.buckets < 65536 else np.int64), kind="stable")]
    x, spans, heads = merged(x.take(order), rule)  # equal rows have one k-gram, so that they are in one bucket
    cuts = np.searchsorted(bucket[order][heads], np.arange(rule.buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield ENTRY, b, freeze(x.take(np.arange(cuts[b], cuts[b + 1])), rule, symbols, *source)
    yield from spans_out(spans, rule)


def scanner(symbols, rule: Rule):
    """Of (doc, salt, text) batches, suffix rows of all units."""

    @tc.trimmed
    def scan(batches):
        found, size = [], 0
        for batch in batches:
            doc = ids(batch, "doc")
            keys = row_keys(doc, salts(batch))
            for lo, _, buf, offs in tc.batches(batch, "text", _SLICE):
                letters, starts, ends, soffs = symbols.slices(buf, offs)
                d, s, e, a, code, _ = all_units(symbols, letters, soffs, rule)
                text = buf.tobytes()
                for some in _portions(len(d), rule, symbols):
                    i = slice(*some)
                    found.append(_rows(letters, text, starts, ends, s[i], e[i], a[i], rule, code[i], _order(doc[lo + d[i]], rule), s[i] - soffs[d[i]], keys[lo + d[i]]))
                    size += found[-1][0].nbytes + len(text)
                    if size > FLUSH and some[1] < len(d):
                        yield from to_batches(flushed(found, rule, symbols))
                        size = 0
                if size > FLUSH:
                    yield from to_batches(flushed(found, rule, symbols))
                    size = 0
        if found:
            yield from to_batches(flushed(found, rule, symbols))

    return scan


def _portions(n: int, rule: Rule, symbols):
    """Ranges of n units whose rows may be made at once."""
    step = max(1, FLUSH // ((rule.width + rule.before) * np.dtype(symbols.dtype).itemsize))
    return [(i, min(n, i + step)) for i in range(0, n, step)]


def _rows(letters, text: bytes, starts, ends, s, e, a, rule: Rule, code, doc, at, keys):
    """What flushed() takes, of units of one slice."""
    begin, past = (s, e + rule.width) if starts is None else (starts[s], ends[e + rule.width - 1])
    return suffix_table(letters, s, e, a, rule), text, (a - e).astype(np.uint8), (a - s).astype(np.uint8), code, doc, at, keys, begin, past


def _order(doc: np.ndarray, rule: Rule) -> np.ndarray:
    """Documents count only if the rule asks which is smaller."""
    return np.zeros(len(doc), np.int64) if rule.elsewhere else doc


# The first round


def settled_units(x: list[np.ndarray], rule: Rule):
    """(units that stay open, the spans of further copies). Of equal units two stay open, so that the next round compares
    them symbol by symbol (all of the smallest document and one of another, where documents count); the third and later
    ones share what those two have."""
    a, g, doc, salt, at, more, back = x
    order = np.lexsort((doc, g))
    x = [c[order] for c in x]
    a, g, doc, salt, at, more, back = x
    # Equal is what agrees in both fingerprints and in both lengths: 104 bits and more. Units of one g that differ in
    # the rest may stand between equal ones; those then stay open as well.
    new = first_of_runs(g, a, more, back)
    heads, run = np.flatnonzero(new), np.cumsum(new) - 1
    if rule.elsewhere:
        keep = np.arange(len(g)) - heads[run] < 2
    else:
        later = doc > doc[heads][run]
        keep = ~later
        keep[1:] |= ~later[:-1]
    gone = ~keep
    spans = row_keys(doc[gone], salt[gone].view(np.int64)), at[gone], more[gone].astype(np.int64) + rule.width
    return [c[keep] for c in x], spans


def with_company(x: list[np.ndarray], rule: Rule) -> np.ndarray:
    """Which of these open units have a k-gram that other units, or documents, have as well."""
    a, doc = x[0], x[2]
    order = np.lexsort((doc, a)) if not rule.elsewhere else np.argsort(a, kind="stable")
    heads = np.flatnonzero(first_of_runs(a[order]))
    sizes = np.diff(np.append(heads, len(a)))
    if rule.elsewhere:
        company = sizes > 1
    else:
        company = doc[order][heads] != doc[order][heads + sizes - 1]
    out = np.zeros(len(a), bool)
    out[order] = np.repeat(company, sizes)
    return out


def unit_scanner(symbols, rule: Rule):
    """Of (doc, salt, text) batches, the fingerprints of all units."""

    def flush(found):
        units_, spans = settled_units([np.concatenate(c) for c in zip(*found, strict=True)], rule)
        found.clear()
        order = np.argsort(units_[0], kind="stable")
        units_ = [c[order] for c in units_]
        yield from rows_by(ENTRY, (units_[0] % np.uint64(rule.buckets)).astype(np.int64), units_, _UNIT_COLUMNS)
        yield from spans_out(spans, rule)

    @tc.trimmed
    def scan(batches):
        found, size = [], 0
        for batch in batches:
            doc, salt = ids(batch, "doc"), salts(batch).view(np.uint64) & np.uint64(0xFFFFFFFF)
            for lo, _, buf, offs in tc.batches(batch, "text", _SLICE):
                letters, _, _, soffs = symbols.slices(buf, offs)
                d, s, e, a, code, g = all_units(symbols, letters, soffs, rule)
                small = lambda c: c.astype(np.uint8)
                found.append((code >> np.uint64(24), g, doc[lo + d], salt[lo + d], s - soffs[d], small(e - s), small(a - s)))
                size += len(d)
                if size > UNITS:
                    yield from to_batches(flush(found))
                    size = 0
        if found:
            yield from to_batches(flush(found))

    return scan


def unit_reducer(rule: Rule):
    """Of the fingerprints of some buckets, the spans and the units that have company (ASK, by part)."""

    def settled(blobs, chosen):
        held, size, spans = [], 0, [no_spans()]
        for i, b in enumerate(blobs):
            x = unpack(b, _UNIT_COLUMNS)
            held.append(x if chosen is None else [c[chosen(x)] for c in x])
            size += len(held[-1][0])
            if size > UNITS or i == len(blobs) - 1:
                rest, some = settled_units([np.concatenate(c) for c in zip(*held, strict=True)], rule)
                held, size = [rest], 0
                spans.append(some)
        return held[0], tuple(np.concatenate(c) for c in zip(*spans, strict=True))

    def out(rest, spans):
        yield from spans_out(spans, rule)
        keys = row_keys(rest[2], rest[3].view(np.int64))
        order = np.argsort(keys, kind="stable")
        columns = [c[order] for c in (keys, rest[4], rest[5].astype(np.int64), rest[6].astype(np.int64))]
        yield from rows_by(ASK, (columns[0] % np.uint64(rule.parts)).astype(np.int64), columns, _ASK_COLUMNS)

    @tc.trimmed
    def reduce(batches):
        held = {}
        for batch in batches:
            kinds = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
            if (kinds == SPAN).any():
                yield batch.filter(pa.array(kinds == SPAN))
            for i in np.flatnonzero(kinds == ENTRY).tolist():
                held.setdefault(batch.column(1)[i].as_py(), []).append(batch.column(2)[i].as_py())
        while held:
            _, blobs = held.popitem()
            if sum(len(b) for b in blobs) <= 8 * BUCKET:
                rest, spans = settled(blobs, None)
                asked = with_company(rest, rule)
                yield from to_batches(out([c[asked] for c in rest], spans))
            else:  # in passes, each with some of the units; all that stay open count as if they had company
                passes = np.uint64(-(-sum(len(b) for b in blobs) // (8 * BUCKET)))
                for p in range(int(passes)):
                    yield from to_batches(out(*settled(blobs, lambda x, p=p: x[1] % passes == p)))

    return reduce


def asker(symbols, rule: Rule):
    """Suffix rows of the units of a part that have company."""

    def ask(key, docs: pa.Table, asks: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows and asks.num_rows:
            key, at, more, back = (np.concatenate(c) for c in zip(*(unpack(b.as_py(), _ASK_COLUMNS) for b in asks.column("blob")), strict=True))
            doc, keys = ids(docs, "doc"), docs.column("key").to_numpy().view(np.uint64)
            buf, offs = tc.buffer_of(pa.array(unzipped(docs.column("z")), pa.large_binary()))
            letters, starts, ends, soffs = symbols.slices(buf, offs)
            row, s, both = places_of(keys, soffs, [key, at, more * 256 + back])
            e, a, text = s + both // 256, s + both % 256, buf.tobytes()
            for i in (slice(*some) for some in _portions(len(s), rule, symbols)):
                # The k-gram's fingerprint, as units() has it.
                code = np.zeros(len(s[i]), np.uint64)
                for j in range(rule.k):
                    code = code * np.uint64(tc.BASE) + symbols.letters(letters[a[i] + j])
                found = [_rows(letters, text, starts, ends, s[i], e[i], a[i], rule, tc.mix(code), _order(doc[row[i]], rule), s[i] - soffs[row[i]], keys[row[i]])]
                out += to_batches(flushed(found, rule, symbols))
        return pa.Table.from_batches(out, schema=_ARROW)

    return ask


# Groups


def prefix_groups(blobs: list[bytes], rule: Rule, symbols, limit: int, path: tuple[int, ...] = ()):
    """(rows of one group by blob, True if the group is as small as the limit asks) of a bucket.

    What is loaded is counted first: from the blobs' headers, and below that, blob by blob, by the next
    symbol of the suffix. A prefix grows until its group is small enough or has k symbols."""

    def chosen(blob, path):
        x = thaw(blob, rule, symbols)
        rows = np.arange(len(x))
        for depth, digit in enumerate(path):
            rows = rows[_digit(x.table[rows, depth]) == digit]
        return x if len(rows) == len(x) else x.take(rows)

    if not path and sum(map(size_of, blobs)) <= limit:
        yield [thaw(b, rule, symbols) for b in blobs], True
        return
    counts = np.zeros(16, np.int64)
    for b in blobs:
        counts += np.bincount(_digit(chosen(b, path).table[:, len(path)]), minlength=16)
    for digit in np.flatnonzero(counts).tolist():
        longer = (*path, digit)
        if counts[digit] > limit and len(longer) < rule.k:
            yield from prefix_groups(blobs, rule, symbols, limit, longer)
        elif counts[digit] <= limit:
            yield [chosen(b, longer) for b in blobs], True
        else:  # blob by blob
            for i, b in enumerate(blobs):
                rows = chosen(b, longer)
                yield [rows if i == j else rows.take(np.zeros(0, np.int64)) for j in range(len(blobs))], False


def _digit(letters: np.ndarray) -> np.ndarray:
    return (letters & letters.dtype.type(15)).astype(np.uint8)


def window_codes(x: Suffixes, o: int, rows: np.ndarray, rule: Rule, symbols) -> np.ndarray:
    """Fingerprints of the windows that begin o symbols before the anchor."""
    code = np.full(len(rows), o, np.uint64)
    for j in [*range(rule.width + o - 1, rule.width - 1, -1), *range(rule.width - o)]:
        code = tc.mix(code * np.uint64(0x9FB21C651E98DF25) + symbols.letters(x.table[rows, j]))
    return code


def windows_out(x: Suffixes, rule: Rule, symbols):
    """The windows of a group that is too large for a task, dealt by their own fingerprints: one row for
    each window, and for each of its places (a row without places, or one that stands for many, has one)."""
    for o in range(rule.before + 1):
        fits = np.flatnonzero((x.lo <= o) & (x.hi >= o))
        if not len(fits):
            continue
        code = np.zeros(len(x), np.uint64)
        code[fits] = window_codes(x, o, fits, rule, symbols)
        ok = np.zeros(len(x), bool)
        ok[fits] = True
        place = np.flatnonzero(ok[x.place_row])
        row = x.place_row[place]
        bare = np.flatnonzero(ok & ((x.many > 0) | (np.bincount(x.place_row, minlength=len(x)) == 0)))
        zero = np.zeros(len(bare), np.int64)
        columns = [np.concatenate(c) for c in ((code[row], code[bare]), (x.doc[row], x.doc[bare]), (x.place_key[place], zero.view(np.uint64)), (x.place_at[place] + x.hi[row].astype(np.int64) - o, zero), (x.many[row], np.full(len(bare), 2, np.uint8)))]
        yield from rows_by(WINDOW, (columns[0] % np.uint64(rule.buckets)).astype(np.int64), columns, _WINDOW_COLUMNS)


def window_reducer(rule: Rule):
    """Spans of the windows that were dealt out one by one."""

    @tc.trimmed
    def reduce(batches):
        held = {}
        for batch in batches:
            for key, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                held.setdefault(key, []).append(blob.as_py())
        while held:
            _, bucket = held.popitem()
            code, doc, key, at, many = (np.concatenate(c) for c in zip(*(unpack(b, _WINDOW_COLUMNS) for b in bucket), strict=True))
            order = np.lexsort((at, key, doc, code))
            code, doc, key, at, many = (c[order] for c in (code, doc, key, at, many))
            heads = np.flatnonzero(first_of_runs(code))
            sizes = np.diff(np.append(heads, len(code)))
            if rule.elsewhere:
                hit = np.repeat((np.maximum.reduceat(many, heads) > 0) | (sizes > 1), sizes)
            else:
                hit = doc > np.repeat(np.minimum.reduceat(doc, heads), sizes)
            hit &= many < 2
            yield from to_batches(spans_out((key[hit], at[hit], np.full(int(hit.sum()), rule.width)), rule))

    return reduce


def reducer(rule: Rule, symbols, solve: Callable, keep: bool):
    """Of the rows of some buckets, the spans. solve(batches of rows, kept batches, rule) has the method's own
    structure and returns (rows, spans). ENTRY and LEVEL rows are searched and, if `keep`, come back as LEVEL;
    KEPT rows are only searched."""

    @tc.trimmed
    def reduce(batches):
        held = {}
        for batch in batches:
            kinds = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
            if (kinds == SPAN).any():
                yield batch.filter(pa.array(kinds == SPAN))
            for i in np.flatnonzero(kinds != SPAN).tolist():
                held.setdefault(batch.column(1)[i].as_py(), ([], []))[int(kinds[i] == KEPT)].append(batch.column(2)[i].as_py())
        while held:  # bucket by bucket: equal k-grams are in one bucket
            bucket, (mine, kept) = held.popitem()
            yield from to_batches(solved(bucket, mine, kept))

    def solved(bucket, mine, kept):
        limit = max(1, GROUP // ((rule.width + rule.before) * np.dtype(symbols.dtype).itemsize))
        for parts, small in prefix_groups([*mine, *kept], rule, symbols, limit):
            rows, others = ([p for p in some if len(p)] for some in (parts[: len(mine)], parts[len(mine) :]))
            if small:
                rows, spans = solve(rows, others, rule)
                yield from spans_out(spans, rule)
            else:
                for p in (*rows, *others):
                    yield from windows_out(p, rule, symbols)
            if keep:
                yield from ((LEVEL, bucket, freeze(x.without_places(), rule, symbols)) for x in rows)

    return reduce


# Texts


def read_spans(table: pa.Table) -> list[np.ndarray]:
    found = [unpack(b.as_py(), _SPAN_COLUMNS) for b in table.column("blob")]
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]


def places_of(keys: np.ndarray, offs: np.ndarray, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first symbol, size) of the spans that fall into these rows; rows with one key are equal and share its spans."""
    key, at, size = found
    order = np.argsort(keys, kind="stable")
    lo, hi = (np.searchsorted(keys[order], key, side) for side in ("left", "right"))
    times = hi - lo
    pick = np.repeat(np.arange(len(key)), times)
    row = order[np.repeat(lo - np.cumsum(times) + times, times) + np.arange(len(pick))]
    return row, offs[row] + at[pick], size[pick]


def zipped(parts: int):
    """(text, doc, salt, others) -> (z, doc, part, key, others): texts go through a shuffle compressed."""

    def run(batches):
        c = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [c.compress((x.as_py() or "").encode()) for x in batch.column(0)]
            key = row_keys(ids(batch, "doc"), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
            columns = [pa.array(texts, pa.binary()), batch.column(1), pa.array((key % np.uint64(parts)).astype(np.int64)), pa.array(key.view(np.int64)), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(columns, names=["z", "doc", "part", "key", *batch.schema.names[3:]])

    return run


def repeated(docs: DataFrame, id_col: str, text_col: str, symbols, rule_of: Callable, solve: Callable, finish: Callable, schema: str, name: str, carry: tuple[str, ...] = (), levels: DataFrame | None = None, buckets: int | None = None, two_rounds: bool = False) -> tuple[DataFrame, DataFrame]:
    """(finish(ids, keys, texts, spans) and the columns `carry` of every row, the written rows of the search).

    spans: the windows that repeat. levels: LEVEL and KEPT rows of earlier searches with as many buckets.
    two_rounds: rows only for the units that have company (see above); not with levels."""
    spark = docs.sparkSession
    text = F.col(text_col).alias("text")
    # Most tables have one row for each id; where ids repeat, texts tell the rows apart.
    again = docs.groupBy(F.col(id_col).cast("long").alias("doc")).count().filter("count > 1").limit(1).count()
    salt = (F.xxhash64(text_col) if again else F.lit(0).cast("long")).alias("salt")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), salt, text)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    deal = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE))
    rule = rule_of(max(1, -(-size // PART)), buckets or 4 * deal)
    extra = [F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)]
    wide = docs.select(text, F.col(id_col).cast("long").alias("doc"), salt, *extra)
    fields = [StructField("z", BinaryType()), StructField("doc", LongType()), StructField("part", LongType()), StructField("key", LongType()), *wide.schema.fields[3:]]
    texts = wide.mapInArrow(zipped(rule.parts), StructType(fields))
    if two_rounds:
        hints = rows.mapInArrow(unit_scanner(symbols, rule), ROW).repartition(deal, "key").mapInArrow(unit_reducer(rule), ROW)
        hints = materialise(hints, f"{name}-units")
        found = texts.groupBy("part").cogroup(hints.filter(F.col("kind") == ASK).groupBy("key")).applyInArrow(asker(symbols, rule), ROW)
    else:
        found = rows.mapInArrow(scanner(symbols, rule), ROW)
    if levels is not None:
        found = found.unionByName(levels)
    found = found.repartition(deal, "key").mapInArrow(reducer(rule, symbols, solve, levels is not None), ROW)
    found = materialise(found, name)
    windows = found.filter(F.col("kind") == WINDOW).repartition(deal, "key").mapInArrow(window_reducer(rule), ROW)
    spans = found.filter(F.col("kind") == SPAN).unionByName(windows)
    if two_rounds:
        spans = spans.unionByName(hints.filter(F.col("kind") == SPAN))

    def last(key, docs: pa.Table, spans: pa.Table) -> pa.Table:
        keys = docs.column("key").to_numpy().view(np.uint64)
        out = finish(docs.column("doc"), keys, unzipped(docs.column("z")), read_spans(spans))
        for i, c in enumerate(carry):
            out = out.append_column(c, docs.column(f"__c{i}"))
        return out

    schema = StructType([*StructType.fromDDL(schema).fields, *(StructField(c, docs.schema[c].dataType) for c in carry)])
    if len(set(schema.names)) < len(schema.names):
        raise ValueError("a carried column has the name of a result")
    return texts.groupBy("part").cogroup(spans.groupBy("key")).applyInArrow(last, schema), found

