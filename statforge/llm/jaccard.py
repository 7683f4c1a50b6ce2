"""N-gram Jaccard join over groups of similar documents.

A document is its set of distinct n-word shingles (fingerprints). Documents are first partitioned so
that no link is lost: two sets of sizes a and b whose Jaccard similarity is t or more differ in at
most d = (a + b)(1 - t)/(1 + t) shingles, so of d + 1 + x parts of the shingle space they agree in
x + 1 at least. The fingerprint of each part of each set is its signature. Of sets that share one, the
parity bitmaps tell which may link at all: two sets differ in at least as many shingles as their
bitmaps differ in bits. Those that may are in the same family, and so are all that share a signature
which too many have for that. A family holds a token-group matrix: its documents in groups, each with its token
union. A document is compared with a group's members only if its overlap with the union reaches what
a link needs, and only with members it isn't connected with yet.

Large families are cut into blocks. Their first document is in each block, which connects what is
close to it. The blocks are then the groups of a matrix of their own: a set of n shingles that links
with another shares percent * n / 100 with it at least, so it shares one of any n - percent * n / 100 + 1
of its own. These are taken to be those that fewest documents of the family have; each block's union of
them is stored, and a document left outside opens only blocks whose union has one of its own and that
hold a fitting document it isn't connected with.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as rp
from . import textcodes as tc
from .components import connected_components
from .scratch import materialise

SIGNATURE, EDGE, DOC, GROUPED = 0, 1, 2, 3
_SLICE = 1 << 20
#: Documents and shingles of a block, at most unless one document has more, and documents of a group in it.
BLOCK, SHINGLES, GROUP = 1024, 1 << 20, 16
#: Documents with one signature that are compared by bitmaps, of a task and of all; where there are
#: more, all of them are taken to be of one family, which its resolution puts right.
LOCAL, MOST = 64, 512
#: Places on which a family's shingles are counted, to tell rare ones from common ones.
PLACES = 1 << 14
#: Bytes of text for each partition, where the session has fewer partitions than that takes.
SHARE = 64 << 20
_SIGN_COLUMNS = (("sign", np.uint64, 8), ("doc", np.int64, 8), ("full", np.uint8, 1))
_EDGE_COLUMNS = (("a", np.int64, 8), ("b", np.int64, 8))
_DOC_COLUMNS = (("doc", np.int64, 8), ("n", np.int64, 4), ("one", np.uint64, 8), ("two", np.uint64, 8))


@dataclass(frozen=True)
class Jaccard:
    """Links: inter * 100 >= percent * union, over shingles of `words` words."""

    words: int
    percent: int
    lower: bool = True


def shingles(buf: np.ndarray, offs: np.ndarray, rule: Jaccard) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document in order, and offsets. With fewer words, the whole sequence is one."""
    starts, ends, woffs = tc.words(tc.LOWER[buf] if rule.lower else buf, offs)
    codes = tc.span_codes(tc.LOWER[buf] if rule.lower else buf, starts, ends)
    n_words = np.diff(woffs)
    g = tc.grams(codes, rule.words)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    at = np.flatnonzero(doc[: len(g)] == doc[rule.words - 1 :]) if len(g) else np.zeros(0, np.int64)
    code, owner = g[at], doc[at]
    for m in range(1, rule.words):  # short texts, by their length
        few = np.flatnonzero(n_words == m)
        if len(few):
            whole = tc.mix(tc.grams(codes, m)[woffs[few]] + np.uint64(m))
            code, owner = np.concatenate((code, whole)), np.concatenate((owner, few))
    order = np.argsort(code)
    order = order[np.argsort(owner[order].astype(np.uint16 if len(n_words) < 65536 else np.int64), kind="stable")]
    code, owner = code[order], owner[order]
    new = rp.first_of_runs(code, owner)
    code, owner = code[new], owner[new]
    return code, np.searchsorted(owner, np.arange(len(n_words) + 1))


@lru_cache(maxsize=100_000)
def level_of(n: int, percent: int) -> int:
    """The size class: neighbours' smallest sizes differ by the factor 100 / percent."""
    c = int(math.log(n) / math.log(100 / percent))
    while first_size(c + 1, percent) <= n:
        c += 1
    while first_size(c, percent) > n:
        c -= 1
    return c


@lru_cache(maxsize=100_000)
def first_size(c: int, percent: int) -> int:
    """Smallest size of class c. Chosen so that linked sets are in the same class or in neighbours."""
    return 1 if c <= 0 else max(first_size(c - 1, percent) + 1, -(-first_size(c - 1, percent) * 100 // percent))


@lru_cache(maxsize=100_000)
def parts_of(c: int, percent: int) -> tuple[int, int]:
    """(parts, x) for links between classes c and c + 1: parts - x - 1 differences are allowed for."""
    most = first_size(c + 2, percent) - 1
    d = (2 * most * (100 - percent)) // (100 + percent)
    x = 0
    for _ in range(20):
        empty = (d + 1 + x) * math.exp(-first_size(c, percent) / (d + 1 + x))
        x = math.ceil(empty + 4 * math.sqrt(empty)) if empty > 0.001 else 0
        x = min(x, d + 1)
    return d + 1 + x, x


def signatures(code: np.ndarray, offs: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, signature) pairs.

    A part in which a set has nothing gives no signature as long as the set has x such parts at most;
    beyond that each gives one, so that sets which agree only in empty parts still meet."""
    sizes = np.diff(offs)
    out_doc, out_sign = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for step in (0, -1):
        level = np.array([level_of(int(n), percent) + step if n else -1 for n in sizes], np.int64)
        shape = [parts_of(int(c), percent) if c >= 0 else (0, 0) for c in level]
        parts, spare = np.array([p for p, _ in shape], np.int64), np.array([x for _, x in shape], np.int64)
        parts[parts <= 1] = 0  # only equal sets link there, and those are one class already
        base = np.concatenate(([0], np.cumsum(parts)))
        use = np.repeat(parts > 0, sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)[use]
        picked = tc.mix(code[use] + np.uint64(0x51ED270B))
        place = base[owner] + ((picked >> np.uint64(16)) % parts[owner].astype(np.uint64)).astype(np.int64)
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, place, picked)
        held = np.zeros(base[-1], bool)
        held[place] = True
        doc = np.repeat(np.arange(len(sizes)), parts)
        index = np.arange(base[-1]) - base[doc]
        total = tc.mix(total + tc.mix((level[doc] * 1_000_003 + index).astype(np.uint64)))
        empties = np.bincount(doc[~held], minlength=len(sizes))
        send = held | (empties > spare)[doc]
        out_doc.append(doc[send])
        out_sign.append(total[send])
    return np.concatenate(out_doc), np.concatenate(out_sign)


def bits_of(n: int, percent: int) -> int:
    """Bits of a set's parity bitmap: a power of two, enough to tell apart sets that share half."""
    return 1 << max(6, min(15, (4 * n * (100 - percent) // 100).bit_length()))


def bitmaps(code: np.ndarray, offs: np.ndarray, percent: int) -> list[bytes]:
    """Of each set, a bitmap of which bit i is the parity of the shingles that fall on it."""
    size = np.array([bits_of(int(n), percent) for n in np.diff(offs)], np.int64)
    base = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(len(size)), np.diff(offs))
    place = base[owner] + (tc.mix(code + np.uint64(0xB17)) & (size[owner] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=int(base[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[lo // 8 : hi // 8] for lo, hi in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def may_link(n: int, one: int, m: int, two: int, percent: int) -> bool:
    """False only if sets of these sizes and bitmaps can't link."""
    if n * 100 < percent * m or m * 100 < percent * n:
        return False
    a, b = bits_of(n, percent), bits_of(m, percent)
    while a > b:
        a //= 2
        one = (one >> a) ^ (one & ((1 << a) - 1))
    while b > a:
        b //= 2
        two = (two >> b) ^ (two & ((1 << b) - 1))
    return (one ^ two).bit_count() * (100 + percent) <= (n + m) * (100 - percent)


def thinned(sign: np.ndarray, doc: np.ndarray, full: np.ndarray, most: int):
    """(signatures, documents, full, edges) in order: where more than `most` documents have one signature,
    or it was full before, all are tied to the first of them by an edge, and only that one stays, as full."""
    order = np.lexsort((doc, sign))
    sign, doc, full = sign[order], doc[order], full[order]
    heads = np.flatnonzero(rp.first_of_runs(sign))
    full = np.repeat(np.maximum.reduceat(full, heads), np.diff(np.append(heads, len(sign)))) if len(heads) else full
    keep = rp.first_of_runs(sign, doc)
    sign, doc, full = sign[keep], doc[keep], full[keep]
    heads = np.flatnonzero(rp.first_of_runs(sign))
    sizes = np.diff(np.append(heads, len(sign)))
    full = np.maximum(full, np.repeat(sizes > most, sizes).astype(np.uint8))
    least = np.repeat(doc[heads], sizes)
    over = (full > 0) & (doc != least)
    pairs = np.unique(np.stack((doc[over], least[over]), 1), axis=0) if over.any() else np.zeros((0, 2), np.int64)
    return sign[~over], doc[~over], full[~over], (pairs[:, 0], pairs[:, 1])


def _fold(doc: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """A fingerprint of each group's documents."""
    return tc.mix(np.add.reduceat(tc.mix(doc.view(np.uint64)), heads))


def _scan(rule: Jaccard, buckets: int):
    def flush(docs, signs, owners):
        sign, doc = np.concatenate(signs), np.concatenate(owners)
        kept, doc, full, edges = thinned(sign, doc, np.zeros(len(sign), np.uint8), LOCAL)
        yield from rp.rows_by(SIGNATURE, ((kept >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64), [kept, doc, full], _SIGN_COLUMNS)
        yield from rp.rows_by(EDGE, edges[0] % buckets, edges, _EDGE_COLUMNS)
        for columns, maps in docs:
            packed = rp.pack(columns, _DOC_COLUMNS)
            yield DOC, int(columns[0][0] % buckets), len(packed).to_bytes(4, "little") + packed + zstandard.ZstdCompressor(level=1).compress(b"".join(maps))

    @tc.trimmed
    def scan(batches):
        docs, signs, owners, size, seen = [], [], [], 0, {}
        for batch in batches:
            ids = rp.ids(batch, "doc")
            for lo, hi, buf, offs in tc.batches(batch, "text", _SLICE):
                code, soffs = shingles(buf, offs, rule)
                n = np.diff(soffs)
                one, two = (_sums(c, soffs) for c in (code, tc.mix(code + np.uint64(77))))
                docs.append(([ids[lo:hi], n, one, two], bitmaps(code, soffs, rule.percent)))
                # Equal sets have equal signatures: in a task only the first of them sends its own.
                first = np.array([seen.setdefault(k, d) == d for k, d in zip(zip(one.tolist(), two.tolist(), strict=True), ids[lo:hi].tolist(), strict=True)], bool)
                keep = np.repeat(first, n)
                d, s = signatures(code[keep], np.concatenate(([0], np.cumsum(n[first]))), rule.percent)
                signs.append(s)
                owners.append(ids[lo:hi][first][d])
                size += len(s)
                if size > 1_000_000:
                    yield from rp.to_batches(flush(docs, signs, owners))
                    docs, signs, owners, size, seen = [], [], [], 0, {}
        if docs:
            yield from rp.to_batches(flush(docs, signs, owners))

    return scan


def _sums(code: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(tc.mix(code), out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


_FOUND = ("a", "b", "n", "one", "two")
_FOUND_SCHEMA = "kind int, a long, b long, n long, one long, two long, map binary"


def _link_signatures(percent: int):
    """Signature rows of some buckets -> groups of documents with one signature (a: group, b: document) and
    edges; the rows of documents (a) go through, unpacked."""

    def rows(kind, maps=None, **columns):
        n = len(next(iter(columns.values())))
        every = [pa.array(np.full(n, kind, np.int32))] + [pa.array(np.ascontiguousarray(columns[c]).view(np.int64)) if c in columns else pa.nulls(n, pa.int64()) for c in _FOUND]
        return pa.RecordBatch.from_arrays([*every, pa.array(maps, pa.binary()) if maps else pa.nulls(n, pa.binary())], names=["kind", *_FOUND, "map"])

    @tc.trimmed
    def link(batches):
        blobs, known = {}, np.zeros(0, np.uint64)
        for batch in batches:
            for kind, key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if kind == SIGNATURE:
                    blobs.setdefault(key, []).append(blob.as_py())
                elif kind == EDGE:
                    a, b = rp.unpack(blob.as_py(), _EDGE_COLUMNS)
                    yield rows(EDGE, a=a, b=b)
                else:
                    raw = blob.as_py()
                    cut = 4 + int.from_bytes(raw[:4], "little")
                    doc, n, one, two = rp.unpack(raw[4:cut], _DOC_COLUMNS)
                    ends = np.concatenate(([0], np.cumsum([bits_of(int(x), percent) // 8 for x in n]))).tolist()
                    maps = zstandard.ZstdDecompressor().decompress(raw[cut:])
                    yield rows(DOC, [maps[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)], a=doc, n=n, one=one, two=two)
        while blobs:  # bucket by bucket: equal signatures are in one bucket
            _, bucket = blobs.popitem()
            sign, doc, full = (np.concatenate(x) for x in zip(*(rp.unpack(b, _SIGN_COLUMNS) for b in bucket), strict=True))
            sign, doc, _, (a, b) = thinned(sign, doc, full, MOST)
            yield rows(EDGE, a=a, b=b)
            heads = np.flatnonzero(rp.first_of_runs(sign))
            sizes = np.diff(np.append(heads, len(sign)))
            group = _fold(doc, heads)
            once = np.zeros(len(heads), bool)
            once[np.unique(group, return_index=True)[1]] = True  # equal groups from many signatures count once
            once &= (sizes > 1) & ~np.isin(group, known)
            known = np.concatenate((known, group[once]))
            keep = np.repeat(once, sizes)
            yield rows(GROUPED, a=np.repeat(group, sizes)[keep], b=doc[keep])

    return link


def _bounded(percent: int):
    """(group, doc, n, map), sorted by group -> edges (a, b) among the documents that may link."""

    def settle(members):
        forest = Forest(len(members))
        for i, (_, n, one) in enumerate(members):
            for j in range(i):
                if forest.root(i) != forest.root(j) and may_link(n, one, members[j][1], members[j][2], percent):
                    forest.join(i, j)
        for i, r in enumerate(forest.roots()):
            if i != r:
                yield members[i][0], members[r][0]

    def run(batches):
        group, members = None, []
        for batch in batches:
            found = []
            for g, d, n, m in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if g != group:
                    found += settle(members)
                    group, members = g, []
                members.append((d, n, int.from_bytes(m, "little")))
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})
        found = list(settle(members))
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


class Forest:
    """Union-find over 0..n-1; the smallest is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def roots(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def by_likeness(code: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """An order in which similar sets are near each other: by their smallest elements under two hashes. Sets of
    similarity s have equal ones with probability s, so that groups of neighbours have small unions."""
    full = np.flatnonzero(np.diff(offs))
    keys = []
    for salt in (0x1B56C4E9, 0x7F4A7C15):
        least = np.full(len(offs) - 1, np.uint64(0xFFFFFFFFFFFFFFFF))
        least[full] = np.minimum.reduceat(tc.mix(code + np.uint64(salt)), offs[full]) if len(full) else 0
        keys.append(least)
    return np.lexsort((keys[1], keys[0]))


def linked(code: np.ndarray, offs: np.ndarray, percent: int, forest: Forest) -> int:
    """Join every pair of sets that links, by a token-group matrix; the number of groups opened."""
    n = len(offs) - 1
    sizes = np.diff(offs)
    if n < 2:
        return 0
    tokens, dense = np.unique(code, return_inverse=True)
    group = np.arange(n) // GROUP
    n_groups = int(group[-1]) + 1
    owner = np.repeat(np.arange(n), sizes)
    # The matrix by token: which groups' unions hold it.
    cell = np.unique(dense.astype(np.int64) * n_groups + group[owner])
    by_token = np.searchsorted(cell // n_groups, np.arange(len(tokens) + 1))
    in_group = cell % n_groups
    flag = np.zeros(len(tokens), bool)
    opened = 0
    for q in range(n - 1):
        own = dense[offs[q] : offs[q + 1]]
        if not len(own):
            continue
        roots = forest.roots()
        other = np.flatnonzero(roots[q + 1 :] != roots[q]) + q + 1
        fit = other[(sizes[other] * 100 >= percent * sizes[q]) & (sizes[q] * 100 >= percent * sizes[other])]
        if not len(fit):
            continue
        spans = by_token[own + 1] - by_token[own]
        hits = in_group[np.repeat(by_token[own] - np.cumsum(spans) + spans, spans) + np.arange(int(spans.sum()))]
        bound = np.bincount(hits, minlength=n_groups)
        fit = fit[bound[group[fit]] * 100 >= percent * sizes[q]]
        if not len(fit):
            continue
        opened += len(np.unique(group[fit]))
        flag[own] = True
        lens = sizes[fit]
        inside = flag[dense[np.repeat(offs[fit] - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))]]
        both = np.add.reduceat(inside, np.cumsum(lens) - lens, dtype=np.int64)
        flag[own] = False
        for m in fit[both * 100 >= percent * (sizes[q] + lens - both)]:
            forest.join(q, int(m))
    return opened


def _resolver(rule: Jaccard):
    """(cell, family, doc, z) of one cell -> (doc, component) edges within families."""

    def resolve(key, table: pa.Table) -> pa.Table:
        family, doc = table.column("family").to_numpy(), table.column("doc").to_numpy()
        texts = rp.unzipped(table.column("z"))
        # Rows that share an id but not the text are sets of their own.
        first = dict.fromkeys(zip(family.tolist(), doc.tolist(), texts, strict=True))
        at = dict(zip(zip(family.tolist(), doc.tolist(), texts, strict=True), range(len(doc)), strict=True))
        some = np.array([at[x] for x in first], np.int64)
        order = some[np.lexsort((doc[some], family[some]))]
        family, doc = family[order], doc[order]
        a, b = [], []
        heads = np.flatnonzero(rp.first_of_runs(family))
        for lo, hi in zip(heads, [*heads[1:], len(doc)], strict=True):
            buf, offs = tc.buffer_of(pa.array([texts[i] for i in order[lo:hi]], pa.large_binary()))
            code, soffs = shingles(buf, offs, rule)
            alike = by_likeness(code, soffs)
            sizes = np.diff(soffs)[alike]
            take = np.repeat(soffs[alike] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
            forest = Forest(hi - lo)
            linked(code[take], np.concatenate(([0], np.cumsum(sizes))), rule.percent, forest)
            ids = doc[lo:hi][alike]
            a.append(ids)
            b.append(ids[forest.roots()])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)}) if a else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    return resolve


def _zipped(batches):
    c = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([c.compress((x.as_py() or "").encode()) for x in batch.column("text")], pa.binary())], names=["doc", "z"])


def _families(edges: DataFrame, reps: DataFrame) -> DataFrame:
    """(doc, family) of the representatives that share a signature with another."""
    to_rep = reps.select("doc", "rep")
    ends = edges.join(to_rep, edges.a == to_rep.doc).select(F.col("rep").alias("x"), "b")
    ends = ends.join(to_rep, ends.b == to_rep.doc).select(F.col("x").alias("a"), F.col("rep").alias("b"))
    return connected_components(ends).select(F.col("node").alias("doc"), F.col("component").alias("family"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """Classes of documents that are linked, directly or through others: doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= percent * union of their sets of `words`-word
    shingles. A text with fewer words is one shingle; a null text or one without words has none and
    links with nothing, so that it is its own component. component_id is the smallest doc_id reachable.
    Very long texts are taken whole.
    Rows with null ids come back with n_shingles and a null component_id and link with nothing. Rows
    that share an id are one node: each has the size of its own text. Empty table: no rows. Other
    columns are ignored. No pair is dropped, whatever the size of a group.
    """
    if not 50 < percent < 100:
        raise ValueError("percent must lie between 50 and 100")
    spark = docs.sparkSession
    rule = Jaccard(words, percent, lower)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    held = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    deal = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // SHARE))
    real = rows.filter("doc is not null")
    found = materialise(real.mapInArrow(_scan(rule, 4 * deal), rp.ROW).repartition(deal, "key").mapInArrow(_link_signatures(percent), _FOUND_SCHEMA), "signatures")
    sized = found.filter(F.col("kind") == DOC).select(F.col("a").alias("doc"), "n", "one", "two")
    # Equal sets in as many slices as there are partitions, so that no task has all copies of a text.
    sliced = sized.filter("n > 0").withColumn("slice", F.pmod(F.xxhash64("doc"), F.lit(deal)))
    slices = sliced.groupBy("n", "one", "two", "slice").agg(F.min("doc").alias("least"))
    classes = slices.groupBy("n", "one", "two").agg(F.min("least").alias("rep"))
    slices = slices.join(classes, ["n", "one", "two"]).select("n", "one", "two", "slice", "rep")
    reps = materialise(sliced.join(slices, ["n", "one", "two", "slice"]).select("doc", "rep", "n").distinct(), "classes")
    maps = found.filter(F.col("kind") == DOC).select(F.col("a").alias("doc"), "n", "map")
    grouped = found.filter(F.col("kind") == GROUPED).select(F.col("a").alias("group"), F.col("b").alias("doc")).distinct()
    grouped = grouped.join(maps, "doc").select("group", "doc", "n", "map").repartition(deal, "group").sortWithinPartitions("group")
    edges = grouped.mapInArrow(_bounded(percent), "a long, b long").unionByName(found.filter(F.col("kind") == EDGE).select("a", "b"))
    family = materialise(_families(edges.distinct(), reps), "families")
    weighed = family.join(reps.filter("doc = rep").select("doc", "n"), "doc")
    size = materialise(weighed.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / SHINGLES)).alias("blocks"), F.count("*").alias("members"), F.sum("n").alias("held")), "sizes")
    small = size.filter("blocks = 1").agg(F.greatest(F.ceil(F.sum("members") / BLOCK), F.ceil(F.sum("held") / SHINGLES)).alias("cells")).first()["cells"]
    small_cells = F.pmod(F.xxhash64("family"), F.lit(max(1, small or 1)).cast("long"))
    placed = family.join(size.select("family", "blocks"), "family")
    big, blocks = F.col("blocks") > 1, F.col("blocks")
    # The first document of a large family goes into each of its blocks.
    block = F.when(~big, F.array(F.lit(-1).cast("long"))).when(F.col("doc") == F.col("family"), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc"), blocks)))
    placed = placed.select("doc", "family", F.when(big, F.xxhash64("family")).otherwise(small_cells).alias("cell"), F.explode(block).alias("block"))
    placed = materialise(placed, "cells")
    texts = real.mapInArrow(_zipped, "doc long, z binary")
    wanted = placed.join(texts, "doc").select("cell", "block", "family", "doc", "z")
    links = materialise(wanted.groupBy("cell", "block").applyInArrow(lambda key, t: _resolver(rule)(key, t), "a long, b long").filter("a != b"), "links")
    large = placed.filter("block >= 0")
    if large.limit(1).count():
        links = links.unionByName(_across_blocks(large, links, texts, rule))
    # Components are of representatives; the other documents of a class take theirs. Rows that share an id but differ
    # are in several classes, which that id connects.
    several = reps.groupBy("doc").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).filter("most != b").select("doc", "b")
    twice = reps.join(several, "doc").select(F.col("rep").alias("a"), "b")
    joined = materialise(connected_components(links.unionByName(twice)), "components")
    home = reps.join(joined, reps.rep == joined.node, "left").groupBy("doc").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = sized.join(home, "doc", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))
    nameless = rows.filter("doc is null").mapInArrow(_only_sizes(rule), "doc long, n long").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nameless)


def _only_sizes(rule: Jaccard):
    def sizes(batches):
        for batch in batches:
            n = [np.diff(shingles(buf, offs, rule)[1]) for _, _, buf, offs in tc.batches(batch, "text", _SLICE)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64))], names=["doc", "n"])

    return sizes


def _sets(table: pa.Table, rule: Jaccard):
    """Documents of (doc, z) rows, their shingles and offsets."""
    buf, offs = tc.buffer_of(pa.array(rp.unzipped(table.column("z")), pa.large_binary()))
    return table.column("doc").to_numpy(), *shingles(buf, offs, rule)


def _place(code: np.ndarray) -> np.ndarray:
    return (tc.mix(code + np.uint64(0x2545F491)) & np.uint64(PLACES - 1)).astype(np.int64)


def _tally(rule: Jaccard):
    """(family, doc, z) of a block -> (family, place, n): how many shingles of its documents fall on a place."""

    def tally(key, table: pa.Table) -> pa.Table:
        n = np.bincount(_place(_sets(table, rule)[1]), minlength=PLACES)
        place = np.flatnonzero(n)
        return pa.table({"family": pa.array(np.full(len(place), key[0].as_py(), np.int64)), "place": pa.array(place.astype(np.int32)), "n": pa.array(n[place])})

    return tally


def prefixes(code: np.ndarray, offs: np.ndarray, weight: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, shingle): of each set the shingles of least weight, so many that sets which link share one of them.

    Equal weights go by the shingle, so that one order holds for all sets of a family."""
    sizes = np.diff(offs)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((code, weight[_place(code)], owner))
    most = sizes + (-percent * sizes) // 100 + 1
    keep = np.arange(len(code)) - offs[owner] < most[owner]
    return owner[keep], code[order][keep]


def _block_prefixes(rule: Jaccard):
    """(doc, z) of a block and its family's (place, n) -> (family, block, doc, n, token)."""

    def run(key, table: pa.Table, tally: pa.Table) -> pa.Table:
        weight = np.zeros(PLACES, np.int64)
        if tally.num_rows:
            seen = tally.column("tally").combine_chunks().flatten()
            weight[seen.field("place").to_numpy()] = seen.field("n").to_numpy()
        doc, code, offs = _sets(table, rule)
        owner, token = prefixes(code, offs, weight, rule.percent)
        same = lambda x: pa.array(np.full(len(owner), x.as_py(), np.int64))
        return pa.table({"family": same(key[0]), "block": same(key[1]), "doc": pa.array(doc[owner]), "n": pa.array(np.diff(offs)[owner]), "token": pa.array(token.view(np.int64))})

    return run


def _slots(of: DataFrame, *key: str) -> DataFrame:
    """Of the guests of each cell, in how many slots they go so that none holds more than a block may."""
    return of.groupBy(*key).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / SHINGLES)).alias("slots"), F.count("*").alias("guests"))


def _across_blocks(large: DataFrame, links: DataFrame, texts: DataFrame, rule: Jaccard) -> DataFrame:
    """Links between blocks of a large family, for documents that aren't connected with its first one.

    Such documents first meet, of those that share a rare shingle with many of them, the smallest, so that
    copies of one text are connected by work that grows with their number. Each then meets the blocks that
    may hold a partner (see above), in slots: no task holds more than two blocks. Pairs of which both are
    connected with one document need no look.
    """
    joined = connected_components(links)
    at = large.join(joined, large.doc == joined.node, "left").select("doc", "family", "block", F.coalesce("component", "doc").alias("component"))
    at = materialise(at.withColumn("loose", F.col("component") != F.col("family")), "loose")
    open_families = at.filter("loose").select("family").distinct()
    at = at.join(open_families, "family", "left_semi")
    held = at.join(texts, "doc").select("family", "block", "doc", "z")
    tally = held.groupBy("family", "block").applyInArrow(lambda key, t: _tally(rule)(key, t), "family long, place int, n long")
    tally = tally.groupBy("family", "place").agg(F.sum("n").alias("n")).groupBy("family").agg(F.collect_list(F.struct("place", "n")).alias("tally"))
    blocks = at.select(F.col("family").alias("family"), F.col("block").alias("block")).distinct()
    tally = blocks.join(materialise(tally, "tally"), "family").select(F.col("family").alias("family"), "block", "tally")
    tokens = held.groupBy("family", "block").cogroup(tally.groupBy("family", "block")).applyInArrow(
        lambda key, t, w: _block_prefixes(rule)(key, t, w), "family long, block long, doc long, n long, token long"
    )
    tokens = materialise(tokens, "prefixes")
    resolved = lambda cells, *key: cells.join(texts, "doc").select(*key, "doc", "z").groupBy(*key).applyInArrow(
        lambda key, t: _resolver(rule)(key, t), "a long, b long"
    ).filter("a != b")
    slot = F.pmod(F.xxhash64("doc", F.lit(1)), F.col("slots")).alias("slot")
    every_slot = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot")

    mine = tokens.join(at.filter("loose").select("doc", "component").distinct(), "doc")
    hubs = mine.groupBy("family", "token").agg(F.count("*").alias("has"), F.min("doc").alias("hub")).filter(f"has > {GROUP}")
    met = mine.join(hubs, ["family", "token"]).groupBy("family", "doc", "n").agg(F.max_by("hub", F.struct("has", -F.col("hub"))).alias("hub"))
    met = materialise(met.filter("hub != doc"), "hubs")
    sized = _slots(met, "family", "hub")
    cells = met.join(sized, ["family", "hub"]).select("family", "hub", slot, "doc")
    cells = cells.unionByName(sized.select("family", "hub", every_slot, F.col("hub").alias("doc")))
    near = materialise(resolved(cells, "family", "hub", "slot"), "near")
    if near.limit(1).count():
        # Components of components: what the blocks have connected is one node each.
        home = at.select("doc", "component").distinct()
        ends = near.join(home, near.a == home.doc).select(F.col("component").alias("x"), "b")
        ends = ends.join(home, ends.b == home.doc).select(F.col("x").alias("a"), F.col("component").alias("b"))
        merged = materialise(connected_components(ends), "merged")
        at = at.join(merged, at.component == merged.node, "left").select("doc", "family", "block", F.coalesce(merged.component, at.component).alias("component"), "loose")
        at = materialise(at.withColumn("loose", F.col("component") != F.col("family")), "loose")

    placed = tokens.join(at.select("doc", "block", "component", "loose"), ["doc", "block"])
    # The first document has met all others in their own blocks.
    unions = placed.filter("doc != family").groupBy("family", "token", F.col("block").alias("to")).agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    guests = placed.filter("loose").join(unions, ["family", "token"])
    guests = guests.filter("block != to and (low != component or high != component)").filter(f"most * 100 >= {rule.percent} * n and n * 100 >= {rule.percent} * least")
    guests = materialise(guests.select("doc", "family", "n", F.col("to").alias("block")).distinct(), "guests")
    sized = _slots(guests, "family", "block").select("family", "block", "slots")
    cells = guests.join(sized, ["family", "block"]).select("family", "block", slot, "doc")
    cells = cells.unionByName(at.join(sized, ["family", "block"]).select("family", "block", every_slot, "doc"))
    return resolved(cells, "family", "block", "slot").unionByName(near)
