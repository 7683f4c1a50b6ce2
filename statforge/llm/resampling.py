"""Importance resampling towards a target: documents are drawn by how much likelier their features are there.

Features (runs of words) are hashed to buckets. One pass over the texts writes each document's buckets and their
counts; totals of all documents and of the target texts give an array of gains, by which documents are scored.
Noise from a seeded digest turns the best scores into a draw without replacement. The k-th best key is found by
radix selection: the rows that share the key's digits so far are counted by their next digit, which moves one
digit on; no row moves for it. Only rows up to that key are sorted, by range, and ranked.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textcodes as tc
from .scratch import materialise

#: Bytes of text that are taken at once; longer texts are taken in portions that end between words.
PORTION = 1 << 20
#: Bits of a key's digit: one job counts the 2 ** DIGIT values of a digit, whatever the number of rows.
DIGIT = 12
#: Features of more bytes have their checksum one by one.
LONG = 64

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def crc32(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of every byte range, a byte of all of them at a time."""
    size = ends - starts
    code = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-size, kind="stable")
    first = np.searchsorted(-size[order], -LONG)
    for i in order[:first].tolist():
        code[i] = zlib.crc32(buf[starts[i] : ends[i]].tobytes()) ^ 0xFFFFFFFF
    todo = order[first:]
    at, left, part = starts[todo], size[todo], code[todo]
    for step in range(int(left[0]) if len(left) else 0):
        n = np.searchsorted(-left, -step)  # longer than step
        now = part[:n]
        part[:n] = _CRC[(now ^ buf[at[:n] + step]) & 0xFF] ^ (now >> np.uint32(8))
    code[todo] = part
    return code ^ np.uint32(0xFFFFFFFF)


def _word_ranges(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes in which words of a text stand one space apart, starts and ends of the words in them, and
    how many come before each text."""
    low = tc.LOWER[buf]
    inside = _WORD[low]
    edge = offs[(offs > 0) & (offs < len(buf))]
    after = np.append(inside[1:], False)
    after[edge - 1] = False
    before = np.insert(inside[:-1], 0, False)
    before[edge] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    woffs = np.searchsorted(starts, offs)
    size = ends - starts
    new_starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(size + 1)))[:-1]
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    out[np.repeat(new_starts - starts, size) + np.flatnonzero(inside)] = low[inside]
    return out, new_starts, new_starts + size, woffs


def feature_buckets(buf: np.ndarray, offs: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and bucket of every feature of some texts, and how many words each text has."""
    out, starts, ends, woffs = _word_ranges(buf, offs)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(woffs))
    docs, codes = [], []
    for n in range(1, longest + 1):
        first = np.arange(max(0, len(starts) - n + 1))
        first = first[owner[first] == owner[first + n - 1]]
        docs.append(owner[first])
        codes.append(crc32(out, starts[first], ends[first + n - 1]) % np.uint32(buckets))
    return np.concatenate(docs), np.concatenate(codes), np.diff(woffs)


def _is_word(byte: int) -> bool:
    return bool(_WORD[tc.LOWER[byte]])


def _portions(text: bytes, longest: int) -> Iterator[tuple[bytes, int]]:
    """(portion, words of the portion before that it begins with again) of a long text."""
    at = end = again = 0
    while True:
        end += PORTION  # beyond the portion before, however far back this one begins
        while end < len(text) and _is_word(text[end]):
            end += 1
        yield text[at:end], again
        if end >= len(text):
            return
        # Runs that cross the seam begin in the last longest - 1 words of this portion.
        at, again = end, 0
        while again < longest - 1:
            while at > 0 and not _is_word(text[at - 1]):
                at -= 1
            if not at:
                break
            while at > 0 and _is_word(text[at - 1]):
                at -= 1
            again += 1


def _sparse(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, n = np.unique(keys, return_counts=True)
    return found // np.uint64(buckets), (found % np.uint64(buckets)).astype("<u4"), n.astype("<u4")


def _long_features(text: bytes, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Buckets, their counts, words and features of one text in bounded memory."""
    have = np.zeros(buckets, np.int64)
    n_words = n_features = 0
    for portion, again in _portions(text, longest):
        buf = np.frombuffer(portion, np.uint8)
        _, codes, words = feature_buckets(buf, np.array([0, len(buf)]), longest, buckets)
        np.add.at(have, codes, 1)
        n_features += len(codes)
        n_words += int(words[0]) - again
        if again:  # runs within the repeated words were counted with the portion before
            cut = _prefix_of_words(buf, again)
            _, codes, _ = feature_buckets(buf[:cut], np.array([0, cut]), longest, buckets)
            np.subtract.at(have, codes, 1)
            n_features -= len(codes)
    at = np.flatnonzero(have)
    return at.astype("<u4"), have[at].astype("<u4"), n_words, n_features


def _prefix_of_words(buf: np.ndarray, n: int) -> int:
    inside = _WORD[tc.LOWER[buf]]
    ends = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
    return int(ends[n - 1])


FEATURES = "doc_id long, n_words long, n_features long, buckets binary, counts binary"


def _features(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(doc_id, text) to FEATURES: distinct buckets in order, and how often each occurs, as 32-bit integers."""

    def rows_of(batch):
        buf, offs = tc.buffer_of(batch.column("text"))
        for lo, hi in tc.slices(offs, PORTION):
            part, at = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            if hi == lo + 1 and len(part) > PORTION:
                b, c, words, n = _long_features(part.tobytes(), longest, buckets)
                yield lo, hi, [words], [n], [b.tobytes()], [c.tobytes()]
                continue
            doc, codes, words = feature_buckets(part, at, longest, buckets)
            of, b, c = _sparse(doc.astype(np.uint64) * np.uint64(buckets) + codes, buckets)
            cuts = np.searchsorted(of, np.arange(hi - lo + 1))
            pairs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            yield lo, hi, words, np.bincount(doc, minlength=hi - lo), [b[i:j].tobytes() for i, j in pairs], [c[i:j].tobytes() for i, j in pairs]

    @tc.trimmed
    def features(batches):
        for batch in batches:
            for lo, hi, words, n, b, c in rows_of(batch):
                columns = [batch.column("doc_id").slice(lo, hi - lo), pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.binary()), pa.array(c, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "buckets", "counts"])

    return docs.mapInArrow(features, FEATURES)


def bucket_totals(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs. Each task counts its own rows; what meets afterwards is `buckets` rows a task."""

    def totals(batches):
        have = np.zeros(buckets, np.int64)
        for batch in batches:
            b, _ = tc.buffer_of(batch.column("buckets"))
            c, _ = tc.buffer_of(batch.column("counts"))
            have += np.bincount(b.view("<u4"), c.view("<u4"), buckets).astype(np.int64)
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(have[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in features.select("buckets", "counts").mapInArrow(totals, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how much likelier a bucket is in the target), each count and total smoothed by one a bucket."""
    n = len(source)
    s, t = float(source.sum()), float(target.sum())
    top, below = (target + 1.0) * (s + n), (source + 1.0) * (t + n)
    return np.array([math.floor(1000 * math.log(x)) for x in (top / below).tolist()], np.int64)


def _scored(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of its features' gains."""
    shared = features.sparkSession.sparkContext.broadcast(gain.tobytes())  # eight bytes a bucket

    def score(batches):
        by_bucket = np.frombuffer(shared.value, np.int64)
        for batch in batches:
            b, offs = tc.buffer_of(batch.column("buckets"))
            c, _ = tc.buffer_of(batch.column("counts"))
            total = np.concatenate((np.zeros(1, np.int64), np.cumsum(by_bucket[b.view("<u4")] * c.view("<u4"))))
            weight = total[offs[1:] // 4] - total[offs[:-1] // 4]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return features.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln u)) with u from a seeded digest of the id: noise under which the largest sums are a draw."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _unsigned(x: Column, bits: int, width: int = DIGIT) -> Column:
    """The digit of x, whose bits are taken as unsigned, that ends `bits` above the lowest."""
    return F.shiftrightunsigned(x, bits).bitwiseAND((1 << width) - 1)


_SIGN = -(1 << 63)


def _first_keys() -> list[tuple[str, Column]]:
    """The parts of a row's key, as unsigned numbers of which the smallest is the best: score (downwards), id
    (without one: last), features, and the row's own number, so that no two keys are equal."""
    flip = lambda c: c.bitwiseXOR(F.lit(_SIGN))
    return [
        ("__k0", flip(F.bitwise_not(F.col("score")))),
        ("__k1", F.col("doc_id").isNull().cast("long")),
        ("__k2", flip(F.coalesce("doc_id", F.lit(0).cast("long")))),
        ("__k3", F.col("n_features")),
        ("__k4", F.col("__row")),
    ]


def radix_select(rows: DataFrame, keys: list[str], k: int) -> tuple[list[int], int]:
    """The first len(result) keys of the k-th smallest row by unsigned `keys`, which must differ for all rows, and the
    number of jobs. Ends as soon as every row that shares them is among the k smallest, so that rows up to these
    keys are exactly k.

    A job counts the rows that share the digits so far by their next digit: 2 ** DIGIT rows at most come back.
    Bits that all of them share are skipped, after one job for the ends of each key.
    """
    found: list[int] = []
    left, jobs = k, 0
    same = rows
    for name in keys:
        # Java's longs are signed: the ends of the unsigned order are those of the flipped number.
        ends = same.agg(F.min(F.col(name).bitwiseXOR(F.lit(_SIGN))), F.max(F.col(name).bitwiseXOR(F.lit(_SIGN)))).first()
        jobs += 1
        low, high = (int(x) - _SIGN for x in ends)
        top = (low ^ high).bit_length()
        value, bits = low >> top << top, top
        while bits > 0:
            width = min(DIGIT, bits)
            bits -= width
            counts = same.groupBy(_unsigned(F.col(name), bits, width).alias("digit")).count().collect()
            jobs += 1
            for digit, n in sorted((r.digit, r["count"]) for r in counts):
                if left <= n:
                    break
                left -= n
            value |= digit << bits
            same = same.filter(_unsigned(F.col(name), bits, width) == digit)
            if left == n:
                # All rows with these digits are among the k smallest: the rest of the key can't matter.
                return [*found, value | ((1 << bits) - 1)], jobs
        found.append(value)
        same_rows = F.col(name) == F.lit(_signed(value))
        same = same.filter(same_rows)
    return found, jobs


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def up_to(keys: list[str], found: list[int]) -> Column:
    """True for rows whose first keys are at most the found ones, in the order of the keys, unsigned."""
    out = F.lit(True)
    for name, value in reversed(list(zip(keys, found, strict=False))):
        x, v = F.col(name).bitwiseXOR(F.lit(_SIGN)), F.lit(_signed(value ^ (1 << 63)))
        out = (x < v) | ((x == v) & out)
    return out


def _ranked(rows: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    """rows with rank: ranges are sorted and written, and a row's rank is what the ranges before have, and its place."""
    order = [F.col(k).bitwiseXOR(F.lit(_SIGN)) for k in keys]
    placed = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    placed = placed.withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    placed = materialise(placed, "drawn")
    sizes = placed.groupBy("__range").count()  # a row for each partition
    before = F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__range", before.alias("__before"))
    return placed.join(F.broadcast(starts), "__range").withColumn("rank", (F.col("__before") + F.col("__at") + 1).cast("long"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank is null for rows that are not drawn.

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII, ASCII letters in lower case.
    Features are runs of 1 to `longest` words, by CRC-32 in `buckets` buckets. Drawn are `percent` of the rows with
    `least_words` words, the highest scores, ties to the smaller id. A null or empty text has no features and weight
    0; a null id has the noise of the text "null" and comes last among ties; of rows alike in all this, as many as
    there is room for are drawn. Without target texts every bucket counts as not met there. An empty table gives
    no rows. Other columns are ignored.

    What comes to the driver are `buckets` totals of each table and digits' counts. `partitions` of the sort follow
    the session's setting, for what is sorted are a few numbers of each drawn row.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    features = materialise(_features(rows, longest, buckets), "features")
    there = _features(target.select(F.lit(0).cast("long").alias("doc_id"), F.col(target_col).alias("text")), longest, buckets)
    gain = gains(bucket_totals(features, buckets), bucket_totals(there, buckets))
    scored = _scored(features, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("__row", F.monotonically_increasing_id())
    scored = materialise(scored, "scores")
    keys = _first_keys()
    names = [n for n, _ in keys]
    able = scored.filter(F.col("n_words") >= least_words).withColumns(dict(keys))
    k = percent * able.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*columns, none)
    found, _ = radix_select(able, names, k)
    chosen = (F.col("n_words") >= least_words) & up_to(names, found)
    with_keys = scored.withColumns(dict(keys))
    drawn = _ranked(with_keys.filter(chosen), names, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rest = with_keys.filter(~chosen)
    return rest.select(*columns, none).unionByName(drawn.select(*columns, "rank"))


def sql(percent: int = 10, buckets: int = 10_000, least_words: int = 20, seed: int = 2024) -> str:
    """The same for DuckDB, of single words; each distinct word's checksum is reckoned byte by byte."""
    words = lambda table: f"regexp_extract_all(translate({table}.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH crc AS (SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t
    FROM range(256) r(b)),
d AS (SELECT doc_id, row_number() OVER () AS row, coalesce({words("documents")}, []) AS w FROM documents),
dw AS (SELECT row, unnest(w) AS word FROM d),
bw AS (SELECT unnest({words("benchmark")}) AS word FROM benchmark),
hashed AS (SELECT word, xor(list_reduce(list_transform(range(0, octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % {buckets} AS bucket
    FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (word) GROUP BY bucket),
size AS (SELECT (SELECT count(*) FROM dw) AS s, (SELECT count(*) FROM bw) AS t),
gain AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (size.s + {buckets})::DOUBLE / ((s.n + 1)::DOUBLE * (size.t + {buckets})::DOUBLE)))::BIGINT AS gain
    FROM s LEFT JOIN t USING (bucket), size),
weights AS (SELECT row, sum(gain)::BIGINT AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY row),
h AS (SELECT *, ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h FROM d),
scored AS (SELECT doc_id, row, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM h LEFT JOIN weights USING (row)),
able AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, row) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {least_words})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {percent} * n // 100 THEN place END AS rank FROM scored LEFT JOIN able USING (row)"""
