"""Quality rules with thresholds that follow the data.

Counts of each whole text are taken in one Arrow pass. Their ratios go into quantile sketches per
language and source (approx_percentile: partial sketches are built before the shuffle and merged
after it, so a hot source is no hot task). A fence around the middle half of each group replaces
fixed cutoffs, and the fences are joined back to the rows they judge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import textcodes as tc
from .scratch import materialise

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_INNER = np.zeros(256, bool)
_INNER[0x80:0xC0] = True
_SLICE = 1 << 20
WINDOW = 8


def _repeat_words(codes: np.ndarray, woffs: np.ndarray) -> np.ndarray:
    """Of each document, the words in windows that its words hold twice or more."""
    n_docs = len(woffs) - 1
    g = tc.grams(codes, WINDOW)
    doc = np.repeat(np.arange(n_docs), np.diff(woffs))
    at = np.arange(len(g))
    at = at[doc[: len(g)] == doc[WINDOW - 1 :]] if len(g) else at
    key = tc.mix(g[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = np.zeros(len(key), bool)
    eq = key[order][1:] == key[order][:-1]
    same[1:] |= eq
    same[:-1] |= eq
    hit = at[order[same]]
    return tc.counts_between(tc.covered(len(codes), hit, hit + WINDOW), woffs) if len(codes) else np.zeros(n_docs, np.int64)


def _lines(buf: np.ndarray, offs: np.ndarray, wstarts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document, lines with a word, and those of them that equal an earlier one."""
    n_docs = len(offs) - 1
    cuts = np.flatnonzero(buf == 0x0A)
    starts = np.concatenate((offs[:-1], cuts + 1))
    doc = np.concatenate((np.arange(n_docs), np.searchsorted(offs, cuts, "right") - 1))
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.append(starts[1:] - 1, len(buf))
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    ends[last] = offs[doc[last] + 1]
    worded = np.searchsorted(wstarts, ends) > np.searchsorted(wstarts, starts)
    starts, ends, doc = starts[worded], ends[worded], doc[worded]
    n_lines = np.bincount(doc, minlength=n_docs)
    if not len(doc):
        return n_lines, n_lines.copy()
    codes = tc.span_codes(buf, starts, ends)
    order = np.lexsort((codes, doc))
    codes, doc = codes[order], doc[order]
    again = np.zeros(len(doc), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    return n_lines, np.bincount(doc[again], minlength=n_docs)


def count_slice(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """COUNTS of every document of a slice."""
    starts, ends, woffs = tc.words(buf, offs)
    n_lines, dup = _lines(buf, offs, starts)
    return [
        np.diff(woffs),
        tc.counts_between(~(tc.IS_SPACE | _INNER)[buf], offs),
        tc.counts_between(_SYMBOL[buf], offs),
        dup,
        _repeat_words(tc.span_codes(buf, starts, ends), woffs),
        tc.counts_between(_UPPER[buf], offs),
        n_lines,
    ]


def _counting(text_col: str):
    @tc.trimmed
    def count(batches):
        for batch in batches:
            found = [count_slice(buf, offs) for _, _, buf, offs in tc.batches(batch, text_col, _SLICE)]
            columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c.astype(np.int64)) for c in columns)], names=[*batch.schema.names, *(f"__{c}" for c in COUNTS)])

    return count


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and its COUNTS, as columns named __n_words and so on; a null text has none."""
    schema = StructType([*docs.schema.fields, *(StructField(f"__{c}", LongType()) for c in COUNTS)])
    return docs.mapInArrow(_counting(text_col), schema)


def _ratio(top: str, below: str) -> Column:
    return F.col(f"__{top}") / F.greatest(F.col(f"__{below}"), F.lit(1))


#: Ratio, whether low values are suspect too, and the least half-width of its fence.
RATIOS = {
    "symbols": (lambda: _ratio("n_symbols", "n_words"), False, 0.25),
    "length": (lambda: _ratio("word_chars", "n_words"), True, 2.5),
    "repeats": (lambda: _ratio("n_repeat_words", "n_words"), False, 0.2),
    "lines": (lambda: _ratio("n_dup_lines", "n_lines"), False, 0.3),
    "upper": (lambda: _ratio("n_upper", "word_chars"), False, 0.2),
}


def base_failed() -> Column:
    return (F.col("__n_words") < 20) | (100 * F.col("__n_repeat_words") > 30 * F.col("__n_words"))


def thresholds(counted: DataFrame, groups: list[str], least_rows: int = 200, width: float = 4.0, accuracy: int = 2000) -> DataFrame:
    """Fences of every group, from sketches of its rows that pass the base rules.

    A fence is [q25 - width * (q75 - q25) - least, q75 + width * (q75 - q25) + least]. A group with
    fewer than `least_rows` such rows takes the fences of its first column's value as a whole (its
    language), for sketches of few rows say little.
    """
    ratios = counted.filter(~base_failed()).select(*groups, *(make().alias(f"__r_{r}") for r, (make, _, _) in RATIOS.items()))
    quarters = [F.percentile_approx(f"__r_{r}", [0.25, 0.75], F.lit(accuracy)).alias(f"__q_{r}") for r in RATIOS]
    own = ratios.groupBy(*groups).agg(F.count("*").alias("__rows"), *quarters)
    wide = ratios.groupBy(groups[0]).agg(*(q.alias(f"__w{i}") for i, q in enumerate(quarters)))
    wide = wide.withColumnRenamed(groups[0], "__wide")
    both = own.join(wide, F.col(groups[0]).eqNullSafe(F.col("__wide")), "left")
    out = []
    for i, (r, (_, low, least)) in enumerate(RATIOS.items()):
        q = F.when(F.col("__rows") >= least_rows, F.col(f"__q_{r}")).otherwise(F.col(f"__w{i}"))
        spread = width * (q[1] - q[0]) + least
        out += [(q[1] + spread).alias(f"__hi_{r}"), ((q[0] - spread) if low else F.lit(-1.0)).alias(f"__lo_{r}")]
    return both.select(*(F.col(g).alias(f"__g_{g}") for g in groups), *out)


def judged(counted: DataFrame, fences: DataFrame, groups: list[str]) -> DataFrame:
    """counted with __failed and __kept. A row whose group has no fences stays if the base rules pass it."""
    inside = F.lit(True)
    for r, (make, _, _) in RATIOS.items():
        inside = inside & F.coalesce((make() <= F.col(f"__hi_{r}")) & (make() >= F.col(f"__lo_{r}")), F.lit(True))
    on = F.lit(True)
    for g in groups:
        on = on & counted[g].eqNullSafe(fences[f"__g_{g}"])
    return counted.join(fences, on, "left").withColumn("__failed", base_failed()).withColumn("__kept", ~base_failed() & inside)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"), **options) -> DataFrame:
    """Judge every row: id, COUNTS, base_failed and kept.

    Words are runs without white space. A null or empty text has no words and fails the base rules;
    null groups are a group of their own; repeated rows are judged alike; an empty table gives no
    rows. Other columns are ignored. options: those of thresholds().
    """
    groups = list(groups)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"), *groups)
    counted = materialise(with_counts(rows, "__text").drop("__text"), "quality")
    out = judged(counted, thresholds(counted, groups, **options), groups)
    return out.select("doc_id", *(F.col(f"__{c}").alias(c) for c in COUNTS), F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"))


def quality_filter(docs: DataFrame, text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"), **options) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns; nulls, repeated rows and empty
    tables as there.

    Rows are written with their counts first, so that each text is counted once; the fences come from what
    is written. Their size is known to Spark as well, which broadcasts them if they are small and shuffles
    otherwise.
    """
    groups = list(groups)
    counted = materialise(with_counts(docs, text_col), "counted")
    fences = materialise(thresholds(counted, groups, **options), "fences")
    return judged(counted, fences, groups).filter("__kept").select(*docs.columns)
