"""Expressions with explicit NULL order, rounding and tie rules.

MATH-*, STR-*, NUL-*, DATE-*, PRJ-05..08 of the survey. Everything is a Column: nothing leaves codegen.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Name suffixes, display names of positions, team code dialects.
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
POSITION_NAMES = {"PG": "Point Guard", "SG": "Shooting Guard", "SF": "Small Forward", "PF": "Power Forward", "C": "Center"}
TEAM_CODES = {"BKN": "BRK", "PHX": "PHO", "CHA": "CHO", "UTAH": "UTA"}


def rnd(x: Column, digits: int) -> Column:
    """Half to even on the scaled double (MATH-01, MATH-02)."""
    scale = F.lit(float(10**digits))
    return F.rint(x * scale) / scale


def rnd_decimal(x: Column, digits: int) -> Column:
    """Half away from zero, as NUMERIC rounds (MATH-03); back to double."""
    return F.round(x.cast("decimal(38,10)"), digits).cast("double")


def safe_div(a: Column, b: Column) -> Column:
    """NULL where the denominator is 0 or NULL (PRJ-05)."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def guarded(a: Column, b: Column) -> Column:
    """The denominator is 1 at least (PRJ-06)."""
    return a / F.greatest(b, F.lit(1.0))


def total(name: str) -> Column:
    """Sum that is 0, not NULL, without values (AGG-01)."""
    return F.coalesce(F.sum(F.col(name)), F.lit(0.0))


def pct_or_zero(a: Column, b: Column, digits: int = 4) -> Column:
    """PRJ-07: 0.0 where the denominator is 0 or NULL."""
    return F.when(F.coalesce(b, F.lit(0)) != 0, rnd(a / b, digits)).otherwise(F.lit(0.0))


def pg_desc(name: str) -> Column:
    """Descending with NULL first, as the reference's SQL orders."""
    return F.col(name).desc_nulls_first()


def pg_asc(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the order (WIN-01..04); Spark limits groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") == 1).drop("__n")


def lookup(key: Column, values: dict[str, str]) -> Column:
    """values[key], or key (PRJ-09, PRJ-10)."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), key)


def strip(x: Column) -> Column:
    """All white space at both ends (STR-01)."""
    return F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"\s+$", "")


def first_text(*columns: str) -> Column:
    """The first that is neither NULL nor empty, or '' (STR-03)."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns), F.lit(""))


def substituted_in(text: Column) -> Column:
    """ "SUB: A FOR B" -> A, or NULL (STR-04)."""
    return F.nullif(strip(F.regexp_extract(strip(text), r"(?i)^(?:sub[: ]*)?(.*?) for ", 1)), F.lit(""))


def assisted_by(text: Column) -> Column:
    """The name after "assist by " or "assisted by ", cut at the first "(", "." or "," (STR-05)."""
    name = strip(F.regexp_extract(text, r"(?is)assist(?:ed)? by (.*)$", 1))
    for mark in "(.,":
        name = strip(F.regexp_replace(name, rf"(?s)^([^{mark}]+)[{mark}].*$", "$1"))  # a mark at the front cuts nothing
    return F.nullif(name, F.lit(""))


def last_name(name: Column) -> Column:
    """The last word, before a suffix such as Jr. (STR-06)."""
    words = F.split(strip(name), r"\s+")
    last = F.lower(F.regexp_replace(F.element_at(words, -1), r"\.", ""))
    use_second = last.isin(*NAME_SUFFIXES) & (F.size(words) > 1)
    return F.lower(F.when(use_second, F.try_element_at(words, F.lit(-2))).otherwise(F.element_at(words, -1)))


def clock_text(clock: Column) -> Column:
    """PT11M19.00S -> 11:19 (STR-07)."""
    part = lambda p: F.regexp_extract(clock, p, 1)
    m, s = part(r"^PT(\d+)M"), part(r"M(\d+)")
    return F.when(m != "", F.concat_ws(":", m, F.lpad(s, 2, "0"))).otherwise(clock)


def season_label(season: Column) -> Column:
    """2025 -> 2024-25 (STR-08)."""
    return F.concat((season - 1).cast("string"), F.lit("-"), F.lpad((season % 100).cast("string"), 2, "0"))


def season_of(day: Column) -> Column:
    """From October on, the season of the next year (DATE-01)."""
    return F.when(F.month(day) >= 10, F.year(day) + 1).otherwise(F.year(day))


def winner(a: Column, b: Column, lower: bool = False) -> Column:
    """1 or 2, NULL on ties and NULLs (PRJ-12)."""
    a, b = (b, a) if lower else (a, b)
    return F.when(a > b, 1).when(b > a, 2)


def five_numbers(name: str, rank_error: float | None = None) -> list[Column]:
    """Box plot with linear interpolation, zeros without values (AGG-11). rank_error: quartiles are values of the
    column whose ranks are off by at most that share of the rows, from a sketch that merges; without it they are
    exact, and all distinct values meet in one task."""
    quarters = [0.25, 0.5, 0.75]
    if rank_error is None:
        q = F.percentile(F.col(name), F.array(*map(F.lit, quarters)))
    else:
        q = F.percentile_approx(name, quarters, F.lit(math.ceil(1 / rank_error)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [zero(F.min(name)).alias("min"), zero(q[0]).alias("q1"), zero(q[1]).alias("median"), zero(q[2]).alias("q3"), zero(F.max(name)).alias("max")]


def r_squared(y: str, x: str) -> Column:
    """0.0 where y is constant (AGG-18)."""
    return F.when(F.var_pop(y) == 0, F.lit(0.0)).otherwise(F.regr_r2(y, x))


def cosine(a: list[Column], b: list[Column]) -> Column:
    """AGG-19, on columns; a zero norm counts as 1 on the right, NULL on the left."""
    add = lambda xs: reduce(lambda p, q: p + q, xs)
    norm = lambda v: F.sqrt(add([x * x for x in v]))
    right = norm(b)
    return add([x * y for x, y in zip(a, b, strict=True)]) / (F.nullif(norm(a), F.lit(0.0)) * F.when(right == 0, F.lit(1.0)).otherwise(right))
