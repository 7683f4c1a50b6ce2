"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions only.

A budget of tokens goes down the tree domain > language > source. At each node it is divided by the
children's weights; a child that can't fill its share (tokens of all its documents, times the epochs
allowed) takes what it has, and its siblings take over the shortage in proportion. Only what all of a
node's children together can't fill was never given to the node: it went to the node's own siblings.
A leaf then takes whole epochs and, of the next one, the prefix of a seeded order that fits.

The order is that of MD5 digests. Running sums are taken digit by digit: over the sixteen values of the
first hexadecimal digit of a leaf's digests, over those of the second below each first one, and so on,
and then inside the slice that all DIGITS of them leave, so that a hot leaf is many small windows and no
window has more than sixteen rows but the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: The hexadecimal digits of the digest that number a slice: 16 ** 4 slices for each leaf.
DIGITS = 4
#: Weights by level and name that the registered query mixes to; "*": all other names.
TARGETS = {"domain": {"d0": 3, "d1": 2, "*": 1}, "lang": {"en": 4, "de": 2, "*": 1}, "source": {"src0": 5, "src5": 3, "src9": 2, "*": 1}}


def default_domain(source: Column) -> Column:
    """The synthetic tables have no domain: sources are dealt to four by the number at their end."""
    number = F.regexp_extract(source, r"(\d{1,9})$", 1)
    return F.when(number == "", F.lit("d-")).otherwise(F.concat(F.lit("d"), (number.cast("long") % 4).cast("string")))


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(weights.get("*", 1))
    for name, w in sorted(weights.items()):
        if name != "*":
            out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def water_fill(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """children(*parent, child, cap, weight, budget) with share: whole tokens, at most cap, about in
    proportion to weight, together at most budget. Weight 0: nothing."""
    usable = F.when((F.col("weight") > 0) & (F.col("cap") > 0), F.col("cap") / F.col("weight"))
    order = Window.partitionBy(*parent).orderBy(F.asc_nulls_last("ratio"), child)
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    out = children.withColumn("ratio", usable)
    caps, weights = F.when(F.col("ratio").isNotNull(), F.col("cap")).otherwise(0), F.when(F.col("ratio").isNotNull(), F.col("weight")).otherwise(0)
    out = out.withColumn("__before", F.coalesce(F.sum(caps).over(before), F.lit(0)).cast("long")).withColumn("__onward", F.sum(weights).over(onward).cast("long"))
    out = out.withColumn("__place", F.row_number().over(order))
    out = out.withColumn("__level", F.when(F.col("ratio").isNotNull(), (F.col("budget") - F.col("__before")) / F.col("__onward")))
    open_ = F.when(F.col("__level") <= F.col("ratio"), F.struct("__place", "__level"))
    out = out.withColumn("__first", F.min(open_).over(Window.partitionBy(*parent)))
    share = F.when(F.col("ratio").isNull(), 0).when(F.col("__first").isNull() | (F.col("__place") < F.col("__first.__place")), F.col("cap"))
    share = share.otherwise(F.greatest(F.lit(0), F.least(F.col("cap"), F.floor(F.col("weight") * F.col("__first.__level"))))).cast("long")
    return out.withColumn("share", share).drop("ratio", "__before", "__onward", "__place", "__level", "__first")


def leaf_budgets(leaves: DataFrame, budget_percent: int, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """leaves(domain, lang, source, tokens) with share, the tokens that each may give."""
    levels = ["domain", "lang", "source"]
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    above = caps.agg((F.sum("tokens") * budget_percent / 100).cast("decimal(38,6)").alias("budget")).select(F.floor("budget").cast("long").alias("budget"))
    keys: list[str] = []
    for depth, level in enumerate(levels):
        children = caps.groupBy(*levels[: depth + 1]).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(level, weights.get(level, {})))
        children = children.join(above, keys) if keys else children.join(F.broadcast(above))  # one row at the root
        above = water_fill(children, keys or [F.lit(0)], level).select(*levels[: depth + 1], F.col("share").alias("budget"))
        keys = levels[: depth + 1]
    return leaves.join(above.withColumnRenamed("budget", "share"), levels)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain: Column | None = None, budget_percent: int = 90, max_epochs: int = 2, seed: int = 7, weights: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, leaf_budget, n_epochs: how often each document is taken.

    Tokens are words. `budget_percent`: the whole budget against the tokens there are. `weights`: by
    level (domain, lang, source) and name, "*" for all others; 1 by default. A null lang or source is
    "?"; a null or empty text has no tokens, takes no budget and is taken in every epoch of its leaf
    that is taken whole. Equal digests (repeated ids) are ordered by nothing else and share a fate: a
    row is taken if all rows up to its digest fit. Null ids are ordered as the text "null". Empty
    table: no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("source", F.lit("?")).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))
    rows = rows.withColumn("domain", default_domain(F.col("source")) if domain is None else domain)
    rows = materialise(rows, "mixing")
    levels = ["domain", "lang", "source"]
    leaves = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    budgets = materialise(leaf_budgets(leaves, budget_percent, max_epochs, weights or {}), "budgets")
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("share") / F.col("tokens")).cast("long")).otherwise(F.lit(0).cast("long"))
    budgets = budgets.withColumn("whole", whole).withColumn("rest", F.col("share") - F.col("whole") * F.col("tokens"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    placed = rows.join(budgets, levels).withColumn("digest", digest).withColumn("slice", F.substring("digest", 1, DIGITS))
    slices = _ahead(placed.groupBy(*levels, "slice").agg(F.sum("n_tokens").alias("tokens_in")), levels)
    inside = F.sum("n_tokens").over(Window.partitionBy(*levels, "slice").orderBy("digest").rangeBetween(Window.unboundedPreceding, 0))
    out = placed.withColumn("inside", inside).join(slices, [*levels, "slice"])
    fits = (F.col("rest") > 0) & (F.col("ahead") + F.col("inside") <= F.col("rest"))
    taken = (F.col("whole") + F.when(fits, 1).otherwise(0)).cast("long")
    return out.select("doc_id", *levels, "n_tokens", F.col("share").alias("leaf_budget"), taken.alias("n_epochs"))


def _ahead(slices: DataFrame, levels: list[str]) -> DataFrame:
    """slices(*levels, slice, tokens_in) with ahead, the tokens in all slices of the leaf before."""
    out, tree = slices, slices.select(*levels, F.col("slice").alias("prefix"), "tokens_in")
    total = F.lit(0).cast("long")
    for n in range(DIGITS - 1, -1, -1):
        w = Window.partitionBy(*levels, "above").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        tree = tree.withColumn("above", F.substring("prefix", 1, n))
        before = tree.select(*levels, F.col("prefix").alias(f"prefix{n}"), F.coalesce(F.sum("tokens_in").over(w), F.lit(0)).alias(f"before{n}"))
        out = out.withColumn(f"prefix{n}", F.substring("slice", 1, n + 1)).join(before, [*levels, f"prefix{n}"])
        total = total + F.col(f"before{n}")
        tree = tree.groupBy(*levels, F.col("above").alias("prefix")).agg(F.sum("tokens_in").alias("tokens_in"))
    return out.select(*levels, "slice", total.cast("long").alias("ahead"))


def sql(table: str = "documents", budget_percent: int = 90, max_epochs: int = 2, seed: int = 7, weights: dict[str, dict[str, int]] | None = None) -> str:
    """The same for DuckDB: doc_id, domain, lang, source, n_tokens, leaf_budget, n_epochs."""

    def weight(level: str) -> str:
        mine = (weights or {}).get(level, {})
        cases = "".join(f" WHEN '{name}' THEN {w}" for name, w in sorted(mine.items()) if name != "*")
        return f"(CASE c.{level}{cases} ELSE {mine.get('*', 1)} END)" if cases else str(mine.get("*", 1))

    def fill(name: str, keys: list[str], child: str, above: str) -> str:
        cols, part = ", ".join([*keys, child]), f"PARTITION BY {', '.join(keys)}" if keys else ""
        on = " AND ".join(f"c.{k} = a.{k}" for k in keys) or "true"
        return f"""
    {name}_c AS (SELECT {cols}, sum(tokens * {max_epochs})::BIGINT AS cap FROM leaves GROUP BY {cols}),
    {name}_r AS (SELECT {", ".join(f"c.{k}" for k in [*keys, child])}, c.cap, a.budget, {weight(child)} AS weight, CASE WHEN c.cap > 0 AND {weight(child)} > 0 THEN c.cap / {weight(child)} END AS ratio FROM {name}_c c JOIN {above} a ON {on}),
    {name}_w AS (SELECT *, coalesce(sum(CASE WHEN ratio IS NOT NULL THEN cap ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
        sum(CASE WHEN ratio IS NOT NULL THEN weight ELSE 0 END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS onward, row_number() OVER w AS place
        FROM {name}_r WINDOW w AS ({part} ORDER BY ratio ASC NULLS LAST, {child})),
    {name}_l AS (SELECT *, CASE WHEN ratio IS NOT NULL THEN (budget - before) / onward END AS level FROM {name}_w),
    {name}_f AS (SELECT *, min(CASE WHEN level <= ratio THEN place END) OVER ({part}) AS first_place, arg_min(level, CASE WHEN level <= ratio THEN place END) OVER ({part}) AS first_level FROM {name}_l),
    {name} AS (SELECT {cols}, (CASE WHEN ratio IS NULL THEN 0 WHEN first_place IS NULL OR place < first_place THEN cap ELSE greatest(0, least(cap, floor(weight * first_level))) END)::BIGINT AS budget FROM {name}_f)"""

    return f"""
    WITH docs AS (SELECT doc_id, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM {table}),
    rows_ AS (SELECT *, CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) = '' THEN 'd-' ELSE 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::BIGINT % 4) END AS domain FROM docs),
    leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM rows_ GROUP BY ALL),
    root AS (SELECT floor(sum(tokens) * {budget_percent} / 100)::BIGINT AS budget FROM leaves),
    {fill("by_domain", [], "domain", "root")},
    {fill("by_lang", ["domain"], "lang", "by_domain")},
    {fill("by_source", ["domain", "lang"], "source", "by_lang")},
    budgets AS (SELECT l.*, b.budget AS share, CASE WHEN l.tokens > 0 THEN b.budget // l.tokens ELSE 0 END AS whole FROM leaves l JOIN by_source b USING (domain, lang, source)),
    placed AS (SELECT r.*, b.share, b.whole, b.share - b.whole * b.tokens AS rest, md5(concat_ws(':', '{seed}', b.whole::VARCHAR, coalesce(r.doc_id::VARCHAR, 'null'))) AS digest FROM rows_ r JOIN budgets b USING (domain, lang, source)),
    summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY digest) AS upto FROM placed)
    SELECT doc_id, domain, lang, source, n_tokens, share AS leaf_budget, (whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS n_epochs FROM summed"""
