"""Similarity, role evolution and trends (CTX-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import cosine, r_squared, rnd
from ..operators.metrics import with_bios


def similar_players(matrix: DataFrame, target: str, metrics: list[str], k: int = 10, bios: DataFrame | None = None, same_position: bool = False, key: str = "player_id") -> DataFrame:
    """CTX-01: cosine of z-scores. Rows with a NULL metric are out; a NULL or zero target gives no rows.

    Means and deviations are one row, joined on a constant; the target is one row too."""
    rows = matrix.select(key, *metrics)
    if same_position and bios is not None:
        pos = bios.select(key, "position")
        token = F.trim(F.split(F.col("position"), ",")[0])
        wanted = pos.filter(F.col(key) == target).select(token.alias("__token"))
        near = pos.join(F.broadcast(wanted), F.col("position").contains(F.col("__token")) | (F.col(key) == target), "left_semi").select(key)
        rows = rows.join(near, key, "left_semi")
    stats = rows.agg(*(F.avg(m).alias(f"__m_{m}") for m in metrics), *(F.stddev_samp(m).alias(f"__s_{m}") for m in metrics))
    z = lambda m: (F.col(m) - F.col(f"__m_{m}")) / F.when(F.col(f"__s_{m}") == 0, 1.0).otherwise(F.col(f"__s_{m}"))
    scored = rows.join(F.broadcast(stats), F.lit(True)).select(key, *(z(m).alias(m) for m in metrics)).dropna(subset=metrics)
    me = scored.filter(F.col(key) == target).select(*(F.col(m).alias(f"__t_{m}") for m in metrics)).limit(1)
    sim = cosine([F.col(f"__t_{m}") for m in metrics], [F.col(m) for m in metrics])
    out = scored.filter(F.col(key) != target).join(F.broadcast(me), F.lit(True)).select(key, rnd(sim, 4).alias("similarity"))
    return out.filter("similarity is not null").orderBy(F.desc("similarity"), key).limit(k)


def similar_with_bios(similar: DataFrame, bios: DataFrame, key: str = "player_id") -> DataFrame:
    """JOIN-08: similar players with names and positions; the player's name first, then the full name, then the id."""
    return with_bios(similar, bios, prefer_full=False, key=key).orderBy(F.desc("similarity"), key)


def trend_line(trend: DataFrame, seasons: list[int], key: str = "player_id") -> DataFrame:
    """UI-01: the fitted line at each season, where there is one."""
    line = F.explode(F.array(*map(F.lit, seasons))).alias("season")
    rows = trend.filter("slope is not null").select(key, "slope", "intercept", line)
    return rows.select(key, "season", rnd(F.col("slope") * F.col("season") + F.col("intercept"), 4).alias("fitted"))


def role_evolution(by_season: DataFrame, metrics: list[str], key: str = "player_id") -> DataFrame:
    """CTX-02: (key, metric) with first, last, changes, direction and slope. by_season has a row for each season with any row."""
    ends = by_season.groupBy(key).agg(F.min("season").alias("__lo"), F.max("season").alias("__hi"))
    long = by_season.unpivot([key, "season"], metrics, "metric", "value").join(ends.filter("__lo < __hi"), key)
    at = lambda c: F.max(F.when(F.col("season") == F.col(c), F.col("value")))
    out = long.groupBy(key, "metric").agg(at("__lo").alias("first_value"), at("__hi").alias("last_value"), rnd(F.regr_slope(F.col("value"), F.col("season").cast("double")), 4).alias("slope"))
    change = rnd(F.col("last_value") - F.col("first_value"), 4)
    pct = F.when(F.col("first_value") != 0, rnd(100 * (F.col("last_value") - F.col("first_value")) / F.abs("first_value"), 2))
    out = out.withColumn("abs_change", change).withColumn("pct_change", pct)
    return out.withColumn("direction", F.when(F.col("abs_change") > 0, "up").when(F.col("abs_change") < 0, "down").when(F.col("abs_change").isNotNull(), "flat"))


def role_shift(evolution: DataFrame, metrics: list[str], key: str = "player_id") -> DataFrame:
    """1 - cosine of the raw first and last vectors; needs two metrics that both have."""
    both = evolution.filter("first_value is not null and last_value is not null").groupBy(key).agg(
        F.count("*").alias("n"), F.sum(F.col("first_value") * F.col("last_value")).alias("d"), F.sqrt(F.sum(F.col("first_value") ** 2)).alias("a"), F.sqrt(F.sum(F.col("last_value") ** 2)).alias("b"))
    return both.select(key, F.when((F.col("n") >= 2) & (F.col("a") > 0) & (F.col("b") > 0), rnd(1 - F.col("d") / (F.col("a") * F.col("b")), 4)).otherwise(0.0).alias("role_shift"))


def top_movers(evolution: DataFrame, n: int = 3, key: str = "player_id") -> DataFrame:
    """SRT-11: the n largest rises and falls by percent."""
    known = evolution.filter("pct_change is not null and pct_change <> 0").withColumn("side", F.when(F.col("pct_change") > 0, "growth").otherwise("decline"))
    w = Window.partitionBy(key, "side").orderBy(F.abs("pct_change").desc(), "metric")
    return known.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select(key, "side", "place", "metric", "pct_change")


def metric_trend(points: DataFrame, requested_last: int, key: str = "player_id") -> DataFrame:
    """CTX-03, UI-01: points(key, season, value) -> line, momentum of the last three, prediction for the next season."""
    rows = points.filter("value is not null").withColumn("x", F.col("season").cast("double"))
    late = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("season")))
    rows = rows.withColumn("__late", late)
    slope, cut = F.regr_slope("value", "x"), F.regr_intercept("value", "x")
    recent = F.regr_slope(F.when(F.col("__late") <= 3, F.col("value")), F.when(F.col("__late") <= 3, F.col("x")))
    out = rows.groupBy(key).agg(F.count("*").alias("n"), slope.alias("__s"), cut.alias("__c"), r_squared("value", "x").alias("__r"), recent.alias("__m"))
    ok = (F.col("n") >= 2) & F.col("__s").isNotNull()
    direction = F.when(~ok, "insufficient_data").when(F.col("__s") > 1e-9, "up").when(F.col("__s") < -1e-9, "down").otherwise("flat")
    keep = lambda c, p: F.when(ok, rnd(c, p))
    return out.select(
        key, "n", keep(F.col("__s"), 6).alias("slope"), keep(F.col("__c"), 4).alias("intercept"), keep(F.col("__r"), 4).alias("r2"),
        F.when(ok & (F.col("n") >= 4), rnd(F.col("__m"), 4)).alias("momentum"), keep(F.col("__s") * (requested_last + 1) + F.col("__c"), 4).alias("prediction"), direction.alias("direction"),
    )


def evolution_window(season: int) -> list[int]:
    """UI-02."""
    return list(range(season - 4, season + 1))
