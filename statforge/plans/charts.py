"""Leaderboards and charts (CHRT-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import first_by, five_numbers, pg_asc, pg_desc, rnd_decimal, safe_div

#: Pre-aggregated team codes of traded players.
COMBINED = ("TOT", "2TM", "3TM", "4TM")
PER_GAME = ("pts", "trb", "ast", "stl", "blk", "tov", "fg", "fga", "ft", "fta")
#: Sort keys of the advanced leaderboard, its columns, and those of the shooting zones.
ADVANCED = ("per", "ts_percent", "usg_percent", "ast_percent", "tov_percent", "stl_percent", "blk_percent", "bpm", "vorp", "ws", "ows", "dws")
ADVANCED_COLUMNS = ("per", "ts_percent", "x3p_ar", "f_tr", "orb_percent", "drb_percent", "trb_percent", "ast_percent", "stl_percent", "blk_percent", "tov_percent", "usg_percent", "ows", "dws", "ws", "ws_48", "obpm", "dbpm", "bpm", "vorp")
ZONES = ("x0_3", "x3_10", "x10_16", "x16_3p", "x3p")
SHOOTING_COLUMNS = ("fg_percent", "avg_dist_fga", *(f"percent_fga_from_{z}_range" for z in ZONES), *(f"fg_percent_from_{z}_range" for z in ZONES), "percent_assisted_x2p_fg", "percent_assisted_x3p_fg", "percent_dunks_of_fga", "num_of_dunks", "percent_corner_3s_of_3pa", "corner_3_point_percent")


def one_stint(facts: DataFrame, season: int, min_games: int = 0, key: str = "player_id") -> DataFrame:
    """WIN-02, FLT-03, FLT-14: of each player the stint with most games, without combined rows."""
    rows = facts.filter((F.col("season") == season) & ~F.col("team").isin(*COMBINED) & (F.col("g") >= min_games))
    return first_by(rows, [key], [pg_desc("g"), pg_asc("team"), pg_asc("pos")])


def scoring_distribution(facts: DataFrame, season: int, min_games: int = 1, rank_error: float | None = None) -> DataFrame:
    """CHRT-01: a box plot of points per game; total counts rows. Quartiles are exact: what meets in one task is
    one row for each distinct value of one season. With rank_error they come from a sketch (see five_numbers)."""
    rows = facts.filter((F.col("season") == season) & F.col("g").isNotNull() & (F.col("g") >= min_games)).select((F.col("pts") / F.col("g")).alias("ppg"))
    return rows.agg(*five_numbers("ppg", rank_error), F.count("*").alias("total"))


def per_game_leaders(facts: DataFrame, season: int, sort: str = "pts", limit: int = 50) -> DataFrame:
    """CHRT-05, SRT-05: an unknown sort key falls back to points."""
    sort = sort if sort in PER_GAME else "pts"
    rows = one_stint(facts, season).select("player_id", "team", "g", *(rnd_decimal(safe_div(F.col(c), F.col("g")), 3).alias(c) for c in PER_GAME))
    return rows.orderBy(F.col(sort).desc_nulls_last(), "player_id").limit(min(limit, 200))


def advanced_leaders(facts: DataFrame, season: int, sort: str = "per", limit: int = 50, min_games: int = 10) -> DataFrame:
    """CHRT-02: an unknown sort key falls back to per."""
    sort = sort.lower() if sort and sort.lower() in ADVANCED else "per"
    rows = one_stint(facts, season, min_games).select("season", "player_id", "team", "pos", "g", "mp", *ADVANCED_COLUMNS)
    return rows.orderBy(F.col(sort).desc_nulls_last(), "player_id").limit(min(limit, 200))


def shooting_zones(shooting: DataFrame, season: int, limit: int = 50, min_games: int = 10) -> DataFrame:
    """CHRT-03: shares and accuracies by distance, and assisted shares, of the stint with most games, by minutes."""
    rows = shooting.filter((F.col("season") == season) & ~F.col("team").isin(*COMBINED) & (F.col("g") >= min_games))
    rows = first_by(rows, ["player"], [pg_desc("g"), pg_asc("team")]).select("season", "player", "team", "g", "mp", *SHOOTING_COLUMNS)
    return rows.orderBy(pg_desc("mp"), "player").limit(min(limit, 100))


def player_ratios(facts: DataFrame, season: int) -> DataFrame:
    """CHRT-04."""
    ratio = lambda a, b: rnd_decimal(safe_div(F.col(a), F.col(b)), 2)
    rows = one_stint(facts, season).select("player_id", ratio("ast", "tov").alias("ast_tov"), ratio("stl", "pf").alias("stl_pf"))
    return rows.orderBy(F.col("ast_tov").desc_nulls_last(), "player_id")


def leaderboard(facts: DataFrame, kind: str, season: int, **options) -> DataFrame:
    """ENG-13."""
    if kind not in ("per_game", "advanced"):
        raise ValueError(f"no leaderboard of {kind}")
    return (per_game_leaders if kind == "per_game" else advanced_leaders)(facts, season, **options)
