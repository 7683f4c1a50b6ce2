"""Teams (TEAM-*, FALL-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import first_by, pct_or_zero, pg_asc, pg_desc, rnd_decimal, safe_div, winner

#: Stand-ins for the two conferences: any two sets of team codes can be passed.
EAST, WEST = tuple(f"NATION_{i}" for i in range(5)), tuple(f"NATION_{i}" for i in range(5, 10))
#: Axis maxima of the radar, axes that are percentages, and axes on which less is better.
AXES = {"pts": 125.0, "reb": 50.0, "ast": 32.0, "stl": 10.0, "blk": 7.0, "fg_pct": 55.0, "fg3_pct": 45.0, "ft_pct": 88.0, "pace": 108.0, "x3p_ar": 55.0, "fta": 32.0, "tov": 20.0, "pf": 28.0, "plus_minus": 12.0}
PERCENTAGES = ("fg_pct", "fg3_pct", "ft_pct", "x3p_ar")
INVERTED = ("tov", "pf")
#: Columns of the per-game table by their name in a radar.
PER_GAME = {"pts": "pts_per_game", "reb": "trb_per_game", "ast": "ast_per_game", "stl": "stl_per_game", "blk": "blk_per_game", "fg_pct": "fg_percent", "fg3_pct": "x3p_percent", "ft_pct": "ft_percent", "fta": "fta_per_game", "tov": "tov_per_game", "pf": "pf_per_game"}
RADAR = (*PER_GAME, "pace", "x3p_ar")


def not_playoffs() -> Column:
    """FLT-04: IS NOT TRUE."""
    return ~F.coalesce(F.col("playoffs"), F.lit(False))


def conference(team: Column, east: tuple = EAST, west: tuple = WEST) -> Column:
    """PRJ-11."""
    return F.when(team.isin(*east), "East").when(team.isin(*west), "West").otherwise("")


def standings(seasons: DataFrame, season: int, summaries: DataFrame | None = None) -> DataFrame:
    """TEAM-01, WIN-04, WIN-08: the row with most wins of each team; ranks inside conferences, unknown ones overall.
    `summaries`: more of each such row, by team, season and playoffs."""
    rows = first_by(seasons.filter(F.col("season") == season), ["abbreviation"], [pg_desc("w"), pg_asc("playoffs")])
    more = [] if summaries is None else ["pw", "pl", "mov", "srs", "o_rtg", "d_rtg", "n_rtg", "pace", "ts_percent", "e_fg_percent", "tov_percent", "orb_percent"]
    if more:
        rows = rows.join(summaries.select("abbreviation", "season", "playoffs", *more), ["abbreviation", "season", "playoffs"], "left")
    rows = rows.withColumn("conference", conference(F.col("abbreviation"))).withColumn("win_pct", pct_or_zero(F.col("w"), F.col("w") + F.col("l")))
    order = [F.col("w").desc_nulls_last(), F.col("abbreviation").asc()]
    overall, inside = F.row_number().over(Window.orderBy(*order)), F.row_number().over(Window.partitionBy("conference").orderBy(*order))
    # One row for each team of one season: the overall window is as small as the league.
    return rows.select("abbreviation", "w", "l", "win_pct", "conference", F.when(F.col("conference") == "", overall).otherwise(inside).cast("int").alias("conference_rank"), *more)


def team_stats(per_game: DataFrame, season: int) -> DataFrame:
    """TEAM-02: offence, defence and the other values per game of the row with most games of each team, by points."""
    rows = first_by(per_game.filter(F.col("season") == season), ["abbreviation"], [pg_desc("g"), pg_asc("playoffs")])
    rest = ("fg_percent", "x3p_percent", "ft_percent", "trb_per_game", "ast_per_game", "stl_per_game", "blk_per_game", "tov_per_game", "pf_per_game", "fta_per_game")
    rows = rows.select(F.col("abbreviation").alias("team_abbr"), F.col("pts_per_game").alias("off_pts"), F.col("opp_pts_per_game").alias("def_pts"), "g", *rest)
    return rows.orderBy(F.desc("off_pts"), "team_abbr")


def team_ratios(seasons: DataFrame, season: int) -> DataFrame:
    """TEAM-03, PRJ-05, SRT-04."""
    rows = seasons.filter((F.col("season") == season) & not_playoffs())
    ratio = lambda a, b: rnd_decimal(safe_div(F.col(a), F.col(b)), 3)
    return rows.select("abbreviation", ratio("ast", "tov").alias("ast_tov"), ratio("stl", "pf").alias("stl_pf")).orderBy(F.col("ast_tov").desc_nulls_last(), "abbreviation")


def team_ratios_per_game(per_game: DataFrame, season: int) -> DataFrame:
    """TEAM-03 from the per-game table, with the values that the ratios are of."""
    rows = per_game.filter((F.col("season") == season) & not_playoffs())
    ratio = lambda a, b: rnd_decimal(F.col(a).cast("decimal(38,10)") / F.nullif(F.col(b).cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)")), 3)
    values = ("ast_per_game", "tov_per_game", "stl_per_game", "pf_per_game", "pts_per_game", "opp_pts_per_game", "g")
    out = rows.select(F.col("abbreviation").alias("team_abbr"), *values, ratio("ast_per_game", "tov_per_game").alias("ast_tov_ratio"), ratio("stl_per_game", "pf_per_game").alias("stl_pf_ratio"))
    return out.orderBy(F.col("ast_tov_ratio").desc_nulls_last(), "team_abbr")


def team_trend(splits: DataFrame, team: str) -> DataFrame:
    """TEAM-04."""
    rows = splits.filter((F.col("team_abbr") == team.upper()) & (F.col("split_type") == "total"))
    return rows.select("season", "pts", "plus_minus", "games", "reb", "ast", "stl", "blk").orderBy(pg_asc("season"))


def team_splits(splits: DataFrame, team: str, season: int) -> DataFrame:
    """SRC-16."""
    return splits.filter((F.col("team_abbr") == team.upper()) & (F.col("season") == season)).orderBy(pg_asc("split_type"))


def with_summaries(per_game: DataFrame, summaries: DataFrame) -> DataFrame:
    """JOIN-04: per-game rows with the pace and the share of threes of the same team, season and playoffs; a NULL meets nothing."""
    more = summaries.select("abbreviation", "season", "playoffs", "pace", "x3p_ar")
    return per_game.join(more, ["abbreviation", "season", "playoffs"], "left")


def team_radar(per_game: DataFrame, summaries: DataFrame, splits: DataFrame, season: int) -> DataFrame:
    """TEAM-05, FALL-01: of each team the non-playoff row, else any row, else its splits: one union, the least priority wins."""
    main = with_summaries(per_game.filter(F.col("season") == season), summaries)
    main = main.select("abbreviation", F.when(not_playoffs(), 1).otherwise(2).alias("priority"), "g", *(F.col(c).alias(name) for name, c in PER_GAME.items()), "pace", "x3p_ar")
    spare = splits.filter((F.col("season") == season) & (F.col("split_type") == "total"))
    have = ("reb", "ast", "stl", "blk", "fg_pct", "fg3_pct", "ft_pct")
    value = lambda c: F.col(c).cast("double").alias(c) if c in have or c == "pts" else F.lit(None).cast("double").alias(c)
    spare = spare.select(F.col("team_abbr").alias("abbreviation"), F.lit(3).alias("priority"), F.col("games").alias("g"), *(value(c) for c in RADAR))
    return first_by(main.unionByName(spare), ["abbreviation"], [F.col("priority").asc(), pg_desc("g")])


def radar_scaled(radar: DataFrame) -> DataFrame:
    """TEAM-07, PRJ-13: each axis with its maximum's direction: percentages up to 1 times 100, the maximum less the value
    where less is better, one decimal; NULL gives 0. Columns that a radar doesn't have are left out."""

    def axis(c: str, top: float) -> Column:
        value = F.when(F.col(c) <= 1, F.col(c) * 100).otherwise(F.col(c)) if c in PERCENTAGES else F.col(c)
        value = F.lit(top) - value if c in INVERTED else value
        return rnd_decimal(F.coalesce(value, F.lit(0.0)), 1).alias(c)

    return radar.select("abbreviation", *(axis(c, top) for c, top in AXES.items() if c in radar.columns))


def team_comparison(radar: DataFrame, one: str, two: str) -> DataFrame:
    """JOIN-12, AGG-21: a row for each metric with both teams' values, the axis' maximum (1.3 times the larger, 1 if
    that is not above 0) and the winner (PRJ-12)."""
    both = radar.filter(F.col("abbreviation").isin(one.upper(), two.upper()))
    found = {r.abbreviation for r in both.select("abbreviation").collect()}  # two names at most
    for team in (one, two):
        if team.upper() not in found:
            raise LookupError(f"no radar for team {team}")
    long = both.unpivot(["abbreviation"], list(RADAR), "metric", "value")
    pick = lambda team, name: F.max(F.when(F.col("abbreviation") == team.upper(), F.col("value"))).alias(name)
    out = long.groupBy("metric").agg(pick(one, "team1"), pick(two, "team2"))
    better = F.when(F.col("metric").isin(*INVERTED), winner(F.col("team1"), F.col("team2"), lower=True)).otherwise(winner(F.col("team1"), F.col("team2")))
    return out.select("metric", "team1", "team2", axis_max(F.col("team1"), F.col("team2")).alias("axis_max"), better.alias("winner"))


def axis_max(a: Column, b: Column) -> Column:
    """AGG-21."""
    top = F.greatest(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0)))
    return F.when(top > 0, top * 1.3).otherwise(1.0)


def league_average(per_game: DataFrame, summaries: DataFrame, season: int) -> DataFrame:
    """TEAM-06, AGG-06, FALL-02: over non-playoff rows, or over all rows if those have no points; one pass for both."""
    rows = with_summaries(per_game.filter(F.col("season") == season), summaries)
    names = PER_GAME | {"pace": "pace", "x3p_ar": "x3p_ar"}
    digits = lambda name: 4 if name in PERCENTAGES else 2
    avg = lambda name, cond: rnd_decimal(safe_div(F.sum(F.when(cond, F.col(names[name]))), F.count(F.when(cond, F.col(names[name])))), digits(name))
    both = rows.agg(*(avg(c, not_playoffs()).alias(f"r_{c}") for c in names), *(avg(c, F.lit(True)).alias(f"a_{c}") for c in names))
    return both.select(*(F.when(F.col("r_pts").isNotNull(), F.col(f"r_{c}")).otherwise(F.col(f"a_{c}")).alias(c) for c in names))
