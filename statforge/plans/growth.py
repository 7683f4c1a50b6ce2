"""Careers (GRW-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import POSITION_NAMES, first_by, lookup, pg_asc, pg_desc, rnd, rnd_decimal, safe_div
from .charts import COMBINED


def career_seasons(facts: DataFrame) -> DataFrame:
    """GRW-01, WIN-01: of each player and season the stint with most games."""
    rows = facts.filter(~F.col("team").isin(*COMBINED))
    return first_by(rows, ["player_id", "season"], [pg_desc("g"), pg_asc("team"), pg_asc("pos")])


#: Totals and what they are per game; percentages of a season; totals of a career by their names.
PER_GAME = ("mp", "pts", "trb", "ast", "stl", "blk", "tov", "pf")
PERCENTAGES = ("fg_percent", "x3p_percent", "ft_percent", "e_fg_percent")
TOTALS = {"g": "total_games", "gs": "total_games_started", "mp": "total_minutes", "pts": "total_points", "trb": "total_rebounds", "ast": "total_assists", "stl": "total_steals", "blk": "total_blocks", "tov": "total_turnovers"}


def career_per_game(facts: DataFrame) -> DataFrame:
    """GRW-02: of each season the stint with most games, per game."""
    per_game = lambda c: rnd_decimal(safe_div(F.col(c), F.col("g")), 2).alias(f"{c}_per_game")
    return career_seasons(facts).select("player_id", "season", "age", "team", "pos", "g", "gs", *map(per_game, PER_GAME), *PERCENTAGES)


def career_totals(facts: DataFrame, player: str) -> DataFrame:
    """AGG-04: always one row; sums are NULL without rows."""
    whole = lambda c, name: F.rint(F.sum(c)).cast("long").alias(name)
    rows = facts.filter((F.col("player_id") == player) & ~F.col("team").isin(*COMBINED))
    return rows.agg(F.count("*").alias("seasons"), *(whole(c, name) for c, name in TOTALS.items()), F.sum("ws").alias("total_win_shares"))


def career_summary(facts: DataFrame, players: DataFrame, player: str) -> DataFrame:
    """GRW-03: the player's bio and career totals; no row for an unknown player."""
    return players.filter(F.col("player_id") == player).crossJoin(F.broadcast(career_totals(facts, player)))  # one row each


def position_breakdown(facts: DataFrame, player: str) -> DataFrame:
    """GRW-04, AGG-05: totals, the means of per-season ratios, and the ratio of sums per 36, with the position's name
    and its share of the games (UI-03)."""
    rows = facts.filter((F.col("player_id") == player) & F.col("pos").isNotNull() & ~F.col("team").isin(*COMBINED))
    whole = lambda c, name: F.rint(F.sum(c)).cast("long").alias(name)
    mean = lambda c, name: rnd_decimal(F.avg(c), 2).alias(name)
    ratio = lambda c: safe_div(F.col(c), F.col("g"))
    totals = [whole(c, TOTALS[c]) for c in ("g", "gs", "mp", "pts", "trb", "ast", "stl", "blk")]
    out = rows.groupBy("pos").agg(F.count("*").alias("seasons"), *totals, mean(ratio("pts"), "ppg"), mean(ratio("trb"), "rpg"), mean(ratio("ast"), "apg"), mean(F.col("per"), "avg_per"), mean(F.col("usg_percent"), "avg_usg"), rnd_decimal(safe_div(F.sum("pts"), F.sum("mp")) * 36, 2).alias("pts_per_36"))
    share = rnd(safe_div(100 * F.col("total_games"), F.sum("total_games").over(Window.partitionBy())), 2)  # one player's positions
    return out.select("*", lookup(F.col("pos"), POSITION_NAMES).alias("pos_name"), share.alias("games_share")).orderBy(F.col("total_games").desc_nulls_first(), "pos")


def position_axes(positions: DataFrame) -> DataFrame:
    """UI-04: axis maxima of the five positions with most games: 1.2 times the largest value, or a default."""
    top = positions.orderBy(F.col("total_games").desc_nulls_first(), "pos").limit(5)
    #: Maxima where there is no value above 0.
    defaults = {"ppg": 30.0, "rpg": 15.0, "apg": 12.0, "avg_per": 35.0, "avg_usg": 40.0}
    return top.agg(*(F.coalesce(F.nullif(F.greatest(F.max(c), F.lit(0.0)) * 1.2, F.lit(0.0)), F.lit(d)).alias(c) for c, d in defaults.items()))


def growth_seasons(facts: DataFrame, team_seasons: DataFrame, player: str) -> DataFrame:
    """GRW-05/06, JOIN-05/06: each season's totals and per-game values, the name of the position, and the share of the
    team's points. The totals' own values win unless they are NULL; one join, not one query a season."""
    teams = first_by(team_seasons.filter(~F.coalesce("playoffs", F.lit(False))), ["abbreviation", "season"], [pg_desc("g")]).select(F.col("abbreviation").alias("team"), "season", F.col("pts").alias("team_pts"))
    mine = facts.filter(F.col("player_id") == player)
    totals, per_game = career_seasons(mine), career_per_game(mine).drop("player_id", "gs")
    shared = [c for c in per_game.columns if c in totals.columns and c != "season"]
    both = totals.join(per_game.select("season", *(F.col(c).alias(f"__{c}") if c in shared else F.col(c) for c in per_game.columns if c != "season")), "season", "left")
    rows = both.select("season", *(F.coalesce(c, f"__{c}").alias(c) for c in shared), *(c for c in totals.columns if c not in (*shared, "season", "player_id")), *(c for c in per_game.columns if c.endswith("_per_game")))
    rows = rows.join(teams, ["team", "season"], "left")
    known = (F.col("pts") > 0) & (F.col("team_pts") > 0)
    ppg = F.coalesce("pts_per_game", F.when(F.col("g") > 0, rnd(F.col("pts") / F.col("g"), 2)))
    columns = ("season", "age", "team", "pos", "g", "gs", "mp", "pts", "trb", "ast", "stl", "blk", "tov", "pf", "fg_percent", "x3p_percent", "ft_percent", "per", "ts_percent", "usg_percent", "ws", "bpm", "vorp")
    return rows.select(*columns, ppg.alias("pts_per_game"), *(f"{c}_per_game" for c in PER_GAME if c != "pts"), lookup(F.col("pos"), POSITION_NAMES).alias("pos_name"), "team_pts", F.when(known, rnd(100 * F.col("pts") / F.col("team_pts"), 2)).alias("scoring_share")).orderBy("season")


def milestones(seasons: DataFrame, breakout: float = 25.0) -> DataFrame:
    """GRW-07, AGG-20, WIN-11/12: (player_id, season, kind, value); each player's rows are together, in season order."""
    key = ["player_id"]
    peak = lambda c: F.max_by(F.struct("season", c), F.struct(F.coalesce(F.col(c), F.lit(0.0)), -F.col("season")))
    agg = seasons.groupBy(*key).agg(
        F.min("season").alias("first"), F.max("season").alias("last"), peak("pts").alias("p"), peak("per").alias("e"), peak("ws").alias("w"),
        F.min_by(F.struct("season", "per"), F.when(F.col("per") >= breakout, F.col("season"))).alias("b"),
    )
    none = F.lit(None).cast("string")
    row = lambda order, kind, season, value: F.struct(F.lit(order).alias("place"), F.lit(kind).alias("kind"), season.cast("int").alias("season"), value.cast("string").alias("value"))
    rows = F.array(row(0, "debut", F.col("first"), none), row(1, "peak_scoring", F.col("p.season"), F.col("p.pts")), row(2, "peak_per", F.col("e.season"), F.col("e.per")), row(3, "peak_ws", F.col("w.season"), F.col("w.ws")), row(4, "breakout", F.col("b.season"), F.col("b.per")), row(6, "current", F.col("last"), none))
    fixed = agg.select(*key, F.explode(rows).alias("m")).select(*key, "m.*").filter("season is not null")
    before = F.last("pos", ignorenulls=True).over(Window.partitionBy(*key).orderBy("season").rowsBetween(Window.unboundedPreceding, -1))
    moved = seasons.withColumn("__before", before).filter(F.col("pos") != F.col("__before"))
    moved = moved.select(*key, F.lit(5).alias("place"), F.lit("position_change").alias("kind"), F.col("season").cast("int").alias("season"), F.col("pos").alias("value"))
    return fixed.unionByName(moved).repartition(*key).sortWithinPartitions(*key, "season", "place")
