"""Games (GAME-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import winner
from ..operators.boxscore import team_box, team_box_from_events
from .teams import axis_max

#: Fields of a radar, those that events may fill, and a side's column where its name differs.
RADAR = ("pts", "reb", "ast", "stl", "blk", "fg_pct", "fg3_pct", "ft_pct", "tov", "pf", "oreb", "dreb", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta")
FROM_EVENTS = ("reb", "ast", "stl", "blk", "tov", "pf", "oreb", "dreb", "fg3m", "fg3a", "ftm", "fta", "fg3_pct", "ft_pct")
SIDE_COLUMNS = {"fg3a": "fga3"}


def games_page(games: DataFrame, season: int | None = None, page: int = 1, size: int = 50) -> DataFrame:
    """GAME-01: newest first, the id as a tie-break; size is 200 at most."""
    size = max(1, min(size, 200))
    out = games if season is None else games.filter(F.col("season") == season)
    return out.orderBy(F.col("game_date").desc_nulls_last(), "game_id").offset((max(1, page) - 1) * size).limit(size)


def quarter_recent(games: DataFrame, team: str, limit: int = 10) -> DataFrame:
    """GAME-02: games of a team on either side that have quarter scores."""
    side = (F.col("home_team_abbr") == team.upper()) | (F.col("away_team_abbr") == team.upper())
    return games.filter(side & F.col("home_q1").isNotNull()).orderBy(F.col("game_date").desc_nulls_first(), "game_id").limit(min(limit, 100))


def game_detail(games: DataFrame, game_id: str) -> DataFrame:
    """GAME-06, SRC-15: every row of the id, which is a game's own."""
    return games.filter(F.col("game_id") == game_id)


def play_by_play(events: DataFrame, game_id: str) -> DataFrame:
    """GAME-04, SRC-14."""
    return events.filter(F.col("gameid") == game_id).orderBy(F.col("eventnum").asc_nulls_last())


#: Values without which a game's events may be asked.
NEEDED = ("reb", "ast", "tov", "pf")


def sides(games: DataFrame) -> DataFrame:
    """Two rows for each game: (gameid, side, team, *RADAR) from its columns; what it lacks is NULL. __lacks: one of the
    game's sides, which are one row still, lacks a value of NEEDED."""
    none = [F.col(c).isNull() if (c := f"{name}_{n}") in games.columns else F.lit(True) for name in ("home", "away") for n in NEEDED]
    lacks = reduce(lambda a, b: a | b, none)

    def side(name: str) -> DataFrame:
        column = lambda c: f"{name}_{SIDE_COLUMNS.get(c, c)}"
        value = lambda c: (F.col(column(c)).cast("double") if column(c) in games.columns else F.lit(None).cast("double")).alias(c)
        return F.struct(F.lit(name).alias("side"), F.col(f"{name}_team_abbr").alias("team"), *(value(c) for c in RADAR))

    return games.select(F.col("game_id").alias("gameid"), lacks.alias("__lacks"), F.explode(F.array(side("home"), side("away"))).alias("s")).select("gameid", "__lacks", "s.*")


def game_radar(games: DataFrame, log: DataFrame, events: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """GAME-03, JOIN-10: both sides of each game, each value overridden by the one that the game log has.

    Events fill NULLs of FROM_EVENTS only, and only in games without any game log where a side lacks reb, ast, tov or
    pf. The log and the events are cut down to the games first."""
    base = sides(games)
    ours = games.select(F.col("game_id").alias("gameid"))
    log, events = log.join(ours, "gameid", "left_semi"), events.join(ours, "gameid", "left_semi")
    from_log = team_box(log, ties).select("gameid", "team", *(F.col(c).alias(f"__l_{c}") for c in RADAR))
    box = team_box_from_events(events)
    from_events = box.select("gameid", "team", *((F.col(c) if c in box.columns else F.lit(None).cast("long")).alias(f"__e_{c}") for c in FROM_EVENTS))
    gate = log.select("gameid").distinct().withColumn("__logged", F.lit(True))
    out = base.join(from_log, ["gameid", "team"], "left").join(from_events, ["gameid", "team"], "left").join(gate, "gameid", "left")
    use_events = F.col("__logged").isNull() & F.col("__lacks")
    spare = lambda c: [F.when(use_events, F.col(f"__e_{c}").cast("double"))] if c in FROM_EVENTS else []
    value = lambda c: F.coalesce(F.col(f"__l_{c}").cast("double"), F.col(c), *spare(c)).alias(c)
    return out.select("gameid", "side", "team", *(value(c) for c in RADAR))


def radar_axes(radar: DataFrame) -> DataFrame:
    """AGG-21, PRJ-12/13 of a game: for each value both sides', the axis' maximum and the winner; percentages times 100."""
    fields = ("pts", "reb", "ast", "stl", "blk", "fg_pct", "fg3_pct", "ft_pct", "tov", "pf")
    long = radar.select("gameid", "side", *fields).unpivot(["gameid", "side"], list(fields), "metric", "value")
    scaled = F.when(F.col("metric").endswith("_pct"), F.col("value") * 100).otherwise(F.col("value"))
    pick = lambda side: F.max(F.when(F.col("side") == side, scaled)).alias(side)
    out = long.groupBy("gameid", "metric").agg(pick("home"), pick("away"))
    less = F.col("metric").isin("tov", "pf")
    one, two = F.col("home"), F.col("away")
    return out.select("gameid", "metric", "home", "away", axis_max(one, two).alias("axis_max"), F.when(less, winner(one, two, lower=True)).otherwise(winner(one, two)).alias("winner"))
