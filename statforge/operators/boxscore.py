"""Box scores from events and from game logs (EVT-03/04, AGG-03, AGG-14..16, FUZZ-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import assisted_by, first_by, first_text, last_name, pct_or_zero, substituted_in

STATS = ("pts", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "reb", "oreb", "dreb", "ast", "stl", "blk", "tov", "pf")
#: Event types that only carry steals and blocks.
NEUTRAL = ("period", "Jump Ball", "Timeout", "End of Game", "")
_GIVE = "array<struct<player:string,team:string,stat:string,n:int,detail:string>>"


def latest_gamelog(log: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """WIN-03: the newest import of each (game, player); a NULL time counts as the newest."""
    return first_by(log.filter("br_player_id is not null"), ["gameid", "br_player_id"], [F.col("created_at").desc_nulls_first(), *(F.col(t).asc_nulls_last() for t in ties)])


#: Columns of a game log that stand for one value, the first that isn't NULL.
DUAL = {"team": ("team_abbreviation", "team"), "reb": ("reb", "trb"), "oreb": ("oreb", "orb"), "dreb": ("dreb", "drb"), "fgm": ("fgm", "fg"), "fga": ("fga",), "fg3m": ("tpm", "fg3"), "fg3a": ("tpa", "fga3"), "ftm": ("ftm", "ft"), "player_name": ("player_name", "player")}


def one_vocabulary(log: DataFrame) -> DataFrame:
    """PRJ-01, PRJ-02: a game log with one column for each of DUAL; what it has under neither name is NULL."""
    types = {"team": "string", "player_name": "string"}
    for name, names in DUAL.items():
        have = [F.col(c) for c in names if c in log.columns]
        log = log.withColumn(name, F.coalesce(*have) if have else F.lit(None).cast(types.get(name, "double")))
    return log


def team_box(log: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """AGG-03: 15 sums and 3 percentages of each team over the newest rows; a NULL team is ''."""
    rows = one_vocabulary(latest_gamelog(log, ties)).withColumn("team", F.coalesce("team", F.lit("")))
    out = rows.groupBy("gameid", "team").agg(*(F.sum(c).alias(c) for c in STATS))
    return out.select("*", *(pct_or_zero(F.col(f"{c}m"), F.col(f"{c}a")).alias(f"{c}_pct") for c in ("fg", "fg3", "ft")))


def _give(player: Column, stat: str, n: Column | int = 1, team: Column | None = None, detail: Column | None = None) -> Column:
    return F.struct(player.alias("player"), (F.col("__team") if team is None else team).alias("team"), F.lit(stat).alias("stat"), (n if isinstance(n, Column) else F.lit(n)).cast("int").alias("n"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))


def contributions(events: DataFrame) -> DataFrame:
    """One row for each thing an event adds to a player's period: (gameid, eventnum, period, player, team, stat, n, detail)."""
    kind, me = F.coalesce("event_type", F.lit("")), F.col("player")
    ev = events.withColumn("__text", first_text(*(c for c in ("description", "homedescription", "visitordescription") if c in events.columns)))
    ev = ev.withColumn("__low", F.lower("__text")).withColumn("__team", F.coalesce("team", F.lit("")))
    has = lambda s: F.col("__low").contains(s)
    three = has("3-pt") | has("3pt")
    no = F.array().cast(_GIVE)
    some = lambda cond, *gives: F.when(cond, F.array(*gives)).otherwise(no)
    steals = F.concat(some(has("steal by"), _give(me, "stl")), some(has("block by"), _give(me, "blk")))
    helper = assisted_by(F.col("__text"))
    made = F.concat(
        F.array(_give(me, "fgm"), _give(me, "fga"), _give(me, "pts", F.when(three, 3).otherwise(2)), _give(me, "made_shots", 0, detail=F.col("__text"))),
        some(three, _give(me, "fg3m"), _give(me, "fg3a")),
        some(has("assist") & helper.isNotNull(), _give(helper, "ast")),
    )
    missed = F.concat(F.array(_give(me, "fga"), _give(me, "missed_shots", 0, detail=F.col("__text"))), some(three, _give(me, "fg3a")))
    throws = F.concat(F.array(_give(me, "fta"), _give(me, "ft_details", 0, detail=F.col("__text"))), some(has("make"), _give(me, "ftm"), _give(me, "pts")))
    rebounds = F.array(_give(me, "reb"), F.when(has("offensive"), _give(me, "oreb")).otherwise(_give(me, "dreb")))
    clock = F.col("clock_seconds").cast("string")
    subs = F.concat(F.array(_give(me, "time_out", 0, detail=clock)), some(substituted_in(F.col("__text")).isNotNull(), _give(substituted_in(F.col("__text")), "time_in", 0, detail=clock)))
    gives = (
        F.when(F.col("period").isNull() | kind.isin(*NEUTRAL), steals)
        .when(kind == "Made Shot", made).when(kind == "Missed Shot", missed).when(kind == "Free Throw", throws).when(kind == "Rebound", rebounds)
        .when(kind == "Turnover", F.array(_give(me, "tov"), _give(me, "tov_details", 0, detail=F.col("__text"))))
        .when(kind == "Foul", F.array(_give(me, "pf"), _give(me, "foul_details", 0, detail=F.col("__text"))))
        .when(kind == "Substitution", subs).otherwise(no)
    )
    ev = ev.filter(F.coalesce("player", F.lit("")) != "")
    return ev.select("gameid", "eventnum", F.coalesce("period", F.lit(1)).alias("period"), F.explode(gives).alias("g")).select("gameid", "eventnum", "period", "g.*")


def player_periods(events: DataFrame, with_details: bool = False) -> DataFrame:
    """EVT-03, AGG-15, ARR-01: counters of each (player, team, period) of a game, and detail lists on demand."""
    given = contributions(events)
    stat = lambda s: F.sum(F.when(F.col("stat") == s, F.col("n")).otherwise(0)).cast("long").alias(s)
    aggs = [stat(s) for s in STATS]
    if with_details:
        listed = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("stat") == s, F.struct("eventnum", "detail")))), lambda x: x["detail"]).alias(s)
        first = lambda s: F.min_by(F.col("detail"), F.when((F.col("stat") == s) & F.col("detail").isNotNull(), F.col("eventnum"))).alias(s)
        aggs += [listed(s) for s in ("made_shots", "missed_shots", "ft_details", "foul_details", "tov_details")] + [first("time_in"), first("time_out")]
    return given.groupBy("gameid", "player", "team", "period").agg(*aggs)


def player_totals(periods: DataFrame) -> DataFrame:
    """AGG-16: over periods."""
    return periods.groupBy("gameid", "team", "player").agg(*(F.sum(s).alias(s) for s in STATS)).orderBy("gameid", F.desc("pts"), "team", "player")


def team_box_from_events(events: DataFrame) -> DataFrame:
    """EVT-04, AGG-14: as player_periods, but no assists; steals and blocks only for events without a type."""
    kept = contributions(events.filter(F.coalesce("event_type", F.lit("")).isin("", "Made Shot", "Missed Shot", "Free Throw", "Rebound", "Turnover", "Foul")))
    stat = lambda s: F.sum(F.when(F.col("stat") == s, F.col("n")).otherwise(0)).cast("long").alias(s)
    out = kept.filter("stat <> 'ast'").groupBy("gameid", "team").agg(*(stat(s) for s in STATS if s != "ast"))
    return out.select("*", *(pct_or_zero(F.col(f"{c}m"), F.col(f"{c}a")).alias(f"{c}_pct") for c in ("fg", "fg3", "ft")))


#: Detail lists of player_periods.
DETAILS = ("made_shots", "missed_shots", "ft_details", "foul_details", "tov_details")


def flat_details(periods: DataFrame) -> DataFrame:
    """ARR-02: the detail lists of each player over the periods, in order, each entry with its period."""
    tagged = lambda c: F.transform(F.col(c), lambda x: F.struct(F.col("period").alias("period"), x.alias("detail")))
    in_order = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("period", tagged(c).alias("x")))), lambda x: x["x"])).alias(c)
    return periods.groupBy("gameid", "team", "player").agg(*(in_order(c) for c in DETAILS))


def performance(events: DataFrame, log: DataFrame, with_details: bool = True) -> DataFrame:
    """GAME-05, AGG-15/16: periods, with details on demand, and beside them each player's row of the game log (FUZZ-01):
    its id, matched_id, and the whole record, log_pts and so on; preferred_totals() takes it."""
    periods = player_periods(events, with_details)
    ids = events.filter("br_player_id is not null").groupBy("gameid", "player", F.coalesce("team", F.lit("")).alias("team")).agg(F.min("br_player_id").alias("br_player_id"))
    who = periods.select("gameid", "player", "team").distinct().join(ids, ["gameid", "player", "team"], "left")
    log = one_vocabulary(log)
    matched = match_gamelog(who, log).select("gameid", "player", "team", "matched_id")
    has = lambda s: F.col(s) if s in log.columns else F.lit(None).cast("double")
    own = log.select("gameid", F.col("br_player_id").alias("matched_id"), *(has(s).alias(f"log_{s}") for s in STATS))
    return periods.join(matched, ["gameid", "player", "team"], "left").join(own, ["gameid", "matched_id"], "left")


def preferred_totals(played: DataFrame) -> DataFrame:
    """AGG-16: totals of each player from performance(). A player with a row in the game log has that record, the whole
    of it, with 0 for what it lacks; any other the sums over periods. from_log says which."""
    mine = [F.sum(s).alias(s) for s in STATS]
    record = [F.max(f"log_{s}").alias(f"log_{s}") for s in STATS]  # the same in each period
    out = played.groupBy("gameid", "team", "player").agg(F.max("matched_id").alias("matched_id"), *mine, *record)
    there = F.col("matched_id").isNotNull()
    chosen = [F.when(there, F.coalesce(F.col(f"log_{s}").cast("double"), F.lit(0.0))).otherwise(F.col(s).cast("double")).alias(s) for s in STATS]
    return out.select("gameid", "team", "player", "matched_id", there.alias("from_log"), *chosen).orderBy("gameid", "team", F.desc("pts"), "player")


#: What a candidate of the same last name scores.
ASSISTS, STEALS, BLOCKS, SAME_TEAM = 10, 2, 2, 1


def match_gamelog(players: DataFrame, log: DataFrame) -> DataFrame:
    """FUZZ-01, JOIN-09: players(gameid, player, team, br_player_id) with the game log's id, by id, else by last name.

    One candidate of that name is taken whatever its team; of several the best score wins, ties to the
    smaller id."""
    ids = log.select("gameid", F.col("br_player_id").alias("matched_id"))
    exact = players.join(ids, (players.gameid == ids.gameid) & (players.br_player_id == ids.matched_id), "left").drop(ids.gameid)
    found, rest = exact.filter("matched_id is not null"), exact.filter("matched_id is null").drop("matched_id").withColumn("__last", last_name(F.col("player")))
    cand = log.select(F.col("gameid").alias("__game"), F.col("br_player_id").alias("matched_id"), last_name(F.col("player_name")).alias("__cand"), F.col("team").alias("__cteam"), *(F.coalesce(c, F.lit(0)).alias(f"__{c}") for c in ("ast", "stl", "blk")))
    both = rest.join(cand, (rest.gameid == cand["__game"]) & (F.col("__last") == F.col("__cand")) & (F.col("__last") != ""), "left")
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    score = points(F.col("__ast") > 0, ASSISTS) + points(F.col("__stl") > 0, STEALS) + points(F.col("__blk") > 0, BLOCKS) + points(F.upper("team") == F.upper("__cteam"), SAME_TEAM)
    w = Window.partitionBy("gameid", "player", "team").orderBy(F.desc_nulls_last("__score"), F.asc_nulls_last("matched_id"))
    best = both.withColumn("__score", score).withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    return found.unionByName(best.select(found.columns))
