"""Late-clock shots from ordered events (EVT-01, EVT-02), by a scan of each game in chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import pct_or_zero

SHOTS = ("Made Shot", "Missed Shot")
TYPES = (*SHOTS, "Rebound", "Turnover")


def _elapsed(start: Column, clock: Column) -> Column:
    """0 where either clock is NULL or 0 (NUL-03)."""
    none = lambda c: c.isNull() | (c == 0)
    return F.when(none(start) | none(clock), 0.0).otherwise(start - clock)


#: Event numbers of a game that one window goes over; unique numbers make it the rows as well.
CHUNK = 4096


def _summaries(rows: DataFrame) -> DataFrame:
    """What each chunk does to the state, whatever it was before: (__game, __chunk, __resets, __reset, __first).

    __reset: the clock of its last reset, in a struct; __first: the first clock of a shot after it."""
    shots = F.col("__shot") & F.col("clock_seconds").isNotNull()
    found = rows.groupBy("__game", "__chunk").agg(
        F.sum(F.col("__reset").cast("int")).alias("__resets"),
        F.max(F.when(F.col("__reset"), F.struct("__at", F.struct("clock_seconds").alias("clock")))).alias("__last"),
        F.max(F.when(shots, F.struct("__seg", (-F.col("__at")).alias("at"), "clock_seconds"))).alias("__best"),
    )
    first = F.when(F.col("__best.__seg") == F.col("__resets"), F.col("__best.clock_seconds"))
    return found.select("__game", "__chunk", (F.col("__resets") > 0).cast("int").alias("__resets"), F.col("__last.clock").alias("__reset"), first.alias("__first"))


def _handed_on(summaries: DataFrame) -> DataFrame:
    """The state in which each chunk begins: (__game, __chunk, __in_reset, __in_first), from the chunks before."""
    upto = Window.partitionBy("__game").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, 0)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    rows = summaries.withColumn("__era", F.sum("__resets").over(upto))
    # Of the latest era so far, the first chunk that has a shot's clock.
    best = F.max(F.when(F.col("__first").isNotNull(), F.struct("__era", (-F.col("__chunk")).alias("chunk"), "__first"))).over(before)
    rows = rows.withColumn("__best", best).withColumn("__was", F.sum("__resets").over(before))
    first = F.when(F.col("__best.__era") == F.col("__was"), F.col("__best.__first"))
    return rows.select("__game", "__chunk", F.last("__reset", ignorenulls=True).over(before).alias("__in_reset"), first.alias("__in_first"))


def shots_with_elapsed(events: DataFrame, keep_first_shot: bool, chunk: int = CHUNK) -> DataFrame:
    """Shots with the time since their possession began.

    Rebounds, turnovers and made shots set the state to their clock. keep_first_shot (the team variant):
    a shot without state gives its own clock to the state; the player variant doesn't.

    A game is scanned in chunks of `chunk` event numbers, each by itself. A chunk's effect on the state is one row;
    only these rows of a game meet in one window, and hand each chunk the state that it begins in."""
    ev = events.filter(F.col("event_type").isin(*TYPES))
    own = F.floor(F.col("eventnum") / chunk).cast("long")
    ev = ev.withColumns(
        {
            "__game": F.coalesce(F.concat(F.lit("g"), F.col("gameid").cast("string")), F.lit("-")),
            "__chunk": F.coalesce(own, F.lit(-(1 << 62)).cast("long")),
            "__reset": F.col("event_type").isin("Rebound", "Turnover", "Made Shot"),
            "__shot": F.col("event_type").isin(*SHOTS),
        }
    )
    order = Window.partitionBy("__game", "__chunk").orderBy("eventnum")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    clock = F.struct("clock_seconds")
    ev = ev.withColumn("__at", F.row_number().over(order)).withColumn("__seg", F.coalesce(F.sum(F.col("__reset").cast("int")).over(before), F.lit(0)))
    ev = ev.withColumn("__last", F.last(F.when(F.col("__reset"), clock), ignorenulls=True).over(before))
    best = F.when(F.col("__shot") & F.col("clock_seconds").isNotNull(), F.struct("__seg", (-F.col("__at")).alias("at"), "clock_seconds"))
    ev = ev.withColumn("__best", F.max(best).over(upto))
    ev = ev.join(_handed_on(_summaries(ev)), ["__game", "__chunk"])
    start = F.coalesce("__last", "__in_reset")["clock_seconds"]
    if keep_first_shot:
        here = F.when(F.col("__best.__seg") == F.col("__seg"), F.col("__best.clock_seconds"))
        start = F.coalesce(start, F.when(F.col("__seg") == 0, F.coalesce("__in_first", here)).otherwise(here))
    out = ev.withColumn("elapsed", _elapsed(start, F.col("clock_seconds"))).filter("__shot")
    return out.select(*events.columns, "elapsed")


def _tallies(late_from: float) -> list[Column]:
    late, made = F.col("elapsed") >= late_from, F.col("event_type") == "Made Shot"
    points = F.when(F.col("subtype").contains("3"), 3).otherwise(2)
    count = lambda c, v=1: F.sum(F.when(c, v).otherwise(0)).cast("long")
    return [
        F.count("*").alias("total_shots"), count(late).alias("late_shots"), count(~late).alias("early_shots"),
        count(late & made).alias("late_made"), count(~late & made).alias("early_made"), count(made, points).alias("points"), count(late & made, points).alias("late_points"),
    ]


def _percent(df: DataFrame) -> DataFrame:
    p = lambda a, b: pct_or_zero(100.0 * F.col(a), F.col(b), 1)
    return df.withColumns({"late_pct": p("late_shots", "total_shots"), "late_fg_pct": p("late_made", "late_shots"), "early_fg_pct": p("early_made", "early_shots")})


def late_clock_teams(events: DataFrame, late_from: float = 20.0) -> DataFrame:
    """CHRT-06, AGG-12: shots without a team move the state but aren't counted."""
    shots = shots_with_elapsed(events, True).filter(F.coalesce("team", F.lit("")) != "")
    return _percent(shots.groupBy("team").agg(*_tallies(late_from))).orderBy(F.desc("total_shots"), "team")


def late_clock_players(events: DataFrame, late_from: float = 20.0, min_shots: int = 50) -> DataFrame:
    """CHRT-07, AGG-13: by player name; the team last seen; at least min_shots."""
    shots = shots_with_elapsed(events, False).filter(F.trim(F.coalesce("player", F.lit(""))) != "")
    team = F.max_by(F.col("team"), F.when(F.coalesce("team", F.lit("")) != "", F.struct("gameid", "eventnum"))).alias("team")
    return _percent(shots.groupBy("player").agg(team, *_tallies(late_from)).filter(F.col("total_shots") >= min_shots)).orderBy(F.desc("late_pct"), "player")
