"""Status (SYS-02, SYS-05..07)."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import metric_names
from ..sources.catalog import ping, require_season, table_counts

_log = logging.getLogger("statforge.status")
_STARTED = time.time()


def split_counts(splits: DataFrame) -> DataFrame:
    """AGG-08: rows, distinct teams and seasons."""
    return splits.agg(F.count("*").alias("rows"), F.countDistinct("team_abbr").alias("teams"), F.countDistinct("season").alias("seasons"))


def total_records(counts: DataFrame) -> DataFrame:
    """AGG-10."""
    return counts.agg(F.sum("row_count").alias("total_records"))


def active_teams(mapping: DataFrame) -> DataFrame:
    return mapping.filter("is_active").agg(F.count("*").alias("active_teams"))


def top_scorers(splits: DataFrame, season: int, n: int = 10) -> DataFrame:
    """The n teams with most points of a season; a missing value counts as 0."""
    rows = splits.filter((F.col("season") == season) & (F.col("split_type") == "total"))
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return rows.orderBy(F.col("pts").desc_nulls_first(), "team_abbr").limit(n).select(F.col("team_abbr").alias("team"), number("pts"), "games", number("plus_minus"))


def recent_games(games: DataFrame, n: int = 10) -> DataFrame:
    """The n last games, the id as a tie-break, with their dates as ISO text (DATE-02)."""
    rows = games.filter("game_date is not null").orderBy(F.desc("game_date"), "game_id").limit(n)
    return rows.select("game_id", F.date_format("game_date", "yyyy-MM-dd").alias("date"), F.col("away_team_abbr").alias("away"), F.col("home_team_abbr").alias("home"), "away_pts", "home_pts")


def status_summary(spark: SparkSession, tables: dict[str, DataFrame], season: int) -> dict[str, object]:
    """SYS-02: tables, records, active teams, last game day, splits, top 10 and recent 10. The tables and records must
    be there; each other part may fail by itself, and then has its empty value."""
    require_season(season)
    counts = [r.asDict() for r in table_counts(spark, tables).collect()]  # one row a table
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  of API size: ten rows, or one
    parts: dict[str, tuple[object, Callable[[], object]]] = {
        "active_teams": (0, lambda: active_teams(tables["team_mapping"]).first()[0]),
        "last_game_date": (None, lambda: rows(tables["games"].agg(F.date_format(F.max("game_date"), "yyyy-MM-dd").alias("d")))[0]["d"]),
        "splits": ({"rows": 0, "teams": 0, "seasons": 0}, lambda: rows(split_counts(tables["team_splits"]))[0]),
        "top_scorers": ([], lambda: rows(top_scorers(tables["team_splits"], season))),
        "recent_games": ([], lambda: rows(recent_games(tables["games"]))),
    }
    out = {"tables": counts, "total_tables": len(counts), "total_records": sum(r["row_count"] for r in counts), "season": season}
    for name, (empty, part) in parts.items():
        try:
            out[name] = part()
        except Exception as e:  # noqa: BLE001  a status page shows what there is
            _log.warning("no %s: %s", name, e)
            out[name] = empty
    return out


@contextmanager
def tagged(spark: SparkSession, request_id: str):
    """SYS-06: jobs inside carry the request's id."""
    spark.addTag(request_id)
    try:
        yield
    finally:
        spark.removeTag(request_id)


def guard(checks: dict[str, Callable[[], bool]]) -> dict[str, bool]:
    """SYS-05: each check by name; one that raises has failed."""
    out = {}
    for name, check in checks.items():
        try:
            out[name] = bool(check())
        except Exception as e:  # noqa: BLE001
            _log.warning("check %s: %s", name, e)
            out[name] = False
    return out


def uptime_text(seconds: float) -> str:
    h, rest = divmod(int(seconds), 3600)
    m, s = divmod(rest, 60)
    return f"{h}h {m}m {s}s" if h else f"{m}m {s}s" if m else f"{s}s"


def monitor_stats(spark: SparkSession, now: float | None = None) -> dict[str, object]:
    """SYS-07: uptime, whether queries run, and how many metrics there are."""
    up = (time.time() if now is None else now) - _STARTED
    return {"uptime_seconds": round(up, 2), "uptime_display": uptime_text(up), "database": {"connected": ping(spark)}, "metrics_registered": len(metric_names())}
