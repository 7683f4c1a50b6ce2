"""Edge frames of the plans, guards and exports."""

import json
import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from statforge import registered
from statforge.functions import exprs as ex
from statforge.operators import boxscore, metrics
from statforge.plans import charts, context, export, games, growth, system, teams
from statforge.sources import catalog
from statforge.sources.roles import role

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_text_helpers(spark):
    t = lambda f, s: one(spark, f(F.col("s")), s=s)
    assert t(ex.substituted_in, "SUB: Al Bo FOR Cy") == "Al Bo"
    assert t(ex.assisted_by, "shot (Assist by A. Player)") == "A"
    assert t(ex.assisted_by, "no help") is None
    assert t(ex.assisted_by, "x Assisted by (B(c), d") == "(B(c)" and t(ex.assisted_by, "assist by  D, E. (f)") == "D"
    assert t(ex.last_name, "Gary Payton II") == "payton"
    assert t(ex.clock_text, "PT11M09.00S") == "11:09"
    assert one(spark, ex.season_label(F.lit(2000)), s="x") == "1999-00"
    assert one(spark, ex.rnd(F.col("v"), 1), v=0.25) == 0.2


def test_guards(spark):
    for bad in ("2000", 1800, True):
        with pytest.raises(ValueError):
            catalog.require_season(bad)
    for bad in ("", "  ( ", "DELETE FROM x", "SHOW TABLES", "CREATE TABLE t (a INT)", "VACUUM t", "SELECT 1; DROP TABLE x"):
        with pytest.raises(ValueError):
            catalog.read_only(spark, bad)
    assert catalog.read_only(spark, "SELECT 2 AS a", "query-9").first().a == 2 and "query-9" in spark.getTags()
    assert catalog.read_only(spark, "SELECT replace('axa', 'x', 'y') AS a", "query-10").first().a == "aya"
    assert {"query-9", "query-10"} & set(spark.getTags()) == {"query-10"}
    spark.clearTags()
    with pytest.raises(ValueError):
        catalog.in_list("a", [])
    df = spark.createDataFrame([(1, "x")], "season int, team string")
    assert catalog.drift(df, catalog.TableSchema("t", "season", "player_id", {"season": "bigint"})) == ["t: no column player_id", "t: season is int, not bigint"]
    assert catalog.ping(spark)


def test_semi_join_keeps_rows_once(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    assert catalog.load_by_ids(df, "id", ["a", "a"]).count() == 1
    assert catalog.load_by_ids(df, "id", ["a"] * 3 + [str(i) for i in range(600)]).count() == 1
    with pytest.raises(ValueError):
        catalog.load_gamelog(spark.createDataFrame([(2000, "x")] * 3, "season int, br_player_id string"), 2000, row_cap=2)


def test_box_plot(spark):
    rows = lambda *v: spark.createDataFrame([(2000, float(x), 1.0) for x in v], "season int, pts double, g double")
    got = charts.scoring_distribution(rows(1, 2, 3, 4), 2000).first()
    assert (got.min, got.q1, got["median"], got.q3, got.max, got.total) == (1.0, 1.75, 2.5, 3.25, 4.0, 4)
    assert charts.scoring_distribution(rows(), 2000).first().max == 0.0


def test_stint_without_combined_rows(spark):
    rows = [("p", 2000, "TOT", "G", 80), ("p", 2000, "AAA", "G", 30), ("p", 2000, "BBB", "G", 50)]
    df = spark.createDataFrame(rows, "player_id string, season int, team string, pos string, g int")
    assert charts.one_stint(df, 2000).first().team == "BBB"
    assert growth.career_seasons(df).first().team == "BBB"


def test_trend(spark):
    rows = [("two", 1, 1.0), ("two", 2, 3.0), ("flat", 1, 5.0), ("flat", 2, 5.0), ("flat", 3, 5.0), ("one", 1, 1.0), ("four", 1, 1.0), ("four", 2, 1.0), ("four", 3, 2.0), ("four", 4, 4.0), ("none", 1, None)]
    got = {r.player_id: r for r in context.metric_trend(spark.createDataFrame(rows, "player_id string, season int, value double"), 4).collect()}
    assert (got["two"].slope, got["two"].prediction, got["two"].momentum) == (2.0, 9.0, None)
    assert (got["flat"].r2, got["flat"].direction) == (0.0, "flat")
    assert got["one"].direction == "insufficient_data" and got["four"].momentum == 1.5 and "none" not in got


def test_evolution(spark):
    rows = [("p", 1, 1.0, 0.0), ("p", 2, 2.0, 4.0), ("q", 1, 1.0, 1.0)]
    ev = context.role_evolution(spark.createDataFrame(rows, "player_id string, season int, a double, b double"), ["a", "b"])
    got = {r.metric: r for r in ev.collect()}
    assert set(got) == {"a", "b"} and got["a"].pct_change == 100.0 and got["b"].pct_change is None and got["b"].direction == "up"
    assert context.role_shift(ev, ["a", "b"]).first().role_shift == pytest.approx(1 - 2 / (1 * 20**0.5), abs=1e-4)
    assert [r.metric for r in context.top_movers(ev).collect()] == ["a"]


def test_similar_edge_cases(spark):
    df = spark.createDataFrame([("t", 1.0, 2.0), ("a", 2.0, 1.0), ("b", None, 1.0), ("c", 0.0, 3.0)], "player_id string, x double, y double")
    assert [r.player_id for r in context.similar_players(df, "t", ["x", "y"]).collect()] != [] and "b" not in [r.player_id for r in context.similar_players(df, "t", ["x", "y"]).collect()]
    assert context.similar_players(df, "b", ["x", "y"]).collect() == []
    assert context.similar_players(df, "nobody", ["x", "y"]).collect() == []


def per_game(spark, *rows):
    """Rows of (abbreviation, playoffs, g, points); the other values follow from the points."""
    columns = [c for c in teams.PER_GAME.values() if c != "pts_per_game"]
    data = [(a, 1, p, g, pts, *(None if pts is None else pts / (i + 2) for i in range(len(columns)))) for a, p, g, pts in rows]
    return spark.createDataFrame(data, "abbreviation string, season int, playoffs boolean, g int, pts_per_game double, " + ", ".join(f"{c} double" for c in columns))


def test_radar_fallback(spark):
    df = per_game(spark, ("A", True, 9, 90.0), ("A", False, 3, 60.0), ("B", True, 2, 40.0), ("D", None, 1, None))
    more = spark.createDataFrame([("A", 1, False, 99.0, 0.25), ("B", 1, False, 98.0, 0.5), ("D", 1, None, 97.0, 60.0)], "abbreviation string, season int, playoffs boolean, pace double, x3p_ar double")
    sp = spark.createDataFrame([("A", 1, "total", 9, 1.0), ("C", 1, "total", 7, 8.0)], "team_abbr string, season int, split_type string, games int, pts double")
    sp = sp.select("*", *(F.lit(0.5).alias(c) for c in ("reb", "ast", "stl", "blk", "fg_pct", "fg3_pct", "ft_pct")))
    radar = teams.team_radar(df, more, sp, 1)
    got = {r.abbreviation: (r.priority, r.g, r.pts, r.pace) for r in radar.collect()}
    assert got == {"A": (1, 3, 60.0, 99.0), "B": (2, 2, 40.0, None), "C": (3, 7, 8.0, None), "D": (1, 1, None, None)}
    scaled = {r.abbreviation: r for r in teams.radar_scaled(radar).collect()}
    tov = 60.0 / (2 + [c for c in teams.PER_GAME.values() if c != "pts_per_game"].index("tov_per_game"))
    assert (scaled["A"].x3p_ar, scaled["A"].tov, scaled["C"].fg_pct, scaled["D"].pts, scaled["D"].tov) == (25.0, round(20 - tov, 1), 50.0, 0.0, 0.0)
    pair = {r.metric: (r.team1, r.team2, round(r.axis_max, 6), r.winner) for r in teams.team_comparison(radar, "a", "B").collect()}
    assert pair["pts"] == (60.0, 40.0, 78.0, 1) and pair["tov"][3] == 2 and pair["pace"] == (99.0, None, 128.7, None) and len(pair) == 13
    with pytest.raises(LookupError):
        teams.team_comparison(radar, "A", "Z")
    assert teams.league_average(df.filter("playoffs"), more, 1).first().pts == 65.0 and teams.league_average(df, more, 1).first().pts == 60.0


def test_standings(spark):
    s = "abbreviation string, season int, playoffs boolean, g int, w int, l int"
    df = spark.createDataFrame([("A", 1, True, 9, 1, 1), ("A", 1, False, 3, 1, 2), ("B", 1, True, 2, 2, 0), ("D", 1, None, 0, None, 0)], s)
    rank = {r.abbreviation: (r.win_pct, r.conference_rank) for r in teams.standings(df, 1).collect()}
    assert rank["B"] == (1.0, 1) and rank["D"][0] == 0.0


def test_game_radar_sources(spark):
    """The log wins where it has a value, events fill only games without a log that lack something."""
    sides = [f"{side}_{c} double" for side in ("home", "away") for c in ("pts", "reb", "fg_pct")]
    games_ = spark.createDataFrame([("g", "A", "B", 9.0, None, 0.5, 8.0, 3.0, 0.4), ("h", "A", "B", 7.0, None, 0.4, 6.0, 2.0, None)], f"game_id string, home_team_abbr string, away_team_abbr string, {', '.join(sides)}")
    log = spark.createDataFrame([("g", "1", 1, "A", 10.0, None, 4.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 4.0, 5.0)], "gameid string, br_player_id string, created_at int, team string, pts double, reb double, trb double, ast double, stl double, blk double, tov double, pf double, fgm double, fga double, orb double")
    ev = spark.createDataFrame([("h", 1, 1, 1.0, "Rebound", "", "A", "P", None, ""), ("g", 1, 1, 1.0, "Rebound", "", "B", "P", None, ""), ("h", 2, 1, 1.0, "Made Shot", "", "A", "P", None, "3pt")], "gameid string, eventnum int, period int, clock_seconds double, event_type string, subtype string, team string, player string, br_player_id string, description string")
    log = log.withColumn("fta", F.lit(None).cast("double"))
    got = {(r.gameid, r.side): r for r in games.game_radar(games_, log, ev).collect()}
    assert len(got) == 4 and set(games.RADAR) < set(got["g", "home"].asDict())
    a = got["g", "home"]
    assert (a.pts, a.reb, a.oreb, a.fg_pct, a.fgm, a.fg3m, a.dreb) == (10.0, 4.0, 5.0, 0.5, 2.0, None, None)
    assert (got["g", "away"].reb, got["g", "away"].ast) == (3.0, None)
    b = got["h", "home"]
    assert (b.pts, b.reb, b.fg3m, b.fgm, b.fg3_pct, b.ast) == (7.0, 1.0, 1.0, None, 1.0, None)
    axes = {(r.gameid, r.metric): (r.home, r.away, r.winner) for r in games.radar_axes(games.game_radar(games_, log, ev)).collect()}
    assert axes["g", "pts"] == (10.0, 8.0, 1) and axes["g", "fg_pct"] == (50.0, 40.0, 1) and axes["h", "blk"] == (0.0, None, None)


def test_performance_prefers_the_log(spark):
    e = lambda n, player, pid, period, kind="Made Shot": ("g", n, period, 1.0, kind, "", "A", player, pid, f"shot {n}")
    ev = spark.createDataFrame([e(1, "Al Long", "7", 1), e(2, "Al Long", "7", 2), e(3, "Bo Day", None, 1, "Missed Shot")], "gameid string, eventnum int, period int, clock_seconds double, event_type string, subtype string, team string, player string, br_player_id string, description string")
    log = spark.createDataFrame([("g", "7", "Al Long", "A", 30.0, 1.0, 2.0, 0.0, 0.0), ("g", "8", "Z. Day", "A", 4.0, 1.0, 0.0, 0.0, 0.0)], "gameid string, br_player_id string, player_name string, team string, pts double, reb double, ast double, stl double, blk double")
    got = {(r.player, r.period): (r.matched_id, r.log_pts, r.pts) for r in boxscore.performance(ev, log).collect()}
    assert got == {("Al Long", 1): ("7", 30.0, 2), ("Al Long", 2): ("7", 30.0, 2), ("Bo Day", 1): ("8", 4.0, 0)}
    flat = {r.player: [(x.period, x.detail) for x in r.made_shots] for r in boxscore.flat_details(boxscore.player_periods(ev, with_details=True)).collect()}
    assert flat == {"Al Long": [(1, "shot 1"), (2, "shot 2")], "Bo Day": []}


def test_growth_merge(spark):
    names = ["age", "gs", "mp", "trb", "ast", "stl", "blk", "tov", "pf", *growth.PERCENTAGES, "per", "ts_percent", "usg_percent", "ws", "bpm", "vorp"]
    rows = [("p", 2000, "A", "PG", 4, 10.0), ("p", 2000, "TOT", "PG", 9, 99.0), ("p", 2001, "B", "X", 0, None)]
    df = spark.createDataFrame(rows, "player_id string, season int, team string, pos string, g int, pts double").select("*", *(F.lit(2.0).alias(c) for c in names))
    totals = spark.createDataFrame([("A", 2000, False, 5, 40.0), ("A", 2000, True, 9, 80.0)], "abbreviation string, season int, playoffs boolean, g int, pts double")
    got = [(r.season, r.pts_per_game, r.trb_per_game, r.pos_name, r.scoring_share) for r in growth.growth_seasons(df, totals, "p").collect()]
    assert got == [(2000, 2.5, 0.5, "Point Guard", 25.0), (2001, None, None, "X", None)]
    bio = spark.createDataFrame([("p", "Pat")], "player_id string, player_name string")
    assert growth.career_summary(df, bio, "p").first().total_points == 10 and growth.career_summary(df, bio, "q").collect() == []
    one = growth.position_breakdown(df, "p").collect()
    assert [(r.pos, r.games_share) for r in one] == [("PG", 100.0), ("X", 0.0)] and growth.position_axes(growth.position_breakdown(df, "nobody")).first().ppg == 30.0


def test_status(spark):
    day = lambda d: datetime(2024, 5, d, tzinfo=UTC).date()
    tables = {
        "games": spark.createDataFrame([(f"g{i:02}", day(i + 1), "A", "B", 1, 2) for i in range(12)], "game_id string, game_date date, home_team_abbr string, away_team_abbr string, home_pts int, away_pts int"),
        "team_mapping": spark.createDataFrame([("A", True), ("B", None)], "team_code string, is_active boolean"),
        "team_splits": spark.createDataFrame([("A", 2000, "total", 5, None, 1.0)], "team_abbr string, season int, split_type string, games int, pts double, plus_minus double"),
    }
    got = system.status_summary(spark, tables, 2000)
    assert (got["total_tables"], got["total_records"], got["active_teams"], got["last_game_date"]) == (3, 15, 1, "2024-05-12")
    assert [g["date"] for g in got["recent_games"]] == [f"2024-05-{d:02}" for d in range(12, 2, -1)] and got["top_scorers"] == [{"team": "A", "pts": 0.0, "games": 5, "plus_minus": 1.0}]
    broken = system.status_summary(spark, tables | {"team_mapping": spark.range(1)}, 2000)
    assert broken["active_teams"] == 0 and len(broken["recent_games"]) == 10
    assert system.guard({"fine": lambda: True, "broken": lambda: 1 / 0}) == {"fine": True, "broken": False}
    assert [system.uptime_text(s) for s in (5, 65, 3700)] == ["5s", "1m 5s", "1h 1m 40s"] and system.monitor_stats(spark)["metrics_registered"] == 11
    with system.tagged(spark, "request-1"):
        assert "request-1" in spark.getTags()
    assert "request-1" not in spark.getTags()


def test_sources(spark):
    facts = spark.createDataFrame([("a", 2000), ("b", 2000), ("b", 2001)], "player_id string, season int")
    rows, key = catalog.metric_input({"season_facts": facts}, "season_facts", 2000, ["b"])
    assert key == "player_id" and [r.player_id for r in rows.collect()] == ["b"] and catalog.metric_input({"season_facts": facts}, "season_facts", 2000, [])[0].count() == 0
    assert catalog.metric_input({"season_facts": facts}, "season_facts", 2000)[0].count() == 2
    with pytest.raises(ValueError, match="gamelog"):
        catalog.metric_input({}, "nope", 2000)
    assert catalog.player_bios(facts, []).collect() == [] and catalog.split_ids(" 1, x,,2 ") == ["1", "x", "2"] and catalog.split_ids("1,x,2", digits_only=True) == ["1", "2"]
    assert catalog.unknown_names(["x", "ft_rate", "x", "y"], metrics.metric_names()) == ["x", "y"]
    text = spark.createDataFrame([("k", "left"), ("l", "right")], "note string, split_type string")
    assert catalog.page_totals(text, "IGH", 50).first().total == 1 and catalog.page_totals(text, "k", 1).first().total_pages == 0
    assert catalog.page_totals(text.drop("split_type"), "k", 1).first().total_pages == 2
    assert [r.column_name for r in catalog.table_columns(text).orderBy("ordinal").collect()] == ["note", "split_type"]


def test_limits(spark):
    log = spark.range(250).select(F.concat(F.lit("g"), "id").alias("game_id"), F.lit("2024-01-01").cast("date").alias("game_date"), F.lit(1).alias("home_q1"), F.lit("A").alias("home_team_abbr"), F.lit("B").alias("away_team_abbr"), F.lit(2000).alias("season"))
    assert games.games_page(log, size=999).count() == 200 and games.quarter_recent(log, "a", 999).count() == 100


def test_small_expressions(spark):
    assert one(spark, ex.lookup(F.col("s"), ex.TEAM_CODES), s="BKN") == "BRK" and one(spark, ex.lookup(F.col("s"), ex.TEAM_CODES), s="LAL") == "LAL"
    for day, season in (("2024-09-30", 2024), ("2024-10-01", 2025)):
        assert one(spark, ex.season_of(F.col("s").cast("date")), s=day) == season
    assert [one(spark, ex.winner(F.col("a"), F.col("b"), low), a=1.0, b=2.0) for low in (False, True)] == [2, 1] and one(spark, ex.winner(F.col("a"), F.col("a")), a=1.0) is None


def test_exports_repeat(spark, tmp_path):
    ranked = metrics.rank(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "player_id string, value double"))
    at = datetime(2024, 5, 1, tzinfo=UTC)
    assert export.rankings_json(ranked, "m", 2000, 1, at) == export.rankings_json(ranked, "m", 2000, 1, at)
    assert export.rankings_csv(ranked, 5)[0] == "rank,player_id,value,percentile\n1,b,2.0,100.0\n2,a,1.0,0.0\n"
    vs = spark.createDataFrame([("x", 1.0, None)], "metric string, p1 double, p2 double")
    assert export.vs_csv(vs)[0] == "metric,p1,p2\nx,1.0,\n"
    text, digest = export.vs_json(vs, "p", "q", 2000, at)
    assert json.loads(text)["metrics"] == {"x": {"p1": 1.0, "p2": None}} and export.vs_json(vs, "p", "q", 2000, at)[1] == digest
    values = spark.createDataFrame([("b", 2.0, None), ("a", 1.0, 3.0)], "player_id string, m double, n double")
    assert json.loads(export.player_json(values, "b", 2000, at)[0])["metrics"] == {"m": 2.0} and json.loads(export.player_json(values, "zz", 2000, at)[0])["metrics"] == {}
    export.league_files(values, str(tmp_path / "league"))
    assert [r.player_id for r in spark.read.json(str(tmp_path / "league")).orderBy("player_id").collect()] == ["a", "b"]


def test_milestones(spark):
    rows = [("p", 1, "A", "G", 5, 10.0, 20.0, 1.0), ("p", 2, "A", "F", 5, 30.0, 26.0, 2.0), ("p", 3, "A", "F", 5, 30.0, 27.0, None)]
    df = spark.createDataFrame(rows, "player_id string, season int, team string, pos string, g int, pts double, per double, ws double")
    got = [(r.season, r.kind) for r in growth.milestones(df).orderBy("season", "place").collect()]
    assert got == [(1, "debut"), (2, "peak_scoring"), (2, "peak_ws"), (2, "breakout"), (2, "position_change"), (3, "peak_per"), (3, "current")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_game_radar_has_every_game(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    key = lambda r: [str(x) for x in r]
    got = registered.queries()["game_radar_every_game"](spark, SF).collect()
    assert {r.gameid for r in got} == {r.game_id for r in role(spark, SF, "games").select("game_id").collect()}
    assert sorted(map(key, got)) == sorted(map(key, con.execute(registered.oracle_sql()["game_radar_every_game"]).fetchall()))
