"""Registered queries with all fields of the reference's operators. Their SQL spells names and constants out, so
that a wrong one in the library shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import boxscore
from .plans import charts, context, games, growth, system, teams
from .registered import _DEC, _DIV, _EVBOX_SQL, _LATEST, _PERIOD_SQL, _RND, NAMES, PLAYER, SEASON, TEAM, TIES, _add, _many, _raw, _SQL, _STINT, _CAREER, _Q
from .sources import catalog
from .sources.roles import role

# Sources
_add("team_mapping_active", "team_mapping", sql="SELECT team_code AS team_abbr, team_name, is_active FROM team_mapping WHERE is_active")(catalog.list_teams)
_add("team_mapping_all", "team_mapping", sql="SELECT team_code AS team_abbr, team_name, is_active FROM team_mapping")(lambda t: catalog.list_teams(t, active_only=False))
_add("metric_input_by_ids", "season_facts", "gamelog", sql=f"""
    SELECT player_id, season, team, pos, pts FROM season_facts WHERE season = {SEASON} AND player_id IN ('3', '5', '7')""")(
    lambda f, g: catalog.metric_input({"season_facts": f, "gamelog": g}, "season_facts", SEASON, ["3", "5", "7", "3"])[0].select("player_id", "season", "team", "pos", "pts"))
_add("player_bios", "players", sql="SELECT * FROM players WHERE player_id IN ('2', '4')")(lambda p: catalog.player_bios(p, ["2", "4", "nobody"]))
_Q["table_columns"] = lambda spark, d: catalog.table_columns(_raw(spark, d, "supplier"))
_SQL["table_columns"] = """SELECT * FROM (VALUES (1::INTEGER, 's_suppkey', 'bigint'), (2::INTEGER, 's_name', 'string'), (3::INTEGER, 's_nationkey', 'int'), (4::INTEGER, 's_acctbal', 'double')) v(ordinal, column_name, data_type)"""
_add("browse_totals", "games", sql="SELECT count(*) AS total, ceil(count(*) / 7)::BIGINT AS total_pages FROM games WHERE game_id ILIKE '%21%'")(
    lambda g: catalog.page_totals(g, "21", 7))
_Q["table_profile"] = lambda spark, d: catalog.table_profile(_raw(spark, d, "labels"))
_SQL["table_profile"] = """
    WITH n AS (SELECT count(*) AS row_count, count(doc_id) AS a, count(quality) AS b, count(toxic) AS c FROM labels)
    SELECT 1::INTEGER AS ordinal, 'doc_id' AS column_name, 'bigint' AS data_type, a AS n_values, row_count FROM n
    UNION ALL SELECT 2, 'quality', 'int', b, row_count FROM n UNION ALL SELECT 3, 'toxic', 'int', c, row_count FROM n"""

# Status
_add("status_total_records", "games", "players", sql="SELECT ((SELECT count(*) FROM games) + (SELECT count(*) FROM players))::BIGINT AS total_records")(
    lambda g, p: system.total_records(catalog.table_counts(g.sparkSession, {"games": g, "players": p})))
_add("status_active_teams", "team_mapping", sql="SELECT count(*) AS active_teams FROM team_mapping WHERE is_active")(system.active_teams)
_add("status_top_scorers", "team_splits", sql=f"""
    SELECT team_abbr AS team, coalesce(pts::DOUBLE, 0.0) AS pts, games, coalesce(plus_minus, 0.0) AS plus_minus FROM team_splits
    WHERE season = {SEASON} AND split_type = 'total' ORDER BY team_splits.pts DESC NULLS FIRST, team_abbr LIMIT 10""")(lambda s: system.top_scorers(s, SEASON))  # fmt: skip
_add("status_recent_games", "games", sql="""
    SELECT game_id, strftime(game_date, '%Y-%m-%d') AS date, away_team_abbr AS away, home_team_abbr AS home, away_pts, home_pts FROM games
    WHERE game_date IS NOT NULL ORDER BY game_date DESC, game_id LIMIT 10""")(system.recent_games)  # fmt: skip

# Games
_SUM = {"pts": "pts", "fgm": "fgm", "fga": "fga", "fg3m": "tpm", "fg3a": "tpa", "ftm": "coalesce(ftm, ft)", "fta": "fta", "reb": "coalesce(reb, trb)", "oreb": "coalesce(oreb, orb)", "dreb": "coalesce(dreb, drb)",
        "ast": "ast", "stl": "stl", "blk": "blk", "tov": "tov", "pf": "pf"}
_PCT = lambda a, b: f"CASE WHEN coalesce({b}, 0) <> 0 THEN {_RND(f'{a} / {b}', 4)} ELSE 0.0 END"
_BOX_SQL = f"""
    SELECT *, {_PCT("fgm", "fga")} AS fg_pct, {_PCT("fg3m", "fg3a")} AS fg3_pct, {_PCT("ftm", "fta")} AS ft_pct
    FROM (SELECT gameid, coalesce(team, '') AS team, {", ".join(f"sum({e}) AS {c}" for c, e in _SUM.items())} FROM {_LATEST} GROUP BY 1, 2)"""
_add("team_box_from_gamelog", "gamelog", sql=_BOX_SQL)(lambda g: boxscore.team_box(g, TIES))
_add("team_box_from_events", "plays", sql=f"""
    SELECT *, {_PCT("fg3m", "fg3a")} AS fg3_pct, {_PCT("ftm", "fta")} AS ft_pct FROM ({_EVBOX_SQL})""")(boxscore.team_box_from_events)  # fmt: skip
_FILLED = ("reb", "ast", "stl", "blk", "tov", "pf", "oreb", "dreb", "fg3m", "fg3a", "ftm", "fta", "fg3_pct", "ft_pct")
_FIELDS = ("pts", "reb", "ast", "stl", "blk", "fg_pct", "fg3_pct", "ft_pct", "tov", "pf", "oreb", "dreb", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta")
_OF_SIDE = lambda side: ", ".join(f"{side}_{'fga3' if c == 'fg3a' else c}::DOUBLE AS {c}" for c in _FIELDS)
_FIELD = lambda c: f"coalesce(x.{c}::DOUBLE, b.{c}" + (f", CASE WHEN l.gameid IS NULL AND k.lacks THEN e.{c}::DOUBLE END" if c in _FILLED else "") + f") AS {c}"
_RADAR_SQL = f"""
    WITH base AS (SELECT game_id AS gameid, 'home' AS side, home_team_abbr AS team, {_OF_SIDE("home")} FROM games
        UNION ALL SELECT game_id, 'away', away_team_abbr, {_OF_SIDE("away")} FROM games),
    box AS ({_BOX_SQL}),
    ev AS (SELECT *, NULL::BIGINT AS ast, {_PCT("fg3m", "fg3a")} AS fg3_pct, {_PCT("ftm", "fta")} AS ft_pct FROM ({_EVBOX_SQL})),
    logged AS (SELECT DISTINCT gameid FROM gamelog),
    lacking AS (SELECT gameid, bool_or(reb IS NULL OR ast IS NULL OR tov IS NULL OR pf IS NULL) AS lacks FROM base GROUP BY 1)
    SELECT b.gameid, b.side, b.team, {", ".join(map(_FIELD, _FIELDS))}
    FROM base b LEFT JOIN box x ON b.gameid = x.gameid AND b.team = x.team LEFT JOIN ev e ON b.gameid = e.gameid AND b.team = e.team
    LEFT JOIN logged l ON b.gameid = l.gameid LEFT JOIN lacking k ON b.gameid = k.gameid"""
for _name in ("game_radar", "game_radar_every_game"):
    _add(_name, "games", "gamelog", "plays", sql=_RADAR_SQL)(lambda g, log, plays: games.game_radar(g, log, plays, TIES))
_LOWER = lambda a, b: f"CASE WHEN {a} < {b} THEN 1 WHEN {b} < {a} THEN 2 END"
_HIGHER = lambda a, b: f"CASE WHEN {a} > {b} THEN 1 WHEN {b} > {a} THEN 2 END"
_TOP = lambda a, b: f"CASE WHEN greatest(coalesce({a}, 0.0), coalesce({b}, 0.0)) > 0 THEN greatest(coalesce({a}, 0.0), coalesce({b}, 0.0)) * 1.3::DOUBLE ELSE 1.0 END"
_add("game_radar_axes", "games", "gamelog", "plays", sql=f"""
    WITH r AS ({_RADAR_SQL}), m AS (SELECT unnest(['pts', 'reb', 'ast', 'stl', 'blk', 'fg_pct', 'fg3_pct', 'ft_pct', 'tov', 'pf']) AS metric),
    v AS (SELECT gameid, side, metric, CASE metric WHEN 'pts' THEN pts WHEN 'reb' THEN reb WHEN 'ast' THEN ast WHEN 'stl' THEN stl WHEN 'blk' THEN blk WHEN 'fg_pct' THEN fg_pct * 100
        WHEN 'fg3_pct' THEN fg3_pct * 100 WHEN 'ft_pct' THEN ft_pct * 100 WHEN 'tov' THEN tov ELSE pf END AS value FROM r, m),
    p AS (SELECT gameid, metric, max(CASE WHEN side = 'home' THEN value END) AS home, max(CASE WHEN side = 'away' THEN value END) AS away FROM v GROUP BY 1, 2)
    SELECT *, {_TOP("home", "away")} AS axis_max, (CASE WHEN metric IN ('tov', 'pf') THEN {_LOWER("home", "away")} ELSE {_HIGHER("home", "away")} END)::INTEGER AS winner FROM p""")(
    lambda g, log, plays: games.radar_axes(games.game_radar(g, log, plays, TIES)))

# Player performance, with the game log's player of the same id or last name
_STATS = ("pts", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "reb", "oreb", "dreb", "ast", "stl", "blk", "tov", "pf")
_MATCHED_SQL = f"""
    WITH p AS ({_PERIOD_SQL}),
    who AS (SELECT DISTINCT gameid, player, team FROM p),
    ids AS (SELECT gameid, player, coalesce(team, '') AS team, min(br_player_id) AS own FROM plays WHERE br_player_id IS NOT NULL GROUP BY 1, 2, 3),
    log AS (SELECT gameid, br_player_id, lower(list_last(string_split(player_name, ' '))) AS last, team, ast, stl, blk, pts FROM {_LATEST}),
    w AS (SELECT who.*, ids.own, lower(list_last(string_split(who.player, ' '))) AS last FROM who LEFT JOIN ids USING (gameid, player, team)),
    exact AS (SELECT w.*, log.br_player_id AS matched_id FROM w JOIN log ON w.gameid = log.gameid AND w.own = log.br_player_id),
    named AS (SELECT w.*, log.br_player_id AS matched_id FROM w LEFT JOIN log ON w.gameid = log.gameid AND w.last = log.last AND w.last <> ''
        WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.gameid = w.gameid AND e.player = w.player AND e.team = w.team)
        QUALIFY row_number() OVER (PARTITION BY w.gameid, w.player, w.team ORDER BY CASE WHEN log.ast > 0 THEN 10 ELSE 0 END + CASE WHEN log.stl > 0 THEN 2 ELSE 0 END + CASE WHEN log.blk > 0 THEN 2 ELSE 0 END
            + CASE WHEN upper(log.team) = upper(w.team) THEN 1 ELSE 0 END DESC NULLS LAST, log.br_player_id NULLS LAST) = 1),
    matched AS (SELECT gameid, player, team, matched_id FROM exact UNION ALL SELECT gameid, player, team, matched_id FROM named)
    SELECT p.gameid, p.player, p.team, p.period, {", ".join(f"p.{c}" for c in _STATS)}, m.matched_id, log.pts AS log_pts, (SELECT count(*) FROM plays e WHERE e.gameid = p.gameid AND e.player = p.player AND coalesce(e.team, '') = p.team
        AND e.period = p.period AND e.event_type = 'Made Shot') AS made_details
    FROM p LEFT JOIN matched m ON p.gameid = m.gameid AND p.player = m.player AND p.team = m.team LEFT JOIN log ON log.gameid = p.gameid AND log.br_player_id = m.matched_id"""
_add("player_performance_matched", "plays", "gamelog", sql=_MATCHED_SQL)(
    lambda e, log: boxscore.performance(e, boxscore.latest_gamelog(log, TIES)).select("gameid", "player", "team", "period", *_STATS, "matched_id", "log_pts", F.size("made_shots").cast("long").alias("made_details")))
_add("player_detail_counts", "plays", sql="""
    WITH own AS (SELECT gameid, coalesce(team, '') AS team, player, event_type, period FROM plays
        UNION ALL SELECT gameid, coalesce(team, ''), regexp_extract(description, 'Assist by ([^(.,)]*\\)?)', 1), 'Assist', period FROM plays
        WHERE event_type = 'Made Shot' AND lower(description) LIKE '%assist by%')
    SELECT gameid, team, player, sum((event_type = 'Made Shot')::INT)::BIGINT AS made, sum((event_type = 'Missed Shot')::INT)::BIGINT AS missed,
        min(CASE WHEN event_type = 'Made Shot' THEN period END)::INTEGER AS first_made_in FROM own GROUP BY 1, 2, 3""")(
    lambda e: boxscore.flat_details(boxscore.player_periods(e, with_details=True)).select(
        "gameid", "team", "player", F.size("made_shots").cast("long").alias("made"), F.size("missed_shots").cast("long").alias("missed"), F.get("made_shots", F.lit(0))["period"].alias("first_made_in")))

_RECORD = {"pts": "pts", "fgm": "fgm", "fga": "fga", "fg3m": "tpm", "fg3a": "tpa", "ftm": "coalesce(ftm, ft)", "fta": "fta", "reb": "coalesce(reb, trb)", "oreb": "coalesce(oreb, orb)", "dreb": "coalesce(dreb, drb)",
           "ast": "ast", "stl": "stl", "blk": "blk", "tov": "tov", "pf": "pf"}
_PREFERRED = ", ".join(f"(CASE WHEN l.br_player_id IS NOT NULL THEN coalesce(l.{c}_, 0.0) ELSE t.{c} END)::DOUBLE AS {c}" for c in _RECORD)
_add("player_totals_preferred", "plays", "gamelog", sql=f"""
    WITH m AS ({_MATCHED_SQL}),
    t AS (SELECT gameid, team, player, matched_id, {", ".join(f"sum({c}) AS {c}" for c in _RECORD)} FROM m GROUP BY 1, 2, 3, 4),
    l AS (SELECT gameid, br_player_id, {", ".join(f"({e})::DOUBLE AS {c}_" for c, e in _RECORD.items())} FROM {_LATEST})
    SELECT t.gameid, t.team, t.player, t.matched_id, l.br_player_id IS NOT NULL AS from_log, {_PREFERRED}
    FROM t LEFT JOIN l ON l.gameid = t.gameid AND l.br_player_id = t.matched_id""")(
    lambda e, log: boxscore.preferred_totals(boxscore.performance(e, boxscore.latest_gamelog(log, TIES), with_details=False)))

# Teams
_MOST_GAMES = "QUALIFY row_number() OVER (PARTITION BY abbreviation ORDER BY g DESC NULLS FIRST, playoffs) = 1"
_add("team_stats", "team_per_game", sql=f"""
    SELECT abbreviation AS team_abbr, pts_per_game AS off_pts, opp_pts_per_game AS def_pts, g, fg_percent, x3p_percent, ft_percent, trb_per_game, ast_per_game, stl_per_game, blk_per_game, tov_per_game, pf_per_game, fta_per_game
    FROM team_per_game WHERE season = {SEASON} {_MOST_GAMES}""")(lambda t: teams.team_stats(t, SEASON))  # fmt: skip
_NUM = lambda a, b: f"round(({a}::DECIMAL(38, 10)::DOUBLE / nullif({b}::DECIMAL(38, 10), 0)::DOUBLE)::DECIMAL(38, 10), 3)::DOUBLE"
_add("team_ratios_per_game", "team_per_game", sql=f"""
    SELECT abbreviation AS team_abbr, ast_per_game, tov_per_game, stl_per_game, pf_per_game, pts_per_game, opp_pts_per_game, g, {_NUM("ast_per_game", "tov_per_game")} AS ast_tov_ratio, {_NUM("stl_per_game", "pf_per_game")} AS stl_pf_ratio
    FROM team_per_game WHERE season = {SEASON} AND playoffs IS NOT TRUE""")(lambda t: teams.team_ratios_per_game(t, SEASON))  # fmt: skip
_add("team_trend", "team_splits", sql=f"SELECT season, pts, plus_minus, games, reb, ast, stl, blk FROM team_splits WHERE team_abbr = '{TEAM}' AND split_type = 'total'")(lambda s: teams.team_trend(s, TEAM))
_add("standings_with_summaries", "team_seasons", "team_summaries", sql=f"""
    WITH r AS (SELECT * FROM team_seasons WHERE season = {SEASON} QUALIFY row_number() OVER (PARTITION BY abbreviation ORDER BY w DESC NULLS FIRST, playoffs) = 1),
    c AS (SELECT *, CASE WHEN abbreviation IN ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3', 'NATION_4') THEN 'East' WHEN abbreviation IN ('NATION_5', 'NATION_6', 'NATION_7', 'NATION_8', 'NATION_9') THEN 'West' ELSE '' END AS conference FROM r)
    SELECT c.abbreviation, w, l, CASE WHEN w + l <> 0 THEN round_even(w::DOUBLE / (w + l), 4) ELSE 0.0 END AS win_pct, conference,
        (CASE WHEN conference = '' THEN row_number() OVER (ORDER BY w DESC NULLS LAST, c.abbreviation) ELSE row_number() OVER (PARTITION BY conference ORDER BY w DESC NULLS LAST, c.abbreviation) END)::INTEGER AS conference_rank,
        pw, pl, mov, srs, o_rtg, d_rtg, n_rtg, pace, ts_percent, e_fg_percent, tov_percent, orb_percent
    FROM c LEFT JOIN team_summaries s ON c.abbreviation = s.abbreviation AND c.season = s.season AND c.playoffs = s.playoffs""")(lambda t, s: teams.standings(t, SEASON, s))  # fmt: skip
_TEAM_RADAR_SQL = f"""
    SELECT * FROM (SELECT t.abbreviation, CASE WHEN t.playoffs IS NOT TRUE THEN 1 ELSE 2 END AS priority, t.g, pts_per_game AS pts, trb_per_game AS reb, ast_per_game AS ast, stl_per_game AS stl, blk_per_game AS blk,
            fg_percent AS fg_pct, x3p_percent AS fg3_pct, ft_percent AS ft_pct, fta_per_game AS fta, tov_per_game AS tov, pf_per_game AS pf, m.pace, m.x3p_ar
        FROM team_per_game t LEFT JOIN team_summaries m ON t.abbreviation = m.abbreviation AND t.season = m.season AND t.playoffs = m.playoffs WHERE t.season = {SEASON}
    UNION ALL SELECT team_abbr, 3, games, pts::DOUBLE, reb, ast, stl, blk, fg_pct, fg3_pct, ft_pct, NULL, NULL, NULL, NULL, NULL FROM team_splits WHERE season = {SEASON} AND split_type = 'total')
    QUALIFY row_number() OVER (PARTITION BY abbreviation ORDER BY priority, g DESC NULLS FIRST) = 1"""
_TABLES = ("team_per_game", "team_summaries", "team_splits")
_add("team_radar_fallback", *_TABLES, sql=_TEAM_RADAR_SQL)(lambda t, m, s: teams.team_radar(t, m, s, SEASON))
_SHARE100 = lambda c: f"CASE WHEN {c} <= 1 THEN {c} * 100 ELSE {c} END"
_AXIS = {"pts": "pts", "reb": "reb", "ast": "ast", "stl": "stl", "blk": "blk", "fg_pct": _SHARE100("fg_pct"), "fg3_pct": _SHARE100("fg3_pct"), "ft_pct": _SHARE100("ft_pct"), "pace": "pace", "x3p_ar": _SHARE100("x3p_ar"),
         "fta": "fta", "tov": "20 - tov", "pf": "28 - pf"}
_add("team_radar_normalised", *_TABLES, sql=f"""
    SELECT abbreviation, {", ".join(f"{_DEC(f'coalesce({e}, 0.0)', 1)} AS {c}" for c, e in _AXIS.items())} FROM ({_TEAM_RADAR_SQL})""")(lambda t, m, s: teams.radar_scaled(teams.team_radar(t, m, s, SEASON)))  # fmt: skip
_AVG = {"pts": ("pts_per_game", 2), "reb": ("trb_per_game", 2), "ast": ("ast_per_game", 2), "stl": ("stl_per_game", 2), "blk": ("blk_per_game", 2), "fg_pct": ("fg_percent", 4), "fg3_pct": ("x3p_percent", 4), "ft_pct": ("ft_percent", 4),
        "fta": ("fta_per_game", 2), "tov": ("tov_per_game", 2), "pf": ("pf_per_game", 2), "pace": ("pace", 2), "x3p_ar": ("x3p_ar", 4)}
_add("league_radar_avg", "team_per_game", "team_summaries", sql=f"""
    SELECT {", ".join(f"{_DEC(_DIV(f'sum({e})', f'count({e})'), n)} AS {c}" for c, (e, n) in _AVG.items())}
    FROM team_per_game t LEFT JOIN team_summaries m ON t.abbreviation = m.abbreviation AND t.season = m.season AND t.playoffs = m.playoffs WHERE t.season = {SEASON} AND t.playoffs IS NOT TRUE""")(
    lambda t, m: teams.league_average(t, m, SEASON))
_add("team_comparison", *_TABLES, sql=f"""
    WITH r AS (SELECT * EXCLUDE (priority, g) FROM ({_TEAM_RADAR_SQL})),
    v AS (FROM r UNPIVOT INCLUDE NULLS (value FOR metric IN (pts, reb, ast, stl, blk, fg_pct, fg3_pct, ft_pct, fta, tov, pf, pace, x3p_ar))),
    p AS (SELECT metric, max(CASE WHEN abbreviation = 'NATION_7' THEN value END) AS team1, max(CASE WHEN abbreviation = 'NATION_5' THEN value END) AS team2 FROM v GROUP BY 1)
    SELECT *, {_TOP("team1", "team2")} AS axis_max, (CASE WHEN metric IN ('tov', 'pf') THEN {_LOWER("team1", "team2")} ELSE {_HIGHER("team1", "team2")} END)::INTEGER AS winner FROM p""")(
    lambda t, m, s: teams.team_comparison(teams.team_radar(t, m, s, SEASON), "nation_7", "NATION_5"))

# Charts
_ADVANCED = "per, ts_percent, x3p_ar, f_tr, orb_percent, drb_percent, trb_percent, ast_percent, stl_percent, blk_percent, tov_percent, usg_percent, ows, dws, ws, ws_48, obpm, dbpm, bpm, vorp"
_add("advanced_leaderboard", "season_facts", sql=f"SELECT season, player_id, team, pos, g, mp, {_ADVANCED} FROM {_STINT(2)} ORDER BY per DESC NULLS LAST, player_id LIMIT 50")(lambda f: charts.leaderboard(f, "advanced", SEASON, min_games=2))
_add("advanced_leaderboard_by_vorp", "season_facts", sql=f"SELECT season, player_id, team, pos, g, mp, {_ADVANCED} FROM {_STINT(2)} ORDER BY vorp DESC NULLS LAST, player_id LIMIT 200")(
    lambda f: charts.leaderboard(f, "advanced", SEASON, sort="VORP", limit=999, min_games=2))
_SHOOTING = """fg_percent, avg_dist_fga, percent_fga_from_x0_3_range, percent_fga_from_x3_10_range, percent_fga_from_x10_16_range, percent_fga_from_x16_3p_range, percent_fga_from_x3p_range, fg_percent_from_x0_3_range,
    fg_percent_from_x3_10_range, fg_percent_from_x10_16_range, fg_percent_from_x16_3p_range, fg_percent_from_x3p_range, percent_assisted_x2p_fg, percent_assisted_x3p_fg, percent_dunks_of_fga, num_of_dunks,
    percent_corner_3s_of_3pa, corner_3_point_percent"""
_add("shooting_zones", "player_shooting", sql=f"""
    SELECT season, player, team, g, mp, {_SHOOTING} FROM (SELECT * FROM player_shooting WHERE season = {SEASON} AND team NOT IN ('TOT', '2TM', '3TM', '4TM') AND g >= 10
        QUALIFY row_number() OVER (PARTITION BY player ORDER BY g DESC NULLS FIRST, team) = 1) ORDER BY mp DESC NULLS FIRST, player LIMIT 50""")(lambda s: charts.shooting_zones(s, SEASON))  # fmt: skip

# Similarity and trends
_similar = _SQL["similar_players"]
_add("similar_players_with_bios", "season_facts", "players", sql=None)(lambda f, p: context.similar_with_bios(context.similar_players(_many(f), PLAYER, list(NAMES)), p))
_SQL["similar_players_with_bios"] = f"""
    SELECT s.player_id, s.similarity, p.position, coalesce(p.player_name, p.full_name, s.player_id) AS name FROM ({_similar}) s
    LEFT JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS player_id, s_name AS player_name, CAST(NULL AS VARCHAR) AS full_name, concat(r_name, ', ', n_name) AS position FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey) p USING (player_id)"""
# Careers
_PER = lambda c: f"{_DEC(_DIV(c, 'g'), 2)} AS {c}_per_game"
_PER_GAME = ", ".join(map(_PER, ("mp", "pts", "trb", "ast", "stl", "blk", "tov", "pf")))
_add("career_per_game", "season_facts", sql=f"SELECT player_id, season, age, team, pos, g, gs, {_PER_GAME}, fg_percent, x3p_percent, ft_percent, e_fg_percent FROM {_CAREER}")(growth.career_per_game)
_WHOLE = lambda c, name: f"round_even(sum({c}), 0)::BIGINT AS {name}"
_GAMES = ", ".join(_WHOLE(c, n) for c, n in (("g", "total_games"), ("gs", "total_games_started"), ("mp", "total_minutes"), ("pts", "total_points"), ("trb", "total_rebounds"), ("ast", "total_assists"), ("stl", "total_steals"), ("blk", "total_blocks")))
_add("career_summary", "season_facts", "players", sql=f"""
    SELECT p.*, t.* FROM players p, (SELECT count(*) AS seasons, {_GAMES}, {_WHOLE("tov", "total_turnovers")}, sum(ws) AS total_win_shares FROM season_facts WHERE player_id = '{PLAYER}' AND team NOT IN ('TOT', '2TM', '3TM', '4TM')) t
    WHERE p.player_id = '{PLAYER}'""")(lambda f, p: growth.career_summary(f, p, PLAYER))  # fmt: skip
_POS_SQL = f"""
    SELECT pos, count(*) AS seasons, {_GAMES}, {_DEC('avg(' + _DIV('pts', 'g') + ')', 2)} AS ppg, {_DEC('avg(' + _DIV('trb', 'g') + ')', 2)} AS rpg, {_DEC('avg(' + _DIV('ast', 'g') + ')', 2)} AS apg, {_DEC('avg(per)', 2)} AS avg_per,
        {_DEC('avg(usg_percent)', 2)} AS avg_usg, {_DEC(_DIV('sum(pts)', 'sum(mp)') + ' * 36', 2)} AS pts_per_36,
        CASE pos WHEN 'PG' THEN 'Point Guard' WHEN 'SG' THEN 'Shooting Guard' WHEN 'SF' THEN 'Small Forward' WHEN 'PF' THEN 'Power Forward' WHEN 'C' THEN 'Center' ELSE pos END AS pos_name,
        round_even(100.0::DOUBLE * sum(g) / sum(sum(g)) OVER (), 2) AS games_share
    FROM season_facts WHERE player_id = '{PLAYER}' AND pos IS NOT NULL GROUP BY pos"""
_add("position_breakdown", "season_facts", sql=_POS_SQL)(lambda f: growth.position_breakdown(f, PLAYER))
_MAX = lambda c, d: f"CASE WHEN max({c}) > 0 THEN max({c}) * 1.2::DOUBLE ELSE {d}.0 END AS {c}"
_add("position_axes", "season_facts", sql=f"""
    SELECT {_MAX("ppg", 30)}, {_MAX("rpg", 15)}, {_MAX("apg", 12)}, {_MAX("avg_per", 35)}, {_MAX("avg_usg", 40)} FROM (SELECT * FROM ({_POS_SQL}) ORDER BY total_games DESC NULLS FIRST, pos LIMIT 5)""")(
    lambda f: growth.position_axes(growth.position_breakdown(f, PLAYER)))
_add("growth_seasons", "season_facts", "team_totals", sql=f"""
    WITH c AS (SELECT * FROM {_CAREER} WHERE player_id = '{PLAYER}'), t AS (SELECT abbreviation, season, pts AS team_pts FROM team_totals WHERE playoffs IS NOT TRUE)
    SELECT c.season, age, c.team, pos, g, gs, mp, pts, trb, ast, stl, blk, tov, pf, fg_percent, x3p_percent, ft_percent, per, ts_percent, usg_percent, ws, bpm, vorp, {_PER_GAME}, pos AS pos_name, team_pts,
        CASE WHEN pts > 0 AND team_pts > 0 THEN {_RND("100 * pts / team_pts", 2)} END AS scoring_share
    FROM c LEFT JOIN t ON c.team = t.abbreviation AND c.season = t.season""")(lambda f, t: growth.growth_seasons(f, t, PLAYER))  # fmt: skip
