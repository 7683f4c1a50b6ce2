"""Registered queries of the reference's operators, each with SQL over the same canonical tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as ex
from .operators import boxscore, metrics, possession
from .plans import charts, context, games, growth, system, teams
from .sources import catalog
from .sources.roles import role, with_roles

SEASON, PLAYER, TEAM, GAME, LATE = 1998, "7", "NATION_7", "7", 21_600.0
TIES = ("l_partkey", "l_suppkey", "l_extendedprice")
NAMES = ("pts_per_game", "reb_per_game", "ast_per_game", "stl_per_game", "blk_per_game")
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


#: Queries that ask for SEASON alone, of all that they read.
_ONE_SEASON = ("load_season_facts", "load_gamelog_by_ids", "load_games_by_type", "gamelog_with_game_context", "season_stats_with_bio", "metric_", "compute_many", "rank_", "vs_compare", "batch_rank", "scoring_distribution",
               "per_game_leaderboard", "advanced_leaderboard", "shooting_zones", "player_ratios", "similar_players", "standings", "team_stats", "team_ratios", "team_radar", "league_radar", "team_comparison", "games_page")
#: Queries whose teams come from customer and nation.
_BY_CUSTOMER = ("games_page", "quarter_recent", "game_detail", "player_performance", "status_recent_games")


def _add(name: str, *roles: str, sql: str | None = None):
    """Register fn(*role tables) under a name."""
    season = SEASON if name.startswith(_ONE_SEASON) and name != "metric_trend" else None
    by_customer = name in _BY_CUSTOMER

    def wrap(fn):
        _Q[name] = lambda spark, sf_dir: fn(*(role(spark, sf_dir, r, season, by_customer) for r in roles))
        if sql:
            _SQL[name] = with_roles(sql, *roles, by_customer=by_customer)
        return fn

    return wrap


def _raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Sources, joins, browsing
_add("load_season_facts", "season_facts", sql=f"SELECT * FROM season_facts WHERE season = {SEASON}")(lambda f: catalog.load_season(f, SEASON))
_IDS = [str(i) for i in range(1, 8)]
_log_cols = ["gameid", "br_player_id", "season", "pts", *TIES]
_LOG_SQL = f"SELECT {', '.join(_log_cols)} FROM gamelog WHERE season = {SEASON} AND br_player_id IN ('2', '3')"
_add("load_gamelog_by_ids_in", "gamelog", sql=_LOG_SQL)(lambda g: catalog.load_gamelog(g, SEASON, ["2", "3", "2"]).select(*_log_cols))
_add("load_gamelog_by_ids_semi", "gamelog", sql=_LOG_SQL)(lambda g: catalog.load_gamelog(g, SEASON, ["2", "3"] + [f"x{i}" for i in range(600)]).select(*_log_cols))
_add("load_dim_by_ids", "players", sql="SELECT * FROM players WHERE player_id IN ('1', '2', '3', '4', '5', '6', '7')")(lambda p: catalog.load_by_ids(p, "player_id", _IDS))
_add("load_games_by_type", "games", sql=f"SELECT game_id, season, season_type, home_pts FROM games WHERE season = {SEASON} AND season_type = 'Playoffs'")(lambda g: catalog.load_games(g, SEASON, "Playoffs").select("game_id", "season", "season_type", "home_pts"))
_add("seasons_available", "season_facts", sql="SELECT DISTINCT season FROM season_facts WHERE season IS NOT NULL")(lambda f: catalog.seasons_available(f, "season_facts"))
_add("search_entities", "players", sql="SELECT player_id, player_name FROM players WHERE player_name ILIKE '%00001%' OR full_name ILIKE '%00001%' ORDER BY player_name, player_id LIMIT 20")(
    lambda p: catalog.search(p, "00001", ["player_name", "full_name"], ["player_name", "player_id"]).select("player_id", "player_name"))
_Q["table_browse_page"] = lambda spark, d: catalog.browse(_raw(spark, d, "customer"), ["c_custkey"], "1", "c_acctbal", True, 2, 50, more_columns=("c_name",))
_SQL["table_browse_page"] = "SELECT * FROM customer WHERE c_name ILIKE '%1%' ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 50 OFFSET 50"
_COUNTED = ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")
_Q["table_counts"] = lambda spark, d: catalog.table_counts(spark, {t: _raw(spark, d, t) for t in _COUNTED})
_SQL["table_counts"] = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _COUNTED)
_add("status_splits", "team_splits", sql='SELECT count(*) AS "rows", count(DISTINCT team_abbr) AS teams, count(DISTINCT season) AS seasons FROM team_splits')(system.split_counts)
_add("latest_game_day", "games", sql="SELECT max(game_date) AS last_day FROM games")(lambda g: g.agg(F.max("game_date").alias("last_day")))
_CONTEXT = ["gameid", "br_player_id", "pts", "l_partkey", "l_suppkey", "season_type", "game_date", "home_team_abbr", "away_team_abbr", "home_pts"]
_add("gamelog_with_game_context", "gamelog", "games", sql=f"""
    SELECT l.gameid, l.br_player_id, l.pts, l.l_partkey, l.l_suppkey, g.season_type, g.game_date, g.home_team_abbr, g.away_team_abbr, g.home_pts
    FROM gamelog l LEFT JOIN games g ON l.gameid = g.game_id WHERE l.season = {SEASON}""")(
    lambda log, g: catalog.gamelog_with_games(catalog.load_season(log, SEASON), g).select(*_CONTEXT))
_add("season_stats_with_bio", "season_facts", "players", sql=f"""
    SELECT f.player_id, f.team, f.pos, f.pts, p.player_name, p.position AS bio_position, p.height_cm
    FROM season_facts f LEFT JOIN players p USING (player_id) WHERE season = {SEASON}""")(
    lambda f, p: catalog.season_stats_with_bios(catalog.load_season(f, SEASON), p).select("player_id", "team", "pos", "pts", "player_name", "bio_position", "height_cm"))

# Metrics
_S = lambda c: f"coalesce(sum({c}), 0.0)"
_METRIC_SQL = {n: f"{_S(c)} / greatest({_S('g')}, 1.0)" for n, c in zip(NAMES, ("pts", "trb", "ast", "stl", "blk"), strict=True)} | {
    "true_shooting_pct": f"{_S('pts')} / greatest(2 * ({_S('fga')} + 0.44::DOUBLE * {_S('fta')}), 1.0)",
    "effective_fg_pct": f"({_S('fg')} + 0.5 * {_S('x3p')}) / greatest({_S('fga')}, 1.0)",
    "ft_rate": f"{_S('fta')} / greatest({_S('fga')}, 1.0)",
    "usage_percent": "avg(usg_percent)",
    "fantasy_points": f"{_S('pts')} + {_S('trb')} * 1.2::DOUBLE + {_S('ast')} * 1.5::DOUBLE + {_S('stl')} * 3 + {_S('blk')} * 3 - {_S('tov')} + {_S('x3p')}",
    "efficiency_rating": f"{_S('pts')} + {_S('trb')} + {_S('ast')} + {_S('stl')} + {_S('blk')} - ({_S('fga')} - {_S('fg')}) - ({_S('fta')} - {_S('ft')}) - {_S('tov')}",
}
_RND = lambda e, p: f"round_even(({e})::DOUBLE, {p})"
_VALUE = lambda m: f"SELECT player_id, {_RND(_METRIC_SQL[m], 6)} AS value FROM season_facts WHERE season = {SEASON} GROUP BY player_id"
_value = lambda f, m="pts_per_game": metrics.evaluate(catalog.load_season(f, SEASON), metrics.metric(m))
for _m in metrics.metric_names():
    _add(f"metric_{_m}", "season_facts", sql=_VALUE(_m))(lambda f, m=_m: _value(f, m))
_add("compute_many_all", "season_facts", sql=f"SELECT player_id, {', '.join(f'{_RND(_METRIC_SQL[m], 6)} AS {m}' for m in metrics.metric_names())} FROM season_facts WHERE season = {SEASON} GROUP BY player_id")(
    lambda f: metrics.evaluate_many(catalog.load_season(f, SEASON), metrics.all_metrics()))


def _rank_sql(metric: str = "pts_per_game", order: str = "DESC", where: str = "true") -> str:
    return f"""WITH v AS ({_VALUE(metric)}) SELECT rank() OVER (ORDER BY value {order}) AS rank, player_id, value,
    CASE WHEN count(*) OVER () = 1 THEN 100.0 ELSE {_RND(f"100.0 * (count(*) OVER () - rank() OVER (ORDER BY value {order})) / (count(*) OVER () - 1)", 4)} END AS percentile, count(*) OVER () AS sample_size FROM v WHERE {where}"""


_add("rank_desc", "season_facts", sql=_rank_sql())(lambda f: metrics.rank(_value(f)))
_add("rank_asc", "season_facts", sql=_rank_sql(order="ASC"))(lambda f: metrics.rank(_value(f), ascending=True))
_add("rank_min_value", "season_facts", sql=_rank_sql(where="value >= 25"))(lambda f: metrics.rank(_value(f), min_value=25.0))
_TOP_SQL = _rank_sql().replace("WITH v AS", "WITH v AS", 1)
_add("rank_top_with_bio", "season_facts", "players", sql=f"SELECT r.*, p.position, coalesce(p.full_name, p.player_name, r.player_id) AS name FROM ({_rank_sql()} ORDER BY rank, player_id LIMIT 20) r LEFT JOIN players p USING (player_id)")(
    lambda f, p: metrics.with_bios(metrics.rank(_value(f)).orderBy("rank", "player_id").limit(20), p))
_add("vs_compare", "season_facts", sql="WITH " + ", ".join(f"m{i} AS ({_VALUE(m)})" for i, m in enumerate(metrics.metric_names())) + " " + " UNION ALL ".join(f"SELECT '{m}' AS metric, max(CASE WHEN player_id = '3' THEN value END) AS p1, max(CASE WHEN player_id = '7' THEN value END) AS p2 FROM m{i}" for i, m in enumerate(metrics.metric_names())))(
    lambda f: metrics.vs_compare(catalog.load_season(f, SEASON), metrics.all_metrics(), "3", "7"))
_BATCH = [("pts_per_game", "DESC"), ("ft_rate", "ASC")]
_add("batch_rank_union", "season_facts", sql=" UNION ALL ".join(f"SELECT * FROM (SELECT '{m}' AS metric, * FROM ({_rank_sql(m, o)}) ORDER BY rank, player_id LIMIT 15)" for m, o in _BATCH))(
    lambda f: (lambda dfs: dfs[0].select(F.lit(_BATCH[0][0]).alias("metric"), "*").unionByName(dfs[1].select(F.lit(_BATCH[1][0]).alias("metric"), "*")))(metrics.run_batch(catalog.load_season(f, SEASON), [{"op": "rank", "metric": m, "ascending": o == "ASC", "limit": 15} for m, o in _BATCH])))

# Games and events
_LATEST = "(SELECT * FROM gamelog WHERE br_player_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY gameid, br_player_id ORDER BY created_at DESC NULLS FIRST, l_partkey, l_suppkey, l_extendedprice) = 1)"
_add("dedup_latest_gamelog", "gamelog", sql=f"SELECT gameid, br_player_id, created_at, pts, l_partkey, l_suppkey FROM {_LATEST}")(lambda g: boxscore.latest_gamelog(g, TIES).select("gameid", "br_player_id", "created_at", "pts", "l_partkey", "l_suppkey"))
_add("games_page", "games", sql=f"SELECT * FROM games WHERE season = {SEASON} ORDER BY game_date DESC NULLS LAST, game_id LIMIT 50 OFFSET 50")(lambda g: games.games_page(g, SEASON, 2))
_add("quarter_recent", "games", sql=f"SELECT * FROM games WHERE (home_team_abbr = '{TEAM}' OR away_team_abbr = '{TEAM}') AND home_q1 IS NOT NULL ORDER BY game_date DESC NULLS FIRST, game_id LIMIT 10")(lambda g: games.quarter_recent(g, TEAM.lower()))
_add("game_detail", "games", sql="SELECT * FROM games WHERE game_id = '100'")(lambda g: games.game_detail(g, "100"))
_add("play_by_play", "plays", sql=f"SELECT gameid, eventnum, period, event_type, team, player FROM plays WHERE gameid = '{GAME}'")(lambda e: games.play_by_play(e, GAME).select("gameid", "eventnum", "period", "event_type", "team", "player"))
_TEXT = "lower(description)"
_SHOT = lambda e: f"sum(CASE WHEN {e} THEN 1 ELSE 0 END)::BIGINT"
_THREE = f"({_TEXT} LIKE '%3-pt%' OR {_TEXT} LIKE '%3pt%')"
_COUNTERS = {
    "pts": f"sum(CASE WHEN event_type = 'Made Shot' THEN CASE WHEN {_THREE} THEN 3 ELSE 2 END WHEN event_type = 'Free Throw' AND {_TEXT} LIKE '%make%' THEN 1 ELSE 0 END)::BIGINT",
    "fgm": _SHOT("event_type = 'Made Shot'"), "fga": _SHOT("event_type IN ('Made Shot', 'Missed Shot')"),
    "fg3m": _SHOT(f"event_type = 'Made Shot' AND {_THREE}"), "fg3a": _SHOT(f"event_type IN ('Made Shot', 'Missed Shot') AND {_THREE}"),
    "ftm": _SHOT(f"event_type = 'Free Throw' AND {_TEXT} LIKE '%make%'"), "fta": _SHOT("event_type = 'Free Throw'"),
    "reb": _SHOT("event_type = 'Rebound'"), "oreb": _SHOT(f"event_type = 'Rebound' AND {_TEXT} LIKE '%offensive%'"), "dreb": _SHOT(f"event_type = 'Rebound' AND {_TEXT} NOT LIKE '%offensive%'"),
    "stl": "0::BIGINT", "blk": "0::BIGINT", "tov": _SHOT("event_type = 'Turnover'"), "pf": "0::BIGINT",
}
_PERIOD_SQL = f"""WITH own AS (SELECT gameid, player, coalesce(team, '') AS team, period, {", ".join(f"{e} AS {s}" for s, e in _COUNTERS.items())}, 0::BIGINT AS ast FROM plays GROUP BY 1, 2, 3, 4),
helped AS (SELECT gameid, regexp_extract(description, 'Assist by ([^(.,)]*\\)?)', 1) AS player, coalesce(team, '') AS team, period, {", ".join(f"0::BIGINT AS {s}" for s in _COUNTERS)}, count(*) AS ast FROM plays WHERE event_type = 'Made Shot' AND {_TEXT} LIKE '%assist by%' GROUP BY 1, 2, 3, 4),
both_ AS (SELECT * FROM own UNION ALL SELECT * FROM helped)
SELECT gameid, player, team, period, {", ".join(f"sum({s})::BIGINT AS {s}" for s in boxscore.STATS)} FROM both_ GROUP BY 1, 2, 3, 4"""
_add("player_performance", "plays", sql=_PERIOD_SQL)(boxscore.player_periods)
_add("player_totals", "plays", sql=f"SELECT gameid, team, player, {', '.join(f'sum({s})::BIGINT AS {s}' for s in boxscore.STATS)} FROM ({_PERIOD_SQL}) GROUP BY 1, 2, 3")(lambda e: boxscore.player_totals(boxscore.player_periods(e)))
_EVBOX_SQL = f"SELECT gameid, coalesce(team, '') AS team, {', '.join(f'{e} AS {s}' for s, e in _COUNTERS.items())}, CASE WHEN {_COUNTERS['fga']} <> 0 THEN {_RND(_COUNTERS['fgm'] + ' / ' + _COUNTERS['fga'], 4)} ELSE 0.0 END AS fg_pct FROM plays GROUP BY 1, 2"
_add("team_box_from_events", "plays", sql=_EVBOX_SQL)(boxscore.team_box_from_events)


_CLOCK_SQL = """WITH e AS (SELECT *, event_type IN ('Rebound', 'Turnover', 'Made Shot') AS reset, event_type IN ('Made Shot', 'Missed Shot') AS shot FROM plays WHERE event_type IN ('Made Shot', 'Missed Shot', 'Rebound', 'Turnover')),
s AS (SELECT *, coalesce(sum(reset::INT) OVER w, 0) AS seg, last_value(CASE WHEN reset THEN clock_seconds END IGNORE NULLS) OVER w AS rc FROM e WINDOW w AS (PARTITION BY gameid ORDER BY eventnum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, first_value(CASE WHEN shot THEN clock_seconds END IGNORE NULLS) OVER (PARTITION BY gameid, seg ORDER BY eventnum ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fs FROM s),
t AS (SELECT *, {start} AS start_clock FROM f WHERE shot),
x AS (SELECT *, CASE WHEN start_clock IS NULL OR start_clock = 0 OR clock_seconds IS NULL OR clock_seconds = 0 THEN 0 ELSE start_clock - clock_seconds END >= {late} AS late, event_type = 'Made Shot' AS made, CASE WHEN subtype LIKE '%3%' THEN 3 ELSE 2 END AS p FROM t),
a AS (SELECT {key}, count(*) AS total_shots, sum(late::INT)::BIGINT AS late_shots, sum((NOT late)::INT)::BIGINT AS early_shots, sum((late AND made)::INT)::BIGINT AS late_made, sum((NOT late AND made)::INT)::BIGINT AS early_made,
    sum(CASE WHEN made THEN p ELSE 0 END)::BIGINT AS points, sum(CASE WHEN late AND made THEN p ELSE 0 END)::BIGINT AS late_points FROM x GROUP BY {group})
SELECT *, CASE WHEN total_shots <> 0 THEN round_even(100.0::DOUBLE * late_shots / total_shots, 1) ELSE 0.0 END AS late_pct, CASE WHEN late_shots <> 0 THEN round_even(100.0::DOUBLE * late_made / late_shots, 1) ELSE 0.0 END AS late_fg_pct,
    CASE WHEN early_shots <> 0 THEN round_even(100.0::DOUBLE * early_made / early_shots, 1) ELSE 0.0 END AS early_fg_pct FROM a WHERE total_shots >= {least}"""
_add("late_clock_team", "plays", sql=_CLOCK_SQL.format(start="coalesce(rc, fs)", late=LATE, key="team", group="team", least=0))(lambda e: possession.late_clock_teams(e, LATE))
_add("late_clock_player", "plays", sql=_CLOCK_SQL.format(start="rc", late=LATE, key="player, arg_max(team, gameid || lpad(eventnum::VARCHAR, 12, '0')) AS team", group="player", least=50).replace("gameid || lpad", "gameid || chr(1) || lpad"))(lambda e: possession.late_clock_players(e, LATE, 50))

# Teams
_DEC = lambda e, p: f"round(({e})::DECIMAL(38, 10), {p})::DOUBLE"
_DIV = lambda a, b: f"({a})::DOUBLE / nullif({b}, 0)"
_conf = lambda: f"CASE WHEN abbreviation IN {teams.EAST} THEN 'East' WHEN abbreviation IN {teams.WEST} THEN 'West' ELSE '' END"
_add("team_list", "team_seasons", sql="SELECT DISTINCT abbreviation AS team_code FROM team_seasons WHERE g > 10")(lambda t: t.filter("g > 10").select(F.col("abbreviation").alias("team_code")).distinct().orderBy("team_code"))
_add("team_splits", "team_splits", sql=f"SELECT * FROM team_splits WHERE team_abbr = '{TEAM}' AND season = {SEASON}")(lambda s: teams.team_splits(s, TEAM.lower(), SEASON))
_add("standings", "team_seasons", sql=f"""WITH r AS (SELECT *, {_conf()} AS conference FROM team_seasons WHERE season = {SEASON} QUALIFY row_number() OVER (PARTITION BY abbreviation ORDER BY w DESC NULLS FIRST, playoffs) = 1)
    SELECT abbreviation, w, l, CASE WHEN w + l <> 0 THEN round_even(w::DOUBLE / (w + l), 4) ELSE 0.0 END AS win_pct, conference, (CASE WHEN conference = '' THEN row_number() OVER (ORDER BY w DESC NULLS LAST, abbreviation) ELSE row_number() OVER (PARTITION BY conference ORDER BY w DESC NULLS LAST, abbreviation) END)::INTEGER AS conference_rank FROM r""")(lambda t: teams.standings(t, SEASON))
_add("team_ratios", "team_seasons", sql=f"SELECT abbreviation, {_DEC(_DIV('ast', 'tov'), 3)} AS ast_tov, {_DEC(_DIV('stl', 'pf'), 3)} AS stl_pf FROM team_seasons WHERE season = {SEASON} AND playoffs IS NOT TRUE")(lambda t: teams.team_ratios(t, SEASON))

# Charts
_add("scoring_distribution", "season_facts", sql=f"SELECT min(x) AS min, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, max(x) AS max, count(*) AS total FROM (SELECT pts / g AS x FROM season_facts WHERE season = {SEASON} AND g >= 1)")(lambda f: charts.scoring_distribution(f, SEASON))
_STINT = lambda least: f"(SELECT * FROM season_facts WHERE season = {SEASON} AND team NOT IN ('TOT', '2TM', '3TM', '4TM') AND g >= {least} QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY g DESC NULLS FIRST, team, pos) = 1)"
_add("per_game_leaderboard", "season_facts", sql=f"SELECT player_id, team, g, {', '.join(f'{_DEC(_DIV(c, "g"), 3)} AS {c}' for c in charts.PER_GAME)} FROM {_STINT(0)} ORDER BY pts DESC NULLS LAST, player_id LIMIT 50".replace("ORDER BY pts DESC", f"ORDER BY {_DEC(_DIV('pts', 'g'), 3)} DESC"))(lambda f: charts.leaderboard(f, "per_game", SEASON))
_add("player_ratios", "season_facts", sql=f"SELECT player_id, {_DEC(_DIV('ast', 'tov'), 2)} AS ast_tov, {_DEC(_DIV('stl', 'pf'), 2)} AS stl_pf FROM {_STINT(0)}")(lambda f: charts.player_ratios(f, SEASON))

# Context
_BY_SEASON = lambda f: f.groupBy("player_id", "season").agg(*(ex.rnd(metrics.metric(m).expr(), 6).alias(m) for m in NAMES))
_BY_SEASON_SQL = f"SELECT player_id, season, {', '.join(f'{_RND(_METRIC_SQL[m], 6)} AS {m}' for m in NAMES)} FROM season_facts GROUP BY 1, 2"


def _similar_sql(near: str) -> str:
    z = ", ".join(f"({m} - avg({m}) OVER ()) / CASE WHEN stddev_samp({m}) OVER () = 0 THEN 1 ELSE stddev_samp({m}) OVER () END AS {m}" for m in NAMES)
    dot = lambda a, b: " + ".join(f"{a}.{m} * {b}.{m}" for m in NAMES)
    return f"""WITH v AS (SELECT player_id, {", ".join(f"{_RND(_METRIC_SQL[m], 6)} AS {m}" for m in NAMES)} FROM season_facts WHERE season = {SEASON} GROUP BY 1),
    z AS (SELECT player_id, {z} FROM v WHERE {near}), t AS (SELECT * FROM z WHERE player_id = '{PLAYER}')
    SELECT z.player_id, round_even(({dot("t", "z")}) / (sqrt({dot("t", "t")}) * sqrt({dot("z", "z")})), 4) AS similarity FROM z, t WHERE z.player_id <> t.player_id ORDER BY similarity DESC, player_id LIMIT 10"""


_many = lambda f: metrics.evaluate_many(catalog.load_season(f, SEASON), [metrics.metric(m) for m in NAMES])
_add("similar_players", "season_facts", sql=_similar_sql("true"))(lambda f: context.similar_players(_many(f), PLAYER, list(NAMES)))
_add("similar_players_position", "season_facts", "players", sql=_similar_sql(f"player_id IN (SELECT p.player_id FROM players p, (SELECT trim(split_part(position, ',', 1)) AS token FROM players WHERE player_id = '{PLAYER}') x WHERE contains(p.position, x.token))"))(
    lambda f, p: context.similar_players(_many(f), PLAYER, list(NAMES), bios=p, same_position=True))
_EVOLUTION_SQL = f"""WITH s AS ({_BY_SEASON_SQL}), e AS (SELECT player_id, min(season) AS lo, max(season) AS hi FROM s GROUP BY 1 HAVING min(season) < max(season)),
l AS (SELECT * FROM (UNPIVOT s ON {", ".join(NAMES)} INTO NAME metric VALUE value) JOIN e USING (player_id)),
c AS (SELECT player_id, metric, max(CASE WHEN season = lo THEN value END) AS first_value, max(CASE WHEN season = hi THEN value END) AS last_value, {_RND("regr_slope(value, season)", 4)} AS slope FROM l GROUP BY 1, 2)
SELECT *, {_RND("last_value - first_value", 4)} AS abs_change, CASE WHEN first_value <> 0 THEN {_RND("100 * (last_value - first_value) / abs(first_value)", 2)} END AS pct_change,
    CASE WHEN {_RND("last_value - first_value", 4)} > 0 THEN 'up' WHEN {_RND("last_value - first_value", 4)} < 0 THEN 'down' WHEN last_value - first_value IS NOT NULL THEN 'flat' END AS direction FROM c"""
_add("role_evolution", "season_facts", sql=_EVOLUTION_SQL)(lambda f: context.role_evolution(_BY_SEASON(f), list(NAMES)))
_add("role_movers", "season_facts", sql=f"SELECT player_id, side, place, metric, pct_change FROM (SELECT *, CASE WHEN pct_change > 0 THEN 'growth' ELSE 'decline' END AS side, row_number() OVER (PARTITION BY player_id, pct_change > 0 ORDER BY abs(pct_change) DESC, metric)::INTEGER AS place FROM ({_EVOLUTION_SQL}) WHERE pct_change <> 0) WHERE place <= 3")(
    lambda f: context.top_movers(context.role_evolution(_BY_SEASON(f), list(NAMES))))
_add("metric_trend", "season_facts", sql=f"""WITH p AS (SELECT player_id, season, pts_per_game AS value, row_number() OVER (PARTITION BY player_id ORDER BY season DESC) AS late FROM ({_BY_SEASON_SQL})),
    a AS (SELECT player_id, count(*) AS n, regr_slope(value, season) AS s, regr_intercept(value, season) AS c, CASE WHEN var_pop(value) = 0 THEN 0.0 ELSE regr_r2(value, season) END AS r, regr_slope(CASE WHEN late <= 3 THEN value END, CASE WHEN late <= 3 THEN season END) AS m FROM p GROUP BY 1)
    SELECT player_id, n, CASE WHEN n >= 2 THEN {_RND("s", 6)} END AS slope, CASE WHEN n >= 2 THEN {_RND("c", 4)} END AS intercept, CASE WHEN n >= 2 THEN {_RND("r", 4)} END AS r2, CASE WHEN n >= 4 THEN {_RND("m", 4)} END AS momentum,
        CASE WHEN n >= 2 THEN {_RND("s * 2002 + c", 4)} END AS prediction, CASE WHEN n < 2 THEN 'insufficient_data' WHEN s > 1e-9 THEN 'up' WHEN s < -1e-9 THEN 'down' ELSE 'flat' END AS direction FROM a""")(
    lambda f: context.metric_trend(_BY_SEASON(f).select("player_id", "season", F.col("pts_per_game").alias("value")), 2001))

# Careers
_CAREER = "(SELECT * FROM season_facts WHERE team NOT IN ('TOT', '2TM', '3TM', '4TM') QUALIFY row_number() OVER (PARTITION BY player_id, season ORDER BY g DESC NULLS FIRST, team, pos) = 1)"
_add("career_seasons", "season_facts", sql=f"SELECT * FROM {_CAREER}")(growth.career_seasons)
_add("growth_milestones", "season_facts", sql=f"""WITH c AS (SELECT * FROM {_CAREER}), m AS (
    SELECT player_id, 0 AS place, 'debut' AS kind, min(season) AS season, NULL AS v FROM c GROUP BY 1
    UNION ALL SELECT player_id, 1, 'peak_scoring', season, pts FROM c QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY pts DESC, season) = 1
    UNION ALL SELECT player_id, 2, 'peak_per', season, per FROM c QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY per DESC, season) = 1
    UNION ALL SELECT player_id, 3, 'peak_ws', season, ws FROM c QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY ws DESC, season) = 1
    UNION ALL SELECT player_id, 4, 'breakout', season, per FROM c WHERE per >= 25 QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY season) = 1
    UNION ALL SELECT player_id, 6, 'current', max(season), NULL FROM c GROUP BY 1),
    p AS (SELECT player_id, season, pos, lag(pos) OVER (PARTITION BY player_id ORDER BY season) AS was FROM c)
    SELECT player_id, place, kind, season::INTEGER AS season, v::VARCHAR AS value FROM m UNION ALL SELECT player_id, 5, 'position_change', season::INTEGER, pos FROM p WHERE pos <> was""")(lambda f: growth.milestones(growth.career_seasons(f)))

from . import registered_fields, registered_layouts  # noqa: E402, F401  more queries, which use the names above
