"""Adapters: the driver's tables in the roles of the canonical ones (seasons, game logs, games, events, teams).

The SQL is plain enough for Spark and DuckDB, so that a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_Q = "l_quantity"
#: A team's code, as nations are named, by arithmetic on a key: no join for a name.
_CODE = lambda key: f"'NATION_' || CAST(({key}) % 25 AS STRING)"
_WHEN = lambda cond: f"sum(CASE WHEN {cond} THEN {_Q} ELSE 0.0 END)"

#: Stand-ins for rates that the tables don't have: remainders of sums, which are exact.
_RATES = {"ts_percent": 41, "x3p_ar": 43, "f_tr": 47, "orb_percent": 53, "drb_percent": 59, "trb_percent": 61, "ast_percent": 67, "stl_percent": 71, "blk_percent": 73, "tov_percent": 79, "ows": 7, "dws": 11, "ws_48": 13, "obpm": 19, "dbpm": 23, "bpm": 29, "vorp": 5}
_SHARE = lambda a, b: f"{a} / nullif({b}, 0.0)"
_MORE = ", ".join([
    "CAST(year(o_orderdate) - 1970 AS INT) AS age", "count(DISTINCT CASE WHEN l_linenumber = 1 THEN o_orderkey END) AS gs", f"{_WHEN("l_returnflag = 'R' AND l_linestatus <> 'F'")} AS drb",
    f"{_SHARE(_WHEN('l_linenumber <= 2'), _WHEN('l_linenumber <= 4'))} AS fg_percent", f"{_SHARE(_WHEN('l_linenumber = 1'), _WHEN('l_linenumber <= 3'))} AS x3p_percent",
    f"{_SHARE(_WHEN("l_linenumber = 5 AND l_returnflag <> 'R'"), _WHEN('l_linenumber = 5'))} AS ft_percent", f"{_SHARE(_WHEN('l_linenumber <= 3'), _WHEN('l_linenumber <= 4'))} AS e_fg_percent",
    *(f"sum({_Q}) % {m} AS {c}" for c, m in _RATES.items()),
])

SEASON_FACTS = f"""
SELECT CAST(l_suppkey AS STRING) AS player_id, year(o_orderdate) AS season, o_orderpriority AS team, p_type AS pos,
    count(DISTINCT o_orderkey) AS g, {_WHEN("l_linestatus = 'F'")} AS mp,
    {_WHEN("l_linenumber <= 2")} AS fg, {_WHEN("l_linenumber <= 4")} AS fga, {_WHEN("l_linenumber = 1")} AS x3p,
    {_WHEN("l_linenumber = 5 AND l_returnflag <> 'R'")} AS ft, {_WHEN("l_linenumber = 5")} AS fta,
    {_WHEN("l_returnflag = 'R' AND l_linestatus = 'F'")} AS orb, {_WHEN("l_returnflag = 'R'")} AS trb, {_WHEN("l_returnflag = 'A'")} AS ast,
    {_WHEN("l_linenumber = 6")} AS stl, {_WHEN("l_linenumber = 7")} AS blk, {_WHEN("l_linenumber = 3")} AS tov, {_WHEN("l_linenumber = 4")} AS pf,
    sum({_Q}) AS pts, sum({_Q}) % 37 AS usg_percent, sum({_Q}) % 31 AS per, sum({_Q}) % 17 AS ws, {_MORE}
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
GROUP BY 1, 2, 3, 4"""

PLAYERS = """
SELECT CAST(s_suppkey AS STRING) AS player_id, s_name AS player_name, CAST(NULL AS STRING) AS full_name, concat(r_name, ', ', n_name) AS position, s_nationkey + 170 AS height_cm
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

GAMELOG = f"""
SELECT CAST(l_orderkey AS STRING) AS gameid, CAST(l_linenumber AS STRING) AS br_player_id, year(o_orderdate) AS season, l_shipdate AS created_at,
    {_CODE('o_custkey + 7 * (l_suppkey % 2)')} AS team, concat('Player ', CAST(l_linenumber % 4 AS STRING)) AS player_name, l_quantity AS pts,
    CASE WHEN l_returnflag = 'R' THEN l_quantity END AS reb, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 2.0 END AS trb, l_linenumber * 1.0 AS ast,
    CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END AS stl, l_quantity % 3 AS blk, l_quantity % 5 AS tov, l_quantity % 7 AS pf, l_quantity % 11 AS fgm, l_quantity % 11 + l_linenumber AS fga,
    CASE WHEN l_linenumber > 2 THEN l_quantity % 2 END AS oreb, l_quantity % 2 + 1 AS orb, l_quantity % 4 AS drb, CAST(NULL AS DOUBLE) AS dreb, l_quantity % 6 AS tpm, l_quantity % 6 + 1 AS tpa,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity % 8 END AS ftm, l_quantity % 8 AS ft, l_quantity % 8 + l_linenumber % 2 AS fta, l_partkey, l_suppkey, l_extendedprice
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

#: A third of the games has no team values, and another third lacks rebounds.
_SIDES = ", ".join(f"CASE WHEN o_orderkey % 3 <> {0 if c in ('reb', 'oreb', 'dreb') else 1} THEN CAST((o_orderkey + {i}) % {m} AS DOUBLE)END AS {side}_{c}"
    for i, side in enumerate(("home", "away")) for c, m in {"reb": 51, "ast": 31, "stl": 13, "blk": 11, "tov": 17, "pf": 23, "oreb": 14, "dreb": 37, "fgm": 43, "fga": 97, "fg3m": 19, "fga3": 41, "ftm": 29, "fta": 32}.items())
_SIDES += ", " + ", ".join(f"CASE WHEN o_orderkey % 3 = 2 THEN ((o_orderkey + {i}) % {m}) / {m}.0E0 END AS {side}_{c}" for i, side in enumerate(("home", "away")) for c, m in {"fg_pct": 64, "fg3_pct": 32, "ft_pct": 128}.items())

_GAMES = lambda home, away, source: f"""
SELECT CAST(o_orderkey AS STRING) AS game_id, year(o_orderdate) AS season, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Playoffs' ELSE 'Regular' END AS season_type,
    CAST(o_orderdate AS DATE) AS game_date, {home} AS home_team_abbr, {away} AS away_team_abbr, o_totalprice AS home_pts, o_totalprice / 2 AS away_pts,
    CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 4 END AS home_q1, o_orderstatus AS game_status, {_SIDES}
FROM {source}"""  # noqa: E731
GAMES = _GAMES(_CODE("o_custkey"), _CODE("o_custkey + 7"), "orders")

_EVENTS = lambda home, away, joined: f"""
SELECT CAST(user_id AS STRING) AS gameid, 2024 AS season, event_id AS eventnum, CAST(day(ts) AS INT) AS period, 86400.0 - (hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS INT)) AS clock_seconds,
    CASE event_type WHEN 'purchase' THEN 'Made Shot' WHEN 'click' THEN 'Missed Shot' WHEN 'view' THEN 'Rebound' WHEN 'error' THEN 'Turnover' ELSE 'Free Throw' END AS event_type,
    props AS subtype, CASE event_id % 5 WHEN 0 THEN {home} WHEN 1 THEN {away} ELSE concat('T', event_id % 5) END AS team, concat('Player ', event_id % 17) AS player,
    CASE WHEN event_id % 17 % 3 <> 1 THEN CAST(event_id % 17 AS STRING) END AS br_player_id,
    CASE WHEN event_id % 3 = 0 THEN concat('3-pt shot (Assist by Player ', event_id % 13, ')') WHEN event_id % 3 = 1 THEN 'make, offensive' ELSE 'layup' END AS description
FROM events LEFT JOIN {joined}"""  # noqa: E731
EVENTS = _EVENTS(_CODE("o_custkey"), _CODE("o_custkey + 7"), "orders ON user_id = o_orderkey")

TEAM_SEASONS = """
SELECT n_name AS abbreviation, year(o_orderdate) AS season, o_orderpriority = '1-URGENT' AS playoffs, count(*) AS g,
    sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS w, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS l,
    sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS price, sum(o_custkey % 29) AS ast, sum(o_custkey % 13) AS tov, sum(o_custkey % 7) AS stl, sum(o_custkey % 11) AS pf, sum(o_custkey % 97) AS pts
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1, 2, 3"""

_SPLIT = "CAST(sum(o_custkey % 41) AS DOUBLE) / count(*) - 20 AS plus_minus, " + ", ".join(f"CAST(sum(o_custkey % {m}) AS DOUBLE) / count(*) AS {c}" for c, m in {"reb": 43, "ast": 29, "stl": 7, "blk": 5}.items()) + ", " + ", ".join(f"CAST(sum(o_custkey % {m}) AS DOUBLE) / (count(*) * {m}) AS {c}" for c, m in {"fg_pct": 3, "fg3_pct": 5, "ft_pct": 9}.items())

TEAM_SPLITS = f"""
SELECT n_name AS team_abbr, year(o_orderdate) AS season, o_orderstatus AS split_type, count(*) AS games, sum(o_custkey % 97) AS pts, {_SPLIT}
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3
UNION ALL
SELECT n_name, year(o_orderdate), 'total', count(*), sum(o_custkey % 97), {_SPLIT}
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"""

_PER = lambda c, m: f"CAST(sum(o_custkey % {m}) AS DOUBLE) / count(*) AS {c}"
_PER_GAME = {"pts": 97, "opp_pts": 89, "trb": 43, "ast": 29, "stl": 7, "blk": 5, "tov": 13, "pf": 11, "fta": 31}
_SUMMED = {"pw": 17, "pl": 19, "mov": 23, "srs": 37, "o_rtg": 101, "d_rtg": 103, "n_rtg": 107, "pace": 109, "ts_percent": 41, "e_fg_percent": 53, "tov_percent": 59, "orb_percent": 61, "x3p_ar": 67}
_BY_TEAM = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"

TEAM_PER_GAME = f"""
SELECT n_name AS abbreviation, year(o_orderdate) AS season, o_orderpriority = '1-URGENT' AS playoffs, count(*) AS g, {", ".join(_PER(f"{c}_per_game", m) for c, m in _PER_GAME.items())},
    {", ".join(f"CAST(sum(o_custkey % {m}) AS DOUBLE) / (count(*) * {m}) AS {c}" for c, m in {"fg_percent": 3, "x3p_percent": 5, "ft_percent": 9}.items())}
{_BY_TEAM} GROUP BY 1, 2, 3"""

TEAM_SUMMARIES = f"""
SELECT n_name AS abbreviation, year(o_orderdate) AS season, o_orderpriority = '1-URGENT' AS playoffs, {", ".join(_PER(c, m) for c, m in _SUMMED.items())}
{_BY_TEAM} WHERE n_nationkey % 5 <> 0 GROUP BY 1, 2, 3"""

TEAM_MAPPING = "SELECT n_name AS team_code, concat('Team ', n_name) AS team_name, CASE WHEN n_nationkey % 7 = 3 THEN NULL ELSE n_nationkey % 4 <> 1 END AS is_active FROM nation"

#: Points of the teams that players of season_facts play for.
TEAM_TOTALS = f"SELECT o_orderpriority AS abbreviation, year(o_orderdate) AS season, o_orderpriority = '1-URGENT' AS playoffs, count(DISTINCT o_orderkey) AS g, sum({_Q}) AS pts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3"

_ZONES = ("x0_3", "x3_10", "x10_16", "x16_3p", "x3p")
PLAYER_SHOOTING = f"""
SELECT CAST(l_suppkey AS STRING) AS player, year(o_orderdate) AS season, o_orderpriority AS team, count(DISTINCT o_orderkey) AS g, {_WHEN("l_linestatus = 'F'")} AS mp,
    {_SHARE(_WHEN("l_linenumber <= 2"), _WHEN("l_linenumber <= 4"))} AS fg_percent, sum({_Q}) % 23 AS avg_dist_fga,
    {", ".join(f"{_SHARE(_WHEN(f'l_linenumber = {i + 1}'), f'sum({_Q})')} AS percent_fga_from_{z}_range" for i, z in enumerate(_ZONES))},
    {", ".join(f"{_SHARE(_WHEN(f"l_linenumber = {i + 1} AND l_returnflag = 'N'"), _WHEN(f'l_linenumber = {i + 1}'))} AS fg_percent_from_{z}_range" for i, z in enumerate(_ZONES))},
    {", ".join(f"sum({_Q}) % {m} AS {c}" for c, m in {"percent_assisted_x2p_fg": 31, "percent_assisted_x3p_fg": 37, "percent_dunks_of_fga": 41, "num_of_dunks": 43, "percent_corner_3s_of_3pa": 47, "corner_3_point_percent": 53}.items())}
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3"""

ROLES = {"season_facts": SEASON_FACTS, "players": PLAYERS, "gamelog": GAMELOG, "games": GAMES, "plays": EVENTS, "team_seasons": TEAM_SEASONS, "team_splits": TEAM_SPLITS}
ROLES |= {"team_per_game": TEAM_PER_GAME, "team_summaries": TEAM_SUMMARIES, "team_mapping": TEAM_MAPPING, "team_totals": TEAM_TOTALS, "player_shooting": PLAYER_SHOOTING}
#: Roles whose teams are the nations of orders' customers, looked up there instead of made from a key.
BY_CUSTOMER = {
    "games": _GAMES("h.n_name", "a.n_name", "orders JOIN customer ON o_custkey = c_custkey JOIN nation h ON c_nationkey = h.n_nationkey JOIN nation a ON (c_nationkey + 7) % 25 = a.n_nationkey"),
    "plays": _EVENTS("h.n_name", "a.n_name", "orders ON user_id = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation h ON c_nationkey = h.n_nationkey LEFT JOIN nation a ON (c_nationkey + 7) % 25 = a.n_nationkey"),
}
_TABLES = ("lineitem", "orders", "part", "supplier", "nation", "region", "customer", "events")


def _sql(name: str, by_customer: bool) -> str:
    return (ROLES | BY_CUSTOMER if by_customer else ROLES)[name]


def role(spark: SparkSession, sf_dir: str, name: str, season: int | None = None, by_customer: bool = False) -> DataFrame:
    """One canonical table as a lazy DataFrame. `season`: only what comes from its orders, by a range of dates that
    reaches the scan, as year(o_orderdate) doesn't; for roles whose rows have their orders' season. `by_customer`: the
    role in BY_CUSTOMER, if it has one."""
    import re

    sql = _sql(name, by_customer)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if re.search(rf"(FROM|JOIN) {t}\b", sql)}
    if season is not None and "orders" in used:
        used["orders"] = used["orders"].filter(f"o_orderdate >= timestamp'{season}-01-01' AND o_orderdate < timestamp'{season + 1}-01-01'")
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b(?! AS)", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **used)


def with_roles(sql: str, *names: str, by_customer: bool = False) -> str:
    """DuckDB SQL over canonical tables."""
    sql = sql.lstrip()
    ctes = ", ".join(f"{n} AS ({_sql(n, by_customer).replace('AS STRING', 'AS VARCHAR')})" for n in names)
    return f"WITH {ctes}{', ' + sql[5:] if sql.upper().startswith('WITH ') else ' ' + sql}"
