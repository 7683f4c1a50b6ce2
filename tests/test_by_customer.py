"""Queries whose teams are the nations of orders' customers, on tables in which no key tells the nation or its name."""

from datetime import datetime, timedelta

import pytest

import __spark_entry__
from statforge.plans import games

duckdb = pytest.importorskip("duckdb")

#: Nations have the names of others. Customer 4 has no nation, 5 one whose partner isn't there, 6 is no customer.
NATIONS = {k: f"NATION_{(k + 4) % 25}" for k in range(25) if k != 11}
CUSTOMERS = {1: 3, 2: 24, 3: 21, 4: None, 5: 4}
#: Events of two orders of each customer, and of an order that isn't there.
EVENTS = [(5 * i + side, k) for i, k in enumerate([*range(1, 13), 999]) for side in (0, 1, 2)]
ORDERS = {k: 1 + (k + 3) % 6 for k in range(1, 241)}
DAY = datetime(1998, 1, 1)


def teams(order: int) -> tuple[str, str] | None:
    """Home and away, or None where a join finds nothing."""
    nation = CUSTOMERS.get(ORDERS[order])
    found = [] if nation is None else [NATIONS.get(n) for n in (nation, (nation + 7) % 25)]
    return tuple(found) if all(found) and found else None


GAMES = {k: teams(k) for k in ORDERS if teams(k)}


def day(order: int) -> datetime:
    return DAY + timedelta(days=order // 3)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    made = {
        "nation": (list(NATIONS.items()), "n_nationkey int, n_name string"),
        "customer": (list(CUSTOMERS.items()), "c_custkey long, c_nationkey int"),
        "orders": ([(k, c, "OFP"[k % 3], float(k), day(k), "1-URGENT" if k % 2 else "5-LOW") for k, c in ORDERS.items()], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "events": ([(e, DAY, k, "purchase", "{}") for e, k in EVENTS], "event_id long, ts timestamp_ntz, user_id long, event_type string, props string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def run(spark, sf: str, name: str) -> list[dict]:
    """A query's rows, which are those of its SQL."""
    got = [r.asDict() for r in __spark_entry__.queries()[name](spark, sf).collect()]
    with duckdb.connect() as con:
        for table in ("nation", "customer", "orders", "events"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet/*.parquet'")
        found = con.execute(__spark_entry__.oracle_sql()[name])
        names = [c[0] for c in found.description]
        sql = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    key = lambda r: repr(sorted(r.items()))
    assert sorted(got, key=key) == sorted(sql, key=key)
    return got


def test_games_page(spark, sf):
    got = run(spark, sf, "games_page")
    newest = sorted(GAMES, key=lambda k: (-day(k).toordinal(), str(k)))
    assert [(r["game_id"], r["home_team_abbr"], r["away_team_abbr"]) for r in got] == [(str(k), *GAMES[k]) for k in newest[50:100]]


def test_quarter_recent(spark, sf):
    got = run(spark, sf, "quarter_recent")
    ours = sorted((k for k in GAMES if "NATION_7" in GAMES[k] and k % 3 != 2), key=lambda k: (-day(k).toordinal(), str(k)))
    assert [(r["game_id"], r["home_team_abbr"], r["away_team_abbr"]) for r in got] == [(str(k), *GAMES[k]) for k in ours[:10]] and len(got) == 10


def test_game_detail(spark, sf):
    got = run(spark, sf, "game_detail")
    assert [(r["game_id"], r["home_team_abbr"], r["away_team_abbr"]) for r in got] == [("100", "NATION_3", "NATION_10")]
    twice = spark.createDataFrame([("100", "a"), ("7", "b"), ("100", "c")], "game_id string, home_team_abbr string")
    assert sorted(r.home_team_abbr for r in games.game_detail(twice, "100").collect()) == ["a", "c"]


def test_player_performance(spark, sf):
    got = run(spark, sf, "player_performance")
    nation = lambda k: CUSTOMERS.get(ORDERS.get(k))
    name = lambda k, side: NATIONS.get((nation(k) + 7 * side) % 25, "") if nation(k) is not None else ""
    assert {(r["gameid"], r["team"]) for r in got} == {(str(k), "T2" if e % 5 == 2 else name(k, e % 5)) for e, k in EVENTS}
    assert sum(r["fgm"] for r in got) == len(EVENTS)


def test_status_recent_games(spark, sf):
    got = run(spark, sf, "status_recent_games")
    newest = sorted(GAMES, key=lambda k: (-day(k).toordinal(), str(k)))
    assert [(r["game_id"], r["date"], r["home"], r["away"]) for r in got] == [(str(k), f"{day(k):%Y-%m-%d}", *GAMES[k]) for k in newest[:10]]
