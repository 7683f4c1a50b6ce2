"""Possession and box scores against sequential models."""

import datetime
import random
import time

from pyspark.sql import functions as F

from statforge.operators import boxscore, possession

SCHEMA = "gameid string, eventnum int, period int, clock_seconds double, event_type string, subtype string, team string, player string, br_player_id string, description string"


def random_events(seed):
    r = random.Random(seed)
    kinds = ["Made Shot", "Missed Shot", "Rebound", "Turnover", "Foul"]
    return [(f"g{g}", n, 1 + n // 20, r.choice([None, 0.0, float(r.randint(1, 100))]), r.choice(kinds), r.choice(["3pt", "", None]), r.choice(["A", "B", None, ""]), r.choice(["x", "y", "", None]), None, None) for g in range(5) for n in range(60)]


def model(rows, keep_first):
    out, state = [], {}
    for g, n, _, clock, kind, *_ in sorted(rows):
        if kind in ("Rebound", "Turnover"):
            state[g] = clock
        elif kind in possession.SHOTS:
            start = state.get(g)
            if start is None and keep_first:
                start = state[g] = clock
            out.append((g, n, start - clock if start and clock else 0.0))
            if kind == "Made Shot":
                state[g] = clock
    return sorted(out)


def test_possession(spark):
    for seed in range(3):
        rows = random_events(seed)
        df = spark.createDataFrame(rows, SCHEMA)
        for keep in (True, False):
            got = possession.shots_with_elapsed(df, keep).select("gameid", "eventnum", "elapsed").collect()
            assert sorted(map(tuple, got)) == model(rows, keep)


def test_late_clock_counts(spark):
    df = spark.createDataFrame(random_events(9), SCHEMA)
    teams = possession.late_clock_teams(df).collect()
    assert {t.team for t in teams} == {"A", "B"} and all(t.late_shots + t.early_shots == t.total_shots for t in teams)
    assert all(p.total_shots >= 3 and p.player for p in possession.late_clock_players(df, min_shots=3).collect())


def test_contributions(spark):
    e = lambda n, kind, text, period=1, player="P1", team="A": ("g", n, period, 10.0 * n, kind, "", team, player, None, text)
    rows = [
        e(1, "Made Shot", "P1 3-pt shot (Assist by K. Long)"), e(2, "Made Shot", "layup Assisted by Bob Day, fast"), e(3, "Missed Shot", "3pt miss"), e(4, "Free Throw", "make 1 of 2"),
        e(5, "Free Throw", "miss 2 of 2"), e(6, "Rebound", "offensive rebound"), e(7, "Rebound", "rebound"), e(8, "", "Steal by P1"), e(9, "Foul", "Block by P1", period=None),
        e(10, "Unknown", "whatever"), e(11, "Substitution", "SUB: New Guy FOR P1"), e(12, "Turnover", None), e(13, "Made Shot", "layup", player=""),
    ]
    df = boxscore.player_periods(spark.createDataFrame(rows, SCHEMA), with_details=True)
    got = {r.player: r for r in df.collect()}
    p = got["P1"]
    assert (p.pts, p.fgm, p.fga, p.fg3m, p.fg3a, p.ftm, p.fta, p.reb, p.oreb, p.dreb, p.stl, p.blk, p.tov, p.pf) == (6, 2, 3, 1, 2, 1, 2, 2, 1, 1, 1, 1, 1, 0)
    assert got["K"].ast == 1 and got["Bob Day"].ast == 1 and got["New Guy"].time_in == "110.0" and p.time_out == "110.0"
    assert len(p.made_shots) == 2 and set(got) == {"P1", "K", "Bob Day", "New Guy"}


def test_latest_gamelog_null_time_wins(spark):
    log = spark.createDataFrame([("g", "1", None, 5.0), ("g", "1", 9, 7.0), ("g", None, 9, 7.0)], "gameid string, br_player_id string, created_at int, pts double")
    assert [r.pts for r in boxscore.latest_gamelog(log).collect()] == [5.0]


def test_match_gamelog(spark):
    players = spark.createDataFrame([("g", "Al Long Jr.", "A", None), ("g", "Bo Day", "B", "7"), ("g", "Cy Kim", "A", "99"), ("g", "", "A", None)], "gameid string, player string, team string, br_player_id string")
    log = spark.createDataFrame([("g", "1", "X Long", "A", 0, 0, 0), ("g", "2", "Y Long", "B", 3, 0, 0), ("g", "7", "Bo Day", "B", 0, 0, 0), ("g", "8", "Zed Kim", "B", 0, 0, 0)], "gameid string, br_player_id string, player_name string, team string, ast int, stl int, blk int")
    got = {r.player: r.matched_id for r in boxscore.match_gamelog(players, log).collect()}
    assert got == {"Al Long Jr.": "2", "Bo Day": "7", "Cy Kim": "8", "": None}


def test_preferred_totals(spark):
    """A player of the log, by id or by last name, has its record whole, nulls as 0; another the sums over periods."""
    e = lambda n, player, kind, period, who=None: ("g", n, period, 5.0, kind, "", "A", player, who, "layup")
    rows = [e(1, "Al Long", "Made Shot", 1, "1"), e(2, "Al Long", "Rebound", 2, "1"), e(3, "Bo Day", "Made Shot", 1), e(4, "Cy Kim", "Made Shot", 1), e(5, "Cy Kim", "Made Shot", 2), e(6, "Cy Kim", "Turnover", 2)]
    log = spark.createDataFrame([("g", "1", "Al Long", "A", 31.0, None, 4.0, 2.0), ("g", "8", "B. Day", "B", None, 7.0, None, 1.0)], "gameid string, br_player_id string, player_name string, team string, pts double, reb double, ast double, stl double")
    log = log.withColumns({c: F.lit(None).cast("double") for c in ("blk", "tov", "pf")})
    for details in (True, False):
        played = boxscore.performance(spark.createDataFrame(rows, SCHEMA), log, details)
        assert ("made_shots" in played.columns) == details
        got = {r.player: r for r in boxscore.preferred_totals(played).collect()}
        assert (got["Al Long"].pts, got["Al Long"].reb, got["Al Long"].ast, got["Al Long"].stl, got["Al Long"].fgm, got["Al Long"].from_log) == (31.0, 0.0, 4.0, 2.0, 0.0, True)
        assert (got["Bo Day"].matched_id, got["Bo Day"].pts, got["Bo Day"].reb) == ("8", 0.0, 7.0)
        assert (got["Cy Kim"].pts, got["Cy Kim"].fgm, got["Cy Kim"].tov, got["Cy Kim"].from_log) == (4.0, 2.0, 1.0, False)
    assert [r.player for r in boxscore.preferred_totals(played).collect()] == ["Al Long", "Cy Kim", "Bo Day"]


def test_possession_in_chunks(spark):
    """Chunks of any size, numbers with gaps, a game without an id and one with a single long possession."""
    rows = [(*r[:1], r[1] * 3 - 50, *r[2:]) for r in random_events(11)]
    rows += [(None, n, 1, float(n % 7 + 1), k, *[None] * 5) for n, k in enumerate(["Missed Shot"] * 40 + ["Rebound"] + ["Missed Shot"] * 40)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", __era string").drop("__era").repartition(3)
    for keep in (True, False):
        want = sorted(model([r for r in rows if r[0]], keep) + [("~", *x[1:]) for x in model([("~", *r[1:]) for r in rows if r[0] is None], keep)])
        for chunk in (1, 2, 7, 64, 4096):
            out = possession.shots_with_elapsed(df, keep, chunk)
            assert out.columns == [*df.columns, "elapsed"]
            got = out.select(F.coalesce("gameid", F.lit("~")), "eventnum", "elapsed").collect()
            assert sorted(map(tuple, got)) == want, (keep, chunk)
    assert possession.shots_with_elapsed(df.limit(0), True).count() == 0


def test_possession_has_no_window_over_a_game(spark, capsys):
    possession.shots_with_elapsed(spark.createDataFrame(random_events(1), SCHEMA), True).explain("formatted")
    plan = capsys.readouterr().out
    specs = [line for line in plan.splitlines() if "windowspecdefinition(" in line]
    over_a_game = [line for line in specs if "windowspecdefinition(__game" in line and "__chunk#" not in line.split("windowspecdefinition(", 1)[1].split("ASC")[0]]
    assert specs and not over_a_game


EVENT = "gameid string, eventnum long, clock_seconds double, event_type string, team string, player string, ts timestamp"


def stream_of(spark, tmp_path, **options):
    """A running query over a folder, and a function that adds a file of rows (game, number, clock, kind, minute)."""
    from statforge.streaming.late_clock import stream_shots

    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(folder))
    name = f"shots_{tmp_path.name}".replace("-", "_")
    q = stream_shots(stream, lateness="2 minutes", **options).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    start = datetime.datetime(2024, 1, 1)
    sent = []

    def taken():
        if "ttl_ms" not in options:
            return q.processAllAvailable()
        # With processing time there is always another batch, for time goes on.
        until = time.monotonic() + 60
        while sum(p["numInputRows"] for p in q.recentProgress) < sum(sent) and time.monotonic() < until:
            time.sleep(0.2)

    def add(*rows):
        sent.append(len(rows))
        made = [(g, n, c, k, "A", "x", start + datetime.timedelta(minutes=m)) for g, n, c, k, m in rows]
        spark.createDataFrame(made, EVENT).coalesce(1).write.mode("append").parquet(str(folder))
        taken()
        return sorted((r.gameid, r.eventnum, r.elapsed) for r in spark.table(name).collect())

    return q, add


def state_rows(q):
    return q.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_stream_orders_rows_and_ends_state(spark, tmp_path):
    q, add = stream_of(spark, tmp_path, idle_ms=10 * 60_000)
    try:
        assert add(("g", 1, 100.0, "Rebound", 0), ("g", 4, 70.0, "Missed Shot", 3)) == []
        # Number 3 comes after number 4, but before the watermark has passed either; number 2 comes too late.
        add(("g", 3, 90.0, "Turnover", 2.5))
        got = add(("h", 1, 50.0, "Missed Shot", 6))
        assert got == [("g", 4, 20.0)]
        assert add(("g", 2, 95.0, "Made Shot", 1), ("h", 2, 40.0, "Rebound", 6.5)) == got
        kept = state_rows(q)
        # An hour later both games' state has gone: a shot finds no start.
        add(("x", 1, 1.0, "Rebound", 60))
        add(("x", 2, 1.0, "Rebound", 61))
        assert state_rows(q) < kept or kept == 0
        add(("g", 9, 10.0, "Missed Shot", 62), ("x", 3, 9.0, "Rebound", 63))
        last = add(("x", 4, 1.0, "Rebound", 90))
        assert ("g", 9, 0.0) in last and ("h", 1, 0.0) in last
    finally:
        q.stop()


def test_stream_by_processing_time(spark, tmp_path):
    q, add = stream_of(spark, tmp_path, ttl_ms=3_600_000, keep_first_shot=True)
    try:
        rows = [r for r in random_events(4) if r[4] != "Foul"]
        half = len(rows) // 2
        add(*((*r[:2], r[3], r[4], 0) for r in rows[:half]))
        got = add(*((*r[:2], r[3], r[4], 0) for r in rows[half:]))
        assert got == model(rows, True)
    finally:
        q.stop()


def test_stream_equals_batch(spark, tmp_path):
    """Rows in any order within the lateness: the same shots as the whole table gives."""
    q, add = stream_of(spark, tmp_path)
    try:
        rows = random_events(5)
        random.Random(1).shuffle(rows)
        for i in range(3):
            add(*((*r[:2], r[3], r[4], r[1] / 60) for r in rows[i::3]))
        got = add(("end", 1, 1.0, "Rebound", 500))
        got = add(("end", 2, 1.0, "Rebound", 501))
        assert got == model(rows, False)
    finally:
        q.stop()
