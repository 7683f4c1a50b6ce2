"""Pages, trigrams, partial states, ingested batches, buckets and watched tables against the plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from statforge.functions import exprs
from statforge.operators import boxscore, metrics
from statforge.operators.partials import PartialStates
from statforge.sources import catalog, paged, store, trigrams
from statforge.streaming import ingest

ROWS = "id long, name string, note string, x double"


def table(spark, n=400):
    r = random.Random(n)
    words = ["Al", "Bo_", "ceD", "100%", "é", "ÀB", "\\", "x y", "", "naïve"]
    rows = [(i, r.choice([None, "".join(r.choice(words) for _ in range(r.randint(0, 6)))]), r.choice([None, "note", "Bo_al"]), r.choice([None, 1.0, 2.0, float(r.randint(0, 40))])) for i in range(n)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, ROWS).repartition(3)


def files_read(df):
    """Files that the scans of an executed DataFrame have read."""
    df.collect()

    def leaves(plan):
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return leaves(plan.executedPlan())
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            return leaves(plan.plan())
        children = plan.children()
        if not children.size():
            return [plan]
        return [x for i in range(children.size()) for x in leaves(children.apply(i))]

    counts = [p.metrics().get("numFiles") for p in leaves(df._jdf.queryExecution().executedPlan())]
    return sum(c.get().value() for c in counts if c.isDefined())


@pytest.mark.parametrize(("sort", "descending"), [("x", True), ("x", False), (None, False), ("no such", True)])
def test_pages_equal_browse(spark, tmp_path, sort, descending):
    df = table(spark)
    pages = paged.write_paged(df, str(tmp_path), ["id"], sort, descending, rows=50)
    assert pages.count(spark) == 400
    for page, size in ((1, 7), (3, 50), (8, 50), (9, 50), (2, 333), (0, 10)):
        want = catalog.browse(df, ["id"], sort=sort, descending=descending, page=page, size=size)
        got = pages.page(spark, page, size)
        assert got.columns == df.columns and got.collect() == want.collect()
    # Key by key: the whole table in its order, nulls and ties included.
    every = df.orderBy(*(b.order() for b in pages.order)).collect()
    seen = pages.page(spark, 1, 90).collect()
    while True:
        more = pages.after(spark, {b.column: seen[-1][b.column] for b in pages.order}, 90).collect()
        if not more:
            break
        seen += more
    assert seen == every


def test_a_late_page_reads_one_range(spark, tmp_path):
    df = spark.range(20_000).select("id", (F.col("id") * 7919 % 20_011).alias("x"))
    pages = paged.write_paged(df, str(tmp_path), ["id"], "x", rows=1000)
    page = pages.page(spark, 1000, 10)
    assert [r.id for r in page.collect()] == [r.id for r in df.orderBy("x").offset(9990).limit(10).collect()]
    assert files_read(page) <= 2
    assert files_read(pages.after(spark, {"x": 12_000, "id": 0}, 10)) <= 2
    assert files_read(spark.read.parquet(f"{tmp_path}/rows")) >= 15


def test_pages_of_an_empty_table(spark, tmp_path):
    pages = paged.write_paged(table(spark).limit(0), str(tmp_path), ["id"])
    assert pages.count(spark) == 0 and pages.page(spark).collect() == [] and pages.after(spark, {"id": 3}).collect() == []


def test_literal_runs():
    assert trigrams.literal_runs("ab%C_\\%d\\_e") == ["ab", "c", "%d_e"]
    assert trigrams.literal_runs("%_") == [] and trigrams.literal_runs("x") == ["x"]


def test_trigram_search_equals_the_scan(spark, tmp_path):
    df = table(spark)
    index = trigrams.write_trigrams(df, str(tmp_path), ["name", "note"], "id", rows=40, shards=8)
    for name in ("albo", "AL", "bo_al", "ced%al", "100\\%", "\\\\bo", "x y", "é100", "àb", "note", "a_%e", "nothing here", "%%", "ïve", "bo\\_"):
        want = catalog.search(df, name, ["name", "note"], ["name", "id"], 100)
        assert index.search(spark, name, ["name", "id"], 100).collect() == want.collect(), name
    with pytest.raises(ValueError, match="two characters"):
        index.search(spark, " a ", ["id"])


def test_trigrams_of_an_empty_table(spark, tmp_path):
    index = trigrams.write_trigrams(table(spark).limit(0), str(tmp_path), ["name"], "id")
    assert index.search(spark, "abc", ["id"]).collect() == [] and index.search(spark, "ab", ["id"]).columns == ["id", "name", "note", "x"]


def test_trigram_search_reads_fewer_files(spark, tmp_path, monkeypatch):
    df = spark.range(5000).select("id", F.concat(F.lit("player "), F.lpad("id", 6, "0")).alias("name"))
    index = trigrams.write_trigrams(df, str(tmp_path), ["name"], "id", rows=500, shards=16)
    scan = files_read(spark.read.parquet(f"{tmp_path}/rows"))
    found = index.search(spark, "r 00421", ["id"], 100)
    assert [r.id for r in found.collect()] == list(range(4210, 4220)) and scan >= 8
    assert files_read(index.search(spark, "r 00421", ["id"], 100)) <= 2
    grams = files_read(index._candidates(spark, ["421", "042"]))
    assert grams < files_read(spark.read.parquet(f"{tmp_path}/grams"))
    # Where candidates are in more ranges than a filter may name, the table is scanned; the rows are the same.
    monkeypatch.setattr(trigrams, "MOST_RANGES", 0)
    assert index.search(spark, "r 00421", ["id"], 100).collect() == found.collect()


FACTS = "player_id string, season int, team string, g long, pts double, trb double, ast double, stl double, blk double, tov double, fga double, fg double, fta double, ft double, x3p double, usg_percent double"


def season_rows(r, n):
    value = lambda: r.choice([None, float(r.randint(0, 30))])
    return [(r.choice(["a", "b", "c", None, ""]), r.choice([1999, 2000]), "T", r.choice([None, 0, 5]), *(value() for _ in range(12))) for _ in range(n)]


def test_partial_states_merge(spark, tmp_path):
    r = random.Random(2)
    batches = [spark.createDataFrame(season_rows(r, n), FACTS) for n in (40, 1, 25)]
    specs = metrics.all_metrics()
    states = PartialStates(str(tmp_path), specs)
    for i in (0, 1):
        states.put(f"b{i}", batches[i])
    before = states.evaluate_many(spark, 2000).count()
    states.put("b2", batches[2])
    states.put("b1", batches[1])  # again: nothing changes
    every = batches[0].unionByName(batches[1]).unionByName(batches[2])
    for season in (1999, 2000):
        want = metrics.evaluate_many(catalog.load_season(every, season), specs).orderBy("player_id").collect()
        assert states.evaluate_many(spark, season).orderBy("player_id").collect() == want and before
    some = states.evaluate_many(spark, 2000, ["ft_rate"])
    assert some.columns == ["player_id", "ft_rate"] and states.evaluate_many(spark, 1950).collect() == []
    with pytest.raises(ValueError, match="merged: odd"):
        PartialStates(str(tmp_path), [metrics.MetricSpec("odd", "expression", "season_facts", ("pts",), lambda: F.stddev("pts"))])
    with pytest.raises(ValueError, match="name"):
        states.put("a/b", batches[0])


def test_a_new_batch_reads_the_new_rows_only(spark, tmp_path):
    r = random.Random(5)
    for i in range(4):
        spark.createDataFrame(season_rows(r, 30), FACTS).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    states = PartialStates(str(tmp_path / "states"), metrics.all_metrics())
    for i in range(3):
        states.put(str(i), spark.read.parquet(str(tmp_path / f"in{i}")))
    was = {p: p.stat().st_mtime_ns for p in (tmp_path / "states").rglob("*.parquet")}
    for i in range(3):
        (tmp_path / f"in{i}").rename(tmp_path / f"gone{i}")
    states.put("3", spark.read.parquet(str(tmp_path / "in3")))
    every = spark.read.parquet(*(str(tmp_path / f"gone{i}") for i in range(3)), str(tmp_path / "in3"))
    want = metrics.evaluate_many(catalog.load_season(every, 2000), metrics.all_metrics())
    assert sorted(states.evaluate_many(spark, 2000).collect()) == sorted(want.collect())
    assert all(p.stat().st_mtime_ns == t for p, t in was.items())


LOG = "gameid string, br_player_id string, created_at int, pts double"


def test_batches_are_appended_once(spark, tmp_path):
    folder, home = tmp_path / "in", str(tmp_path / "log")
    folder.mkdir()
    stream = spark.readStream.schema(LOG).parquet(str(folder))
    names = []
    writer = lambda: ingest.ingest(stream, home, str(tmp_path / "c"), lambda rows, name: names.append((name, rows.count()))).trigger(availableNow=True)
    batches = [[("g", "1", 1, 1.0), ("g", "2", 1, 2.0)], [("g", "1", 2, 9.0), ("h", "1", None, 4.0)]]
    for rows in batches:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(folder))
        q = writer().start()
        assert q.awaitTermination(60)
    every = sorted(map(tuple, ingest.appended(spark, home).collect()), key=repr)
    assert every == sorted((r for b in batches for r in b), key=repr) and names == [("0", 2), ("1", 2)]
    # A batch that failed half way, or is run again: the table and the latest rows stay as they are.
    for number, rows in enumerate(batches):
        for _ in range(2):
            ingest.append_batch(spark.createDataFrame(rows, LOG), home, number)
    assert sorted(map(tuple, ingest.appended(spark, home).collect()), key=repr) == every
    latest = {(r.gameid, r.br_player_id): r.pts for r in ingest.latest(spark, home).collect()}
    assert latest == {("g", "1"): 9.0, ("g", "2"): 2.0, ("h", "1"): 4.0}
    q = writer().start()  # nothing new: no batch
    assert q.awaitTermination(60) and len(names) == 2


def test_bucketed_tables_need_no_shuffle(spark, tmp_path):
    log = spark.createDataFrame([(f"g{i % 7}", str(i % 3), i, float(i), "A", "P") for i in range(60)], "gameid string, br_player_id string, created_at int, pts double, team string, player_name string")
    games = spark.createDataFrame([(f"g{i}", "Regular", None, "A", "B", 1, 2) for i in range(5)], "game_id string, season_type string, game_date date, home_team_abbr string, away_team_abbr string, home_pts int, away_pts int")
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lying = store.write_bucketed(log, "log_by_game", "gameid", 4, ("created_at",), str(tmp_path / "log"))
        context = store.write_bucketed(games, "games_by_game", "game_id", 4, path=str(tmp_path / "games"))
        forms = {
            "context": (lambda a, b: catalog.gamelog_with_games(a, b)),
            "latest": (lambda a, b: boxscore.latest_gamelog(a)),
            "box": (lambda a, b: a.groupBy("gameid", "team").agg(F.sum("pts").alias("pts"))),
        }
        for name, form in forms.items():
            got = form(lying, context)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan, name
            assert sorted(got.collect(), key=repr) == sorted(form(log, games).collect(), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        spark.sql("DROP TABLE IF EXISTS log_by_game")
        spark.sql("DROP TABLE IF EXISTS games_by_game")


def test_drift_is_seen_while_a_query_runs(spark):
    schema = catalog.TableSchema("t", "season", "player_id", {"pts": "double", "season": "int"})
    df = spark.createDataFrame([(1999, "a", "3.5"), (None, "a", "x"), (1999, None, None), (1999, "a", "7")], "season int, player_id string, pts string")
    watched, seen = catalog.watched(df, schema)
    assert watched.groupBy("player_id").count().count() == 2  # some query: one action
    assert seen.get["rows"] == 4 and seen.get["distinct_keys"] == 3
    assert catalog.value_drift(seen, schema) == ["t: 1 rows without season", "t: 1 rows without player_id", "t: 1 values of pts are no double"]


def test_sketched_quartiles(spark):
    error, n = 0.01, 20_000
    values = sorted(random.Random(1).lognormvariate(0, 3) for _ in range(n))
    df = spark.createDataFrame([(v,) for v in values], "v double")
    box = df.agg(*exprs.five_numbers("v", error)).first()
    exact = df.agg(*exprs.five_numbers("v")).first()
    for share, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
        assert values[int(n * (share - error)) - 1] <= box[name] <= values[int(n * (share + error)) + 1]
        assert values[int(n * share) - 2] <= exact[name] <= values[int(n * share) + 2]
    assert (box["min"], box["max"]) == (exact["min"], exact["max"])
    assert tuple(df.limit(0).agg(*exprs.five_numbers("v", error)).first()) == (0.0,) * 5


def test_table_profile(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, None, "y")], "a int, `b.c` double, d string")
    assert [tuple(r) for r in catalog.table_profile(df).orderBy("ordinal").collect()] == [(1, "a", "int", 1, 2), (2, "b.c", "double", 0, 2), (3, "d", "string", 2, 2)]
