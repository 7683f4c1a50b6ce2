"""Registered queries over layouts and states that the library writes: pages, trigrams, partial states, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import metrics
from .operators.partials import PartialStates
from .registered import _Q, _SQL, SEASON, TIES, _raw
from .sources.paged import write_paged
from .sources.roles import role
from .sources.store import shared_home
from .sources.trigrams import write_trigrams
from .streaming import ingest


def _pages(spark, sf_dir):
    """Customers by balance, downwards, in ranges of 200 rows."""
    return write_paged(_raw(spark, sf_dir, "customer"), shared_home(spark, "pages"), ["c_custkey"], "c_acctbal", True, rows=200)


_Q["table_page_by_ranges"] = lambda spark, d: _pages(spark, d).page(spark, 3, 60)
_SQL["table_page_by_ranges"] = "SELECT * FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 60 OFFSET 120"


def _page_after(spark, sf_dir):
    customer = _raw(spark, sf_dir, "customer").filter("c_custkey = 77").select("c_acctbal").first()
    return _pages(spark, sf_dir).after(spark, {"c_acctbal": customer.c_acctbal, "c_custkey": 77}, 80)


_Q["table_page_after_key"] = _page_after
_SQL["table_page_after_key"] = """
SELECT c.* FROM customer c, (SELECT c_acctbal AS bal FROM customer WHERE c_custkey = 77)
WHERE c_acctbal < bal OR (c_acctbal = bal AND c_custkey > 77) ORDER BY c_acctbal DESC, c_custkey LIMIT 80"""


def _search(spark, sf_dir):
    """Customers by a substring with a wildcard in it."""
    rows = _raw(spark, sf_dir, "customer")
    return write_trigrams(rows, shared_home(spark, "trigrams"), ["c_name"], "c_custkey", rows=200, shards=16).search(spark, "R#000000_33", ["c_name", "c_custkey"], 100)


_Q["search_by_trigrams"] = _search
_SQL["search_by_trigrams"] = "SELECT * FROM customer WHERE c_name ILIKE '%R#000000_33%' ORDER BY c_name, c_custkey LIMIT 100"


def _states(spark, sf_dir):
    """A season's metrics from three batches, one of which arrives twice."""
    facts = role(spark, sf_dir, "season_facts", SEASON).filter(F.col("season") == SEASON)
    states = PartialStates(shared_home(spark, "states"), metrics.all_metrics())
    for batch in (0, 1, 2, 1):
        states.put(f"b{batch}", facts.filter(F.pmod(F.hash("team", "pos"), F.lit(3)) == batch))
    return states.evaluate_many(spark, SEASON)


_Q["metrics_from_batches"] = _states
_SQL["metrics_from_batches"] = _SQL["compute_many_all"]


def _ingested(spark, sf_dir):
    """The latest rows of a game log that came in two batches, the first of them twice."""
    home, log = shared_home(spark, "gamelog"), role(spark, sf_dir, "gamelog")
    for batch in (0, 1, 0):
        ingest.append_batch(log.filter(F.col("l_suppkey") % 2 == batch), home, batch)
    return ingest.latest(spark, home, TIES).select("gameid", "br_player_id", "created_at", "pts", "l_partkey", "l_suppkey")


_Q["latest_of_batches"] = _ingested
_SQL["latest_of_batches"] = _SQL["dedup_latest_gamelog"]
