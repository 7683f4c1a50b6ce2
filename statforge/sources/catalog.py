"""Table contracts, season policy, guards and browsing (SRC-*, FLT-01/02, SYS-01..04)."""

from __future__ import annotations

import logging
import re
import threading
import uuid
from dataclasses import dataclass, field

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Above this many ids, a broadcast semi join replaces IN (SRC-11).
ID_JOIN_FROM = 500
#: Names of text columns; a browse search looks at the first of a table's columns that is one (FLT-10).
SEARCH_COLUMNS = ("player_name", "full_name", "player", "team", "team_abbr", "team_name", "abbreviation", "game_id", "gameid", "position", "pos", "season_type", "split_type")


@dataclass(frozen=True)
class TableSchema:
    """A table's key columns; `types` are checked against the data as well."""

    name: str
    season_col: str | None = None
    entity_col: str | None = None
    types: dict[str, str] = field(default_factory=dict)


TABLES = {
    t.name: t
    for t in (
        TableSchema("season_facts", "season", "player_id", {"season": "int", "pts": "double", "g": "bigint"}),
        TableSchema("gamelog", "season", "br_player_id", {"gameid": "string"}),
        TableSchema("players", None, "player_id", {"player_name": "string"}),
        TableSchema("games", "season", None, {"game_id": "string"}),
        TableSchema("events", "season", None, {"gameid": "string", "eventnum": "bigint"}),
        TableSchema("team_seasons", "season", None, {"abbreviation": "string"}),
    )
}


def get_schema(name: str) -> TableSchema:
    if name not in TABLES:
        raise KeyError(f"unknown table {name}; known: {', '.join(sorted(TABLES))}")
    return TABLES[name]


def season_required(name: str) -> bool:
    return get_schema(name).season_col is not None


def require_season(season: int) -> int:
    """FLT-01: an int in 1900..2100."""
    if not isinstance(season, int) or isinstance(season, bool) or not 1900 <= season <= 2100:
        raise ValueError(f"season must be an int from 1900 to 2100, not {season!r}")
    return season


def in_list(column: str, ids: list) -> Column:
    """FLT-02."""
    if not ids:
        raise ValueError("an id list must not be empty")
    return F.col(column).isin(*ids)


def load_season(df: DataFrame, season: int, season_col: str = "season") -> DataFrame:
    """SRC-03, SRC-04: the filter reaches the scan, or prunes partitions."""
    return df.filter(F.col(season_col) == require_season(season))


def load_by_ids(df: DataFrame, id_col: str, ids: list) -> DataFrame:
    """SRC-06, SRC-09..11, JOIN-03: set semantics by either way, so that repeated ids don't repeat rows."""
    if not ids:
        raise ValueError("an id list must not be empty")
    if len(ids) < ID_JOIN_FROM:
        return df.filter(in_list(id_col, list(dict.fromkeys(ids))))
    wanted = df.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(ids)], [id_col])
    return df.join(wanted, id_col, "left_semi")  # a local list: Spark knows its size and broadcasts it if small


def load_gamelog(df: DataFrame, season: int, ids: list | None = None, row_cap: int | None = None) -> DataFrame:
    """SRC-02: an optional cap guards unfiltered reads; it counts at most cap + 1 rows."""
    out = load_season(df, season)
    if ids is None:
        if row_cap is not None and out.limit(row_cap + 1).count() > row_cap:
            raise ValueError(f"more than {row_cap} rows; pass ids or lift the cap")
        return out
    return load_by_ids(out, "br_player_id", ids)


def load_games(df: DataFrame, season: int, season_type: str | None = None) -> DataFrame:
    """SRC-05: a falsy season_type means no filter."""
    out = load_season(df, season)
    return out.filter(F.col("season_type") == season_type) if season_type else out


def seasons_available(df: DataFrame, table: str) -> DataFrame:
    """SRC-07, SET-01."""
    col = get_schema(table).season_col
    if col is None:
        raise ValueError(f"{table} has no seasons")
    return df.select(F.col(col).alias("season")).filter("season is not null").distinct().orderBy(F.desc("season"))


def search(df: DataFrame, name: str, columns: list[str], order: list[str], limit: int = 20) -> DataFrame:
    """SRC-08, FLT-09: % and _ act as wildcards; limit is held within 1..100."""
    name = name.strip()
    if len(name) < 2:
        raise ValueError("a search needs two characters")
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).ilike(f"%{name}%")
    return df.filter(hit).orderBy(*(F.col(c).asc_nulls_last() for c in order)).limit(max(1, min(limit, 100)))


def browse(df: DataFrame, key: list[str], search_text: str | None = None, sort: str | None = None, descending: bool = False, page: int = 1, size: int = 50, more_columns: tuple[str, ...] = ()) -> DataFrame:
    """SYS-01, SRT-05/07, FLT-10: unknown sort columns are ignored; the key makes pages disjoint. more_columns:
    names that a search may look at besides SEARCH_COLUMNS."""
    size, page = max(1, min(size, 500)), max(1, page)
    df = searched(df, search_text, more_columns)
    order = [F.col(k).asc_nulls_last() for k in key]
    if sort in df.columns:
        order.insert(0, F.col(sort).desc_nulls_first() if descending else F.col(sort).asc_nulls_last())
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def searched(df: DataFrame, text: str | None, more_columns: tuple[str, ...] = ()) -> DataFrame:
    """FLT-10: rows whose first text column has the text; all rows if there is no text or no such column."""
    col = next((c for c in df.columns if c in SEARCH_COLUMNS or c in more_columns), None)
    return df.filter(F.col(col).ilike(f"%{text.strip()}%")) if text and text.strip() and col else df


def page_totals(df: DataFrame, search_text: str | None = None, size: int = 50, more_columns: tuple[str, ...] = ()) -> DataFrame:
    """SRT-07, MATH-06: one row with the rows that a search finds and their pages."""
    size = max(1, min(size, 500))
    return searched(df, search_text, more_columns).agg(F.count("*").alias("total"), F.ceil(F.count("*") / size).cast("long").alias("total_pages"))


def table_columns(df: DataFrame) -> DataFrame:
    """SRC-19: names and types in order."""
    rows = [(i + 1, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column_name string, data_type string")


def table_profile(df: DataFrame) -> DataFrame:
    """SRC-19 with what the rows say: name and type in order, and how many rows have a value, in one pass."""
    kinds = df.dtypes
    counts = df.agg(F.count(F.lit(1)).alias("row_count"), *(F.count(F.col(f"`{c}`")).alias(f"__{i}") for i, (c, _) in enumerate(kinds)))
    columns = F.array(*(F.struct(F.lit(i + 1).alias("ordinal"), F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), F.col(f"__{i}").alias("n_values")) for i, (c, t) in enumerate(kinds)))
    return counts.select("row_count", F.explode(columns).alias("c")).select("c.*", "row_count")


def gamelog_with_games(log: DataFrame, games: DataFrame) -> DataFrame:
    """JOIN-01: every row of the game log, with what its game has; the log's own season stays."""
    context = games.select("game_id", "season_type", "game_date", "home_team_abbr", "away_team_abbr", "home_pts", "away_pts")
    return log.join(context, log.gameid == context.game_id, "left").drop("game_id")


def season_stats_with_bios(facts: DataFrame, players: DataFrame) -> DataFrame:
    """JOIN-02: every row of the season, with the player's bio; its position is bio_position."""
    return facts.join(players.withColumnRenamed("position", "bio_position"), "player_id", "left")


def list_teams(mapping: DataFrame, active_only: bool = True) -> DataFrame:
    """SRC-17: an unknown is_active counts as inactive."""
    rows = mapping.filter("is_active") if active_only else mapping
    return rows.select(F.col("team_code").alias("team_abbr"), "team_name", "is_active").orderBy("team_abbr")


#: Sources of metrics: the table that each reads, and its entity column (SRC-12).
METRIC_SOURCES = {"season_facts": "player_id", "gamelog": "br_player_id"}


def metric_input(tables: dict[str, DataFrame], source: str, season: int, ids: list | None = None) -> tuple[DataFrame, str]:
    """SRC-12: the rows that a metric of this source needs, and their entity column; None means all ids, an empty list
    none of them."""
    if source not in METRIC_SOURCES:
        raise ValueError(f"no source {source}; known: {', '.join(available_sources())}")
    rows, key = load_season(tables[source], season), METRIC_SOURCES[source]
    if ids is None:
        return rows, key
    return (load_by_ids(rows, key, ids) if ids else rows.limit(0)), key


def available_sources() -> list[str]:
    """SRC-13."""
    return sorted(METRIC_SOURCES)


def player_bios(players: DataFrame, ids: list) -> DataFrame:
    """SRC-13: no ids, no rows."""
    return load_by_ids(players, "player_id", ids) if ids else players.limit(0)


def split_ids(text: str, digits_only: bool = False) -> list[str]:
    """STR-09: the parts of a comma list, without blanks."""
    parts = [p.strip() for p in text.split(",")]
    return [p for p in parts if p and (p.isdigit() or not digits_only)]


def unknown_names(asked: list[str], known: list[str]) -> list[str]:
    """SET-02: what was asked for and doesn't exist, in order."""
    have = set(known)
    return [n for n in dict.fromkeys(asked) if n not in have]


def table_counts(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """SRC-18, CHRT-08: one row for each table; counts come from Parquet footers."""
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("row_count"), "table_name")


def drift(df: DataFrame, schema: TableSchema) -> list[str]:
    """SYS-03: what a table lacks against its contract, types included."""
    types = dict(df.dtypes)
    found = [f"{schema.name}: no column {c}" for c in (schema.season_col, schema.entity_col) if c and c not in types]
    return found + [f"{schema.name}: {c} is {types.get(c)}, not {t}" for c, t in schema.types.items() if types.get(c) != t]


def watched(df: DataFrame, schema: TableSchema, approx_error: float = 0.02) -> tuple[DataFrame, Observation]:
    """SYS-03 on values, without a pass of its own: df as it is, and what any one action on it will have seen. The
    observation has `rows`, `null_<c>` for the schema's key columns, `bad_<c>` (values that are no <type>, for columns
    of other types than the contract's) and `distinct_keys`, approximate to `approx_error`; a table's keys are its
    season and entity."""
    seen = Observation(f"{schema.name}-{uuid.uuid4().hex[:8]}")
    keys = [c for c in (schema.season_col, schema.entity_col) if c and c in df.columns]
    types = dict(df.dtypes)
    found = [F.count(F.lit(1)).alias("rows")]
    found += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in keys]
    wrong = {c: t for c, t in schema.types.items() if c in types and types[c] != t}
    found += [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(f"bad_{c}") for c, t in wrong.items()]
    if keys:
        found.append(F.approx_count_distinct(F.struct(*keys), approx_error).alias("distinct_keys"))
    return df.observe(seen, *found), seen


def value_drift(seen: Observation, schema: TableSchema) -> list[str]:
    """What watched() saw against the contract, once an action has run: NULL keys and values of another type."""
    got = seen.get
    nulls = [f"{schema.name}: {n} rows without {c.removeprefix('null_')}" for c, n in got.items() if c.startswith("null_") and n]
    return nulls + [f"{schema.name}: {n} values of {c.removeprefix('bad_')} are no {schema.types[c.removeprefix('bad_')]}" for c, n in got.items() if c.startswith("bad_") and n]


#: Statements that are refused (SYS-04).
WRITES = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "GRANT", "REVOKE", "MERGE", "VACUUM")
_REFUSED = re.compile(rf"\b({'|'.join(WRITES)})\b", re.I)
_log = logging.getLogger("statforge.queries")
_tags = threading.local()


def read_only(spark: SparkSession, sql: str, query_id: str | None = None) -> DataFrame:
    """SRC-01, SYS-04: only a query. Statements' names are refused wherever they stand, and the parsed plan must hold
    no command. Each call has an id, which its jobs carry as a tag and which is logged (SYS-06)."""
    if not sql or not sql.strip().removeprefix("(").strip():
        raise ValueError("no SQL")
    if _REFUSED.search(sql):
        raise ValueError("only SELECT is allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    if is_instance_of(spark.sparkContext._gateway, plan, "org.apache.spark.sql.catalyst.plans.logical.Command"):
        raise ValueError("only SELECT is allowed")
    query_id = query_id or uuid.uuid4().hex[:12]
    # A lazy result's jobs come later: they carry the tag until this thread's next query takes its place.
    if getattr(_tags, "last", None) in spark.getTags():
        spark.removeTag(_tags.last)
    spark.addTag(query_id)
    _tags.last = query_id
    _log.info("query %s: %s", query_id, sql.strip()[:200])
    return spark.sql(sql)


def ping(spark: SparkSession) -> bool:
    """SRC-20."""
    return spark.sql("SELECT 1 AS one").first().one == 1
