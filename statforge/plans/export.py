"""Exports (SNK-01..05): small ordered results as JSON or CSV, with a digest; the clock can be passed."""

from __future__ import annotations

import csv
import io
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from ..operators.metrics import content_digest


def _stamp(as_of: datetime | None) -> str:
    return (as_of or datetime.now(UTC)).strftime("%Y%m%d")


def rankings_json(ranked: DataFrame, metric: str, season: int, limit: int, as_of: datetime | None = None, key: str = "player_id") -> tuple[str, str]:
    """(text, SHA-256); sliced after ranking."""
    rows = [r.asDict() for r in ranked.orderBy("rank", key).limit(limit).collect()]
    text = json.dumps({"metric": metric, "season": season, "as_of": _stamp(as_of), "rankings": rows}, sort_keys=True, indent=2)
    return text, content_digest(text)


def rankings_csv(ranked: DataFrame, limit: int, key: str = "player_id") -> tuple[str, str]:
    return _csv(["rank", key, "value", "percentile"], ranked.orderBy("rank", key).limit(limit))


def vs_json(vs: DataFrame, one: str, two: str, season: int, as_of: datetime | None = None) -> tuple[str, str]:
    metrics = {r["metric"]: {"p1": r["p1"], "p2": r["p2"]} for r in vs.collect()}
    text = json.dumps({"p1": one, "p2": two, "season": season, "as_of": _stamp(as_of), "metrics": metrics}, sort_keys=True, indent=2)
    return text, content_digest(text)


def vs_csv(vs: DataFrame) -> tuple[str, str]:
    return _csv(["metric", "p1", "p2"], vs.orderBy("metric"))


def player_json(metrics: DataFrame, player: str, season: int, as_of: datetime | None = None, key: str = "player_id") -> tuple[str, str]:
    row = metrics.filter(metrics[key] == player).first()
    values = {k: v for k, v in (row.asDict() if row else {}).items() if k != key and v is not None}
    text = json.dumps({"player_id": player, "season": season, "as_of": _stamp(as_of), "metrics": values}, sort_keys=True, indent=2)
    return text, content_digest(text)


def league_files(metrics: DataFrame, path: str, key: str = "player_id") -> None:
    """SNK-04 at any size: JSON lines, ordered by id, written by the executors."""
    metrics.sort(key).write.mode("overwrite").json(path)


def _csv(header: list[str], df: DataFrame) -> tuple[str, str]:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(header)
    w.writerows([["" if r[c] is None else r[c] for c in header] for r in df.collect()])
    return out.getvalue(), content_digest(out.getvalue())
