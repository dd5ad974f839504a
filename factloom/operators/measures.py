"""Counters, histograms and the log."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def histogram(rows: DataFrame, by: list[str], value: str, bounds: tuple[float, ...]) -> DataFrame:
    """by, count, total, and le_i for each bound: cumulative, so a value counts in every bucket whose bound it doesn't exceed."""
    buckets = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return rows.groupBy(*by).agg(F.count(value).alias("count"), F.sum(value).alias("total"), *buckets)


def observed(rows: DataFrame, name: str, value: str | None = None) -> tuple[DataFrame, Observation]:
    """``rows`` with counters that fill when an action runs, at no extra pass."""
    o = Observation(name)
    return rows.observe(o, F.count(F.lit(1)).alias("rows"), *([F.sum(value).alias("total")] if value else [])), o


class Counters:
    """Named counters that fill as the tables they observe are used, and a snapshot of those that have."""

    def __init__(self):
        self._open: dict[str, Observation] = {}

    def count(self, rows: DataFrame, name: str, value: str | None = None) -> DataFrame:
        out, self._open[name] = observed(rows, name, value)
        return out

    def snapshot(self, *names: str) -> dict[str, dict]:
        """The counters' values; waits for tables that have not been used yet, so name those that have."""
        return {n: self._open[n].get for n in names or self._open}


class _Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"level": record.levelname, "logger": record.name, "message": record.getMessage()} | ({"error": self.formatException(record.exc_info)} if record.exc_info else {}))


def set_up_log(level: str = "INFO", as_json: bool = False) -> logging.Logger:
    """The package's logger with one handler; called again, it only changes level and format."""
    log = logging.getLogger("factloom")
    log.setLevel(level)
    if not log.handlers:
        log.addHandler(logging.StreamHandler())
    log.handlers[0].setFormatter(_Json() if as_json else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    return log
