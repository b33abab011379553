"""All registered queries and their SQL twins.

A query is a function of ``Tables``; its twin is SQL on the driver's tables, with the views that it names put before it.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from peakforge.sources.fixtures import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable:
    """Register a function of ``Tables`` under ``name``; ``views`` names the views that ``sql`` reads."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql, *views.split())
        return f

    return add


for _module in ("matching", "listings", "spectra", "analytics", "chemistry", "formulas", "patterns", "records", "fragments", "alignment", "calibration", "assignment", "isotopes", "compositions", "details", "reference", "streams"):
    importlib.import_module(f"peakforge.plans.{_module}")
