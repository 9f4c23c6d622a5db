"""All registered queries over the driver's tables, collected from the carriers' modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("web", "postings", "listings", "series", "evidence", "resolve", "sources", "discovery")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= import_module(f"lodestone.carriers.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"lodestone.carriers.{name}").ORACLES
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next(iter(queries().values()))(spark, sf_dir)
