"""Names of queries, each with its Spark form and, where SQL can express it, its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules that hold QUERIES (name -> function) and ORACLES (name -> DuckDB SQL).
MODULES: tuple[str, ...] = ("text_plans", "units_plans", "voice_plans", "speaker_plans", "cast_plans", "stream_plans", "evidence_plans")


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"parlance.plans.{name}"), what)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
