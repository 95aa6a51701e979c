"""The registered queries of the engine's own operators, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("label_queries", "profile_queries", "feature_queries", "decision_queries", "model_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for m in MODULES for q in import_module(f"tributary.plans.{m}").QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"tributary.plans.{m}").SQL.items()}
