"""All queries of the layout engine, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES (name -> callable) and ORACLES (name -> SQL).
MODULES: tuple[str, ...] = ("folia.operators.canvas", "folia.operators.charstream", "folia.operators.document", "folia.operators.geometry", "folia.operators.media", "folia.operators.routing", "folia.operators.rules", "folia.operators.sequence", "folia.plans.convert", "folia.plans.rendered")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(m).ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship"](spark, sf_dir)
