"""Registered queries of the photogrammetry operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from prismgrid.plans.catalogue import ALL

    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    from prismgrid.plans.oracles import ORACLES

    return dict(ORACLES)
