"""All queries of the library by name, with the oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import history, resolving, rest, ruling, texts, tracks, wording  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query."""
    return QUERIES["rl_15_note_to_verdict"](spark, sf_dir)
