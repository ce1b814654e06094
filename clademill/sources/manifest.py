"""Resuming: which groups are still to be done."""

from __future__ import annotations

from pyspark.sql import DataFrame


def pending(groups: DataFrame, done: DataFrame, key: str = "group_id") -> DataFrame:
    """The rows whose group the manifest ``done`` does not list."""
    return groups.join(done.select(key).distinct(), key, "left_anti")
