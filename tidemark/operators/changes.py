"""Comparing snapshots, and removing what was delivered twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delete_sweep(known: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """Keys that a fresh snapshot no longer has: what a consumer must delete after a reset."""
    return known.select(key).distinct().join(snapshot.select(key), key, "left_anti")


def first_delivery(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of records with equal keys the first, by an aggregation with a map-side combine."""
    rest = [c for c in records.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return records.groupBy(*keys).agg(row).select(*keys, "_row.*")


def beyond_mark(records: DataFrame, mark: int | None, at: str, boundary: DataFrame, key: str) -> DataFrame:
    """Records later than a high-water mark, and those at the mark whose keys were not taken yet."""
    if mark is None:
        return records
    fresh = records.filter(F.col(at) > mark)
    tied = records.filter(F.col(at) == mark).join(boundary.select(key), key, "left_anti")
    return fresh.unionByName(tied)
