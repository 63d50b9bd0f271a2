"""Merging cached results with the files as they are now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_update(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files (path, mtime) that are not cached with that very mtime; null equals null."""
    now, known = files.select("path", "mtime").distinct(), cached.select("path", F.col("mtime").alias("_m")).distinct()
    return now.join(known, (now["path"] == known["path"]) & now["mtime"].eqNullSafe(known["_m"]), "left_anti")


def still_valid(cached: DataFrame, files: DataFrame) -> DataFrame:
    """Cached rows whose file has their mtime still."""
    now = files.select("path", F.col("mtime").alias("_m")).distinct()
    return cached.join(now, (cached["path"] == now["path"]) & cached["mtime"].eqNullSafe(now["_m"]), "left_semi")


def reconciled(files: DataFrame, cached: DataFrame) -> DataFrame:
    """(path, status): ``missing`` from the cache, ``obsolete`` in it or ``kept``."""
    a = files.filter("path IS NOT NULL").select("path", F.lit(True).alias("f")).distinct()
    b = cached.filter("path IS NOT NULL").select("path", F.lit(True).alias("c")).distinct()
    return a.join(b, "path", "full").select("path", F.when(F.col("c").isNull(), "missing").when(F.col("f").isNull(), "obsolete").otherwise("kept").alias("status"))


def combined(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cached and fresh rows; columns that one side lacks are null there."""
    return cached.unionByName(fresh, allowMissingColumns=True)
