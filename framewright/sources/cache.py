"""Parquet caches of hashes and features, in versions that never overwrite what is being read."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

HASH_SCHEMA = "path string, mtime timestamp, length bigint, hash array<boolean>"


def file_name(source: str, name: str | None = None, **parts: object) -> str:
    """``cache_<md5 of the path>_<folder>_<k>_<v>….parquet``, or ``<name>__<k>_<v>….parquet`` for a name given."""
    tail = "_".join(f"{k}_{v}" for k, v in parts.items())
    if name:
        return f"{name}__{tail}.parquet"
    whole = Path(source).resolve()
    folder = whole.name.replace(" ", "_").strip(".")[:30]
    return f"cache_{hashlib.md5(str(whole).encode()).hexdigest()}_{folder}_{tail}.parquet"


def versions(folder: str) -> list[Path]:
    """Finished versions of a cache, oldest first."""
    root = Path(folder)
    done = [p for p in root.glob("v-*") if (p / "_SUCCESS").exists()] if root.is_dir() else []
    return sorted(done, key=lambda p: int(p.name[2:]))


def load(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The newest version; a missing or unreadable cache is empty and stays where it is."""
    for version in reversed(versions(folder)):
        try:
            return spark.read.schema(schema).parquet(str(version))
        except AnalysisException:
            continue
    return spark.createDataFrame([], schema)


def save(df: DataFrame, folder: str) -> Path | None:
    """Writes df as the next version and returns where; an empty df is not written."""
    if not isinstance(df, DataFrame):
        raise TypeError("a cache holds a DataFrame")
    if df.isEmpty():
        return None
    last = versions(folder)
    target = Path(folder) / f"v-{int(last[-1].name[2:]) + 1 if last else 1}"
    df.write.mode("overwrite").option("compression", "snappy").parquet(str(target))
    return target
