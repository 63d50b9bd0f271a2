"""Incremental reading: which keys are new or changed since the last successful run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_versions(listing: DataFrame, key: str, version: str, *, order: Sequence[str], deleted: str | None = None) -> DataFrame:
    """The newest listed version of every key that is not removed.

    Newest by the columns of order (a null sorts lowest). Null keys are left
    out. Pre-aggregates before the shuffle, so a key listed very often is no
    skew. Returns (key, version).
    """
    value = F.struct(F.col(version).alias("v"), (F.col(deleted).isNotNull() if deleted else F.lit(False)).alias("gone"))
    newest = F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], value.alias("row")))
    return (
        listing.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias(key))
        .agg(newest.alias("n"))
        .filter(~F.col("n.row.gone"))
        .select(key, F.col("n.row.v").alias(version))
    )


def processed_ledger(results: DataFrame, runs: DataFrame, key: str, version: str, *, run: str = "run_id", status: str = "status", success: str = "success") -> DataFrame:
    """(key, version) as processed by the greatest successful run of each key.

    Rows of runs that failed, were aborted or are still running do not count,
    so what such a run read is read again. A run listed twice counts once.
    """
    good = runs.filter((F.col(status) == success) & F.col(run).isNotNull()).select(F.col(run).alias("_run")).distinct()
    rows = results.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(version).alias("_v"), F.col(run).alias("_run"))
    return rows.join(good, "_run").groupBy(F.col("_k").alias(key)).agg(F.max(F.struct("_run", "_v")).alias("l")).select(key, F.col("l._v").alias(version))


def reread_from(runs: DataFrame, *, started: str = "started_at", finished: str = "finished_at", status: str = "status", success: str = "success") -> DataFrame:
    """One row (reread_from): start of the oldest run still open when the last successful one began.

    A run is open at a time if it started before and had not finished with
    success by then. Null when every earlier run had closed: nothing needs
    rereading but what came since.
    """
    ok = F.coalesce(F.col(status) == success, F.lit(False))
    closed = ok & F.coalesce(F.col(finished) <= F.col("_last"), F.lit(False))
    last = F.broadcast(runs.agg(F.max(F.when(ok, F.col(started))).alias("_last")))  # one row
    return runs.crossJoin(last).filter((F.col(started) < F.col("_last")) & ~closed).agg(F.min(started).alias("reread_from"))


def changed_keys(current: DataFrame, ledger: DataFrame, key: str, version: str) -> DataFrame:
    """Keys whose current (key, version) pair is not in the ledger, with ``new`` or ``changed``.

    The overlap with what was processed goes by an anti join on key and
    version, null versions being equal to each other only. It is carried out
    as one outer join, as the label needs to know whether the key is there.
    """
    known = ledger.select(F.col(key), F.col(version).alias("_known"), F.lit(True).alias("_there"))
    return (
        current.select(key, version)
        .join(known, key, "left")
        .filter(F.col("_there").isNull() | ~F.col(version).eqNullSafe(F.col("_known")))
        .select(key, F.when(F.col("_there").isNull(), "new").otherwise("changed").alias("change"))
    )
