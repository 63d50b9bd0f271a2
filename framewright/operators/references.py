"""Orphan references: records that point to rows which are missing, deleted or late.

References and parent validity intervals are brought to the same partitions,
sorted by key and time and merged in one linear pass (a running window).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.numbers import small_side

#: A key with fewer references than this is not split.
HOT_ROWS = 50_000
#: Rows of a part of a split key.
PART_ROWS = 25_000
#: Split keys up to which they are sent to every executor (12 bytes each); more are joined by a shuffle.
MOST_SENT = 500_000


def _digest(field: Column, key: Column) -> Column:
    return F.xxhash64(field, key)


def hot_keys(refs: DataFrame) -> DataFrame:
    """(_d, _parts) of the keys worth splitting, by digest; any other key has fewer than HOT_ROWS references.

    Counts are exact, pre-aggregated before the shuffle, over 8-byte digests;
    two keys with one digest are split alike, which changes no result.
    """
    counts = refs.groupBy(_digest(F.col("_field"), F.col("_key")).alias("_d")).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= HOT_ROWS).select("_d", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("_parts"))


def orphan_references(
    refs: DataFrame,
    targets: Mapping[str, DataFrame],
    *,
    id_col: str,
    at_col: str,
    keep: Sequence[str] = (),
    key_col: str = "path",
    seen_col: str = "seen_at",
    deleted_col: str = "deleted_at",
) -> DataFrame:
    """References without a parent row that was valid at the time of the reference.

    targets maps a reference column to its parent table. A parent row is valid
    in [seen, deleted), without end if deleted is null. Returns (id_col,
    *keep, ref_field, state), one row per reference row and column:

    * ``missing``: no parent row has that key;
    * ``deleted``: a parent row was seen by then, none is valid;
    * ``late``: parent rows exist, none was seen by then.

    Null references are no references. A null reference time matches nothing,
    so the row is ``missing`` or ``late``. A parent row with a null seen time
    exists but is never valid; one deleted before or when it was seen is never
    valid but counts as seen. Repeated rows are reported as often as they occur.
    Empty tables work: without parents every reference is ``missing``. Other
    columns of the inputs are ignored, whatever they are called.
    """
    fields = list(targets)
    long = refs.select(
        F.col(id_col).alias("_id"),
        F.col(at_col).alias("_t"),
        *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)],
        F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("k")) for f in fields])).alias("_r"),
    ).select("*", F.col("_r.f").alias("_field"), F.col("_r.k").alias("_key")).drop("_r").filter("_key IS NOT NULL")

    parents = None
    for f, df in targets.items():
        one = df.select(
            F.lit(f).alias("_field"),
            F.col(key_col).alias("_key"),
            F.col(seen_col).alias("s"),
            F.col(deleted_col).alias("d"),
        ).filter("_key IS NOT NULL")
        parents = one if parents is None else parents.unionByName(one)
    lasting = F.col("s").isNotNull() & (F.col("d").isNull() | (F.col("d") > F.col("s")))
    event = "struct<t:timestamp,live:int,seen:int>"
    opens = F.struct(F.col("s").alias("t"), lasting.cast("int").alias("live"), F.col("s").isNotNull().cast("int").alias("seen"))
    closes = F.struct(F.col("d").alias("t"), F.lit(-1).alias("live"), F.lit(0).alias("seen"))
    parents = parents.select(
        "_field",
        "_key",
        F.explode(
            F.when(lasting & F.col("d").isNotNull(), F.array(opens.cast(event), closes.cast(event))).otherwise(F.array(opens.cast(event)))
        ).alias("e"),
    ).select("_field", "_key", F.col("e.t").alias("_t"), F.col("e.live").alias("_live"), F.col("e.seen").alias("_seen"))

    parts = small_side(hot_keys(long), MOST_SENT)
    digest = _digest(F.col("_field"), F.col("_key"))
    long = long.withColumn("_d", digest).join(parts, "_d", "left").withColumn("_part", F.pmod(F.xxhash64("_id"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_d", "_parts")
    parents = parents.withColumn("_d", digest).join(parts, "_d", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_d", "_parts")

    stream = long.withColumn("_ref", F.lit(1)).unionByName(parents.withColumn("_ref", F.lit(0)), allowMissingColumns=True)
    by_time = Window.partitionBy("_field", "_key", "_part").orderBy(F.col("_t").asc_nulls_first(), "_ref")
    so_far = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = by_time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = stream.select(
        "*",
        F.sum("_live").over(so_far).alias("_now"),
        F.sum("_seen").over(so_far).alias("_ever"),
        F.min("_ref").over(whole).alias("_none"),
    )
    return merged.filter((F.col("_ref") == 1) & (F.coalesce("_now", F.lit(0)) == 0)).select(
        F.col("_id").alias(id_col),
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)],
        F.col("_field").alias("ref_field"),
        F.when(F.col("_none") == 1, "missing").when(F.coalesce("_ever", F.lit(0)) > 0, "deleted").otherwise("late").alias("state"),
    )


def orphan_summary(orphans: DataFrame, period_col: str) -> DataFrame:
    """Orphans per reference field, period and state."""
    return orphans.groupBy("ref_field", period_col, "state").agg(F.count(F.lit(1)).alias("orphans"))
