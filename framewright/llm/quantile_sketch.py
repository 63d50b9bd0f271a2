"""Percentiles of very large columns from mergeable logarithmic buckets.

A value falls into the bucket of its sign and the power of (1 + a) / (1 - a)
it lies under, so every percentile read from the counts is within the relative
error a of the exact order statistic. Counts of partitions, days or periods
add up without loss.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.numbers import small_side

#: Guaranteed relative error.
ERROR = 0.01


def _log_width(error: float) -> float:
    return math.log((1 + error) / (1 - error))


def _shift(error: float) -> int:
    """Added to a bucket number to make that of every positive double positive."""
    return math.ceil(746 / _log_width(error)) + 1


def bucket(value: Column, error: float = ERROR) -> Column:
    """Signed bucket number, ascending with the value; null for null and not-a-number."""
    x = value.cast("double")
    size = F.abs(x)
    number = F.when(size == float("inf"), F.lit(3 * _shift(error))).otherwise((F.ceil(F.log(size) / F.lit(_log_width(error))) + _shift(error)).cast("int"))
    return F.when(x.isNull() | F.isnan(x), None).when(x == 0, 0).otherwise((F.signum(x) * number).cast("int"))


def bucket_value(number: Column, error: float = ERROR) -> Column:
    """The value that stands for a bucket: within the error of everything in it."""
    w = _log_width(error)
    size = F.exp((F.abs(number) - _shift(error)) * F.lit(w) + F.lit(math.log(2) - math.log1p(math.exp(w))))
    return F.when(number == 0, F.lit(0.0)).otherwise(F.signum(number.cast("double")) * F.when(F.abs(number) == 3 * _shift(error), F.lit(float("inf"))).otherwise(size))


def sketch(df: DataFrame, by: Sequence[str], features: Sequence[str], error: float = ERROR) -> DataFrame:
    """(*by, feature, bucket, n): counts per bucket. Nulls and not-a-number do not count.

    Counted within each task before the shuffle; a group has a bounded number
    of buckets, so a group with a third of all rows is no skew.
    """
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), bucket(F.col(f), error).alias("bucket")) for f in features]))
    return df.select(*by, values.alias("_v")).select(*by, "_v.*").filter("bucket IS NOT NULL").groupBy(*by, "feature", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of finer groups to those of by: matching bucket counts added."""
    return sketches.groupBy(*by, "feature", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, by: Sequence[str], quantiles: Sequence[float], error: float = ERROR) -> DataFrame:
    """(*by, feature, quantile, estimate, n): the order statistic of rank floor(q * (n - 1)) from 0.

    The exact value lies within error * |exact value| of the estimate; zero and
    infinite values are exact. Groups without values give no rows.
    """
    group = Window.partitionBy(*by, "feature")
    order = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = sketches.select(*by, "feature", "bucket", "n", F.sum("n").over(order).alias("_upto"), F.sum("n").over(group).alias("_all"))
    asked = F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))
    rank = F.floor(F.col("quantile") * (F.col("_all") - 1))
    return (
        counted.select("*", asked.alias("quantile"))
        .filter((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("n")))
        .select(*by, "feature", "quantile", bucket_value(F.col("bucket"), error).alias("estimate"), F.col("_all").alias("n"))
    )


def by_scope(df: DataFrame, by: Sequence[str], period: str, features: Sequence[str], quantiles: Sequence[float], error: float = ERROR) -> DataFrame:
    """Percentiles of every period and, from the periods' sketches, of all together (scope ``all``, whole).

    Returns (*by, scope, whole, feature, quantile, estimate, n, relative_error);
    whole tells the percentiles of all from those of a period called ``all``.
    """
    parts = sketch(df, [*by, period], features, error)
    scopes = F.array(F.struct(F.col(period).cast("string").alias("scope"), F.lit(False).alias("whole")), F.struct(F.lit("all").alias("scope"), F.lit(True).alias("whole")))
    scoped = parts.select(*by, "feature", "bucket", "n", F.explode(scopes).alias("_s")).select(*by, "feature", "bucket", "n", "_s.*")
    keys = [*by, "scope", "whole"]
    return percentiles(merge(scoped, keys), keys, quantiles, error).select(*keys, "feature", "quantile", "estimate", "n", F.lit(error).alias("relative_error"))


def bounds_hold(values: DataFrame, estimates: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, quantile, n, ok): whether the order statistic beside each estimate's rank lies within its error.

    values: (*by, x), without nulls and not-a-number; estimates: as
    percentiles() gives them, with relative_error. What lies below and up to
    an estimate's range is counted in one pass; nothing is gathered.
    """
    reach, e = F.col("relative_error") + 1e-9, F.col("estimate")
    ends = [e / (1 + reach), e / (1 - reach)]
    asked = estimates.select(*by, "quantile", "n", F.floor(F.col("quantile") * (F.col("n") - 1)).alias("rank"), F.least(*ends).alias("low"), F.greatest(*ends).alias("high"))
    listed = asked.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("quantile", "n", "rank", "low", "high"))).alias("asked"))  # one for each quantile
    joined = values.join(small_side(listed.select(*[F.col(c).alias(f"_{c}") for c in by], "asked")), [values[c].eqNullSafe(F.col(f"_{c}")) for c in by])
    cells = joined.select(*by, "x", F.explode("asked").alias("a"))
    counted = cells.groupBy(*by, "a").agg(F.count_if(F.col("x") < F.col("a.low")).alias("below"), F.count_if(F.col("x") <= F.col("a.high")).alias("upto"))
    return counted.select(*by, "a.quantile", "a.n", ((F.col("below") <= F.col("a.rank")) & (F.col("upto") > F.col("a.rank"))).alias("ok"))
