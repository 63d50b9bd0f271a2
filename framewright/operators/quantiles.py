"""Exact percentiles without gathering a group in one place.

A first pass counts values in coarse ordered ranges, which tells the range
each wanted rank lies in. Ranges of many values are cut finer, pass by pass,
until each is small; only their distinct values are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.numbers import SMALL_ROWS, known
from framewright.session import checkpointed

#: A range of more values is cut finer, into so many parts, before its values are put in order.
RANGE_ROWS, PARTS = 200_000, 1_024


def unpivoted(df: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(*by, feature, x): one row per known value."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), known(f).alias("x")) for f in features]))
    return df.select(*by, cells.alias("_c")).select(*by, "_c.*").filter("x IS NOT NULL")


def _coarse(x: Column) -> Column:
    """A whole number that never falls as x rises; a power of e has 32, infinity one of its own."""
    size = F.floor((F.log(F.abs(x)) + 746) * 32).cast("int")
    return F.when(x == 0, 0).when(F.abs(x) == float("inf"), F.when(x > 0, 99_999).otherwise(-99_999)).otherwise(F.when(x > 0, size).otherwise(-size))


def _finer(x: Column, low: Column, high: Column) -> Column:
    """The part of a range that x lies in; never falls as x rises. Halves keep the width finite."""
    return F.when(low == high, 0).otherwise(F.least(F.floor((x / 2 - low / 2) / (high / 2 - low / 2) * PARTS), F.lit(PARTS - 1))).cast("int")


def _located(wanted: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The range of each rank asked for, among the counted ranges it may lie in (columns _n, _low, _high and order), and its place there."""
    ask = [*keys, "quantile", "part", "side"]
    upto = F.sum("_n").over(Window.partitionBy(*ask).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = wanted.select("*", upto.alias("_upto")).filter((F.col("at") < F.col("_upto")) & (F.col("at") >= F.col("_upto") - F.col("_n")))
    return placed.select(*ask, (F.col("at") - F.col("_upto") + F.col("_n")).alias("at"), F.col("_n").alias("n"), F.col("_low").alias("low"), F.col("_high").alias("high"))


def _held(df: DataFrame) -> tuple[DataFrame, pa.Table | None]:
    """df worked out once: its rows, to be broadcast, if they are as few as a dimension's; else a checkpoint."""
    rows = df.limit(SMALL_ROWS + 1).toArrow()
    if rows.num_rows > SMALL_ROWS:
        return checkpointed(df), None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), rows


def _within(values: DataFrame, wanted: DataFrame, rows: pa.Table | None, keys: list[str]) -> DataFrame:
    """Values in the wanted ranges, with low and high. rows: those of wanted, if they are held."""
    kept = [*keys, "low", "high"]
    ranges = wanted.select(*kept).distinct()
    if rows is not None:
        ranges = F.broadcast(values.sparkSession.createDataFrame(rows.group_by(kept).aggregate([]).select(kept), ranges.schema))
    return values.join(ranges, keys).filter((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high")))


def exact_percentiles(values: DataFrame, by: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """(*by, feature, quantile, value) of (*by, feature, x): linear between the neighbouring ranks.

    Groups with a null key are left out, groups without values give no rows.
    All passes but the last only count; the last orders at most RANGE_ROWS
    values for a rank asked for.
    """
    keys = [*by, "feature"]
    values = values.dropna(subset=keys)
    ends = [F.count(F.lit(1)).alias("_n"), F.min("x").alias("_low"), F.max("x").alias("_high")]
    counts = values.groupBy(*keys, _coarse(F.col("x")).alias("_b")).agg(*ends)
    place = F.col("quantile") * (F.col("_all") - 1)
    counts = counts.select("*", F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"))
    asked = counts.select("*", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("quantile"))
    ranks = F.array(F.struct(F.lit("lo").alias("side"), F.floor(place).alias("at")), F.struct(F.lit("hi").alias("side"), F.ceil(place).alias("at")))
    asked = asked.select("*", (place - F.floor(place)).alias("part"), F.explode(ranks).alias("_r")).select("*", "_r.*")
    wanted, rows = _held(_located(asked, keys, "_b"))
    wide = (F.col("n") > RANGE_ROWS) & (F.col("low") < F.col("high"))
    while (pc.max(rows["n"]).as_py() or 0) > RANGE_ROWS if rows is not None else True:
        open_ranges = wanted.filter(wide)
        if open_ranges.isEmpty():
            break
        finer = _within(values, open_ranges, None, keys).groupBy(*keys, "low", "high", _finer(F.col("x"), F.col("low"), F.col("high")).alias("_b")).agg(*ends)
        narrowed = _located(open_ranges.drop("n").join(finer, [*keys, "low", "high"]), keys, "_b")
        wanted, rows = _held(wanted.filter(~wide).unionByName(narrowed))
    within = Window.partitionBy(*keys, "low", "high").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    distinct = _within(values, wanted, rows, keys).groupBy(*keys, "low", "high", "x").agg(F.count(F.lit(1)).alias("_m"))
    placed = distinct.select("*", F.sum("_m").over(within).alias("_to"))
    hit = placed.join(wanted, [*keys, "low", "high"]).filter((F.col("at") < F.col("_to")) & (F.col("at") >= F.col("_to") - F.col("_m")))
    lo, hi = (F.max(F.when(F.col("side") == s, F.col("x"))) for s in ("lo", "hi"))
    return hit.groupBy(*keys, "quantile").agg((lo + (hi - lo) * F.max("part")).alias("value"))


def pivoted(percentiles: DataFrame, by: Sequence[str], names: dict[float, str]) -> DataFrame:
    """Percentile rows to columns."""
    return percentiles.groupBy(*by, "feature").agg(*[F.max(F.when(F.col("quantile") == q, F.col("value"))).alias(n) for q, n in names.items()])
