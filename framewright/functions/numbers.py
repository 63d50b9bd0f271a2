"""Numeric helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a dimension is sent to every executor.
SMALL_ROWS = 20_000


def known(c: Column | str) -> Column:
    """The value as a double, null for not-a-number: statistics leave both out."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x), x)


def significant(c: Column) -> Column:
    """A double to ten significant digits, as reports give it; sums of doubles differ beyond by their order."""
    return F.format_string("%.9e", c).try_cast("double")  # null spells "null"


def small_side(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """df for the small side of a join: broadcast if it has limit rows at most, else left to the planner."""
    rows = df.limit(limit + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if rows.num_rows <= limit else df

