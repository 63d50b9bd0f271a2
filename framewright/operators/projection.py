"""Feature selection, standardisation and a two-dimensional projection."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.numbers import known
from framewright.session import mapped

#: Columns that are no features though they may be numeric (fixed names of the feature matrix).
NOT_FEATURES = ("class_name", "path", "mtime", "has_neighbors", "full_size", "objects_count", "proj_x", "proj_y", "row_id", "run_id")


def numeric_features(df: DataFrame) -> list[str]:
    """Numeric columns that describe an object; outlier marks and projections are none."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in NOT_FEATURES and not f.name.startswith("outlier")]


def _moments(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of the features that vary, unknown values as 0; one pass."""
    filled = df.select(*[F.coalesce(known(f), F.lit(0.0)).alias(f) for f in features])
    row = filled.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    return {f: (row[f"m_{f}"], row[f"s_{f}"]) for f in features if row[f"s_{f}"] is not None and row[f"s_{f}"] > 0}


def varying(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features whose variance, unknown values as 0, is above 0."""
    return list(_moments(df, features)) if features else []


def _scaled(moments: dict[str, tuple[float, float]]) -> dict:
    return {f: (F.coalesce(known(f), F.lit(0.0)) - F.lit(m)) / F.lit(s) for f, (m, s) in moments.items()}


def standardised(df: DataFrame, features: Sequence[str], suffix: str = "_z") -> DataFrame:
    """df with <feature>_z of the varying features: less the mean, by the population deviation, unknown values as 0 before."""
    return df.select("*", *[z.alias(f + suffix) for f, z in _scaled(_moments(df, features)).items()])


def _products(z: DataFrame) -> np.ndarray:
    """Mean products of all pairs of columns: summed in each batch, then by pair."""
    n = len(z.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((n, n)), 0
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            total += x.T @ x
            rows += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * n)), pa.array(total.ravel()), pa.array(np.full(n * n, rows))], names=["cell", "total", "n"])

    sums = mapped(z, run, "cell bigint, total double, n bigint").groupBy("cell").agg((F.sum("total") / F.sum("n")).alias("mean")).toArrow()
    out = np.zeros(n * n)
    out[sums["cell"].to_numpy()] = sums["mean"].to_numpy()
    return out.reshape(n, n)


def projected(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """df with proj_x, proj_y: the two main axes of the standardised features.

    Deterministic but for an axis' sense, which is fixed by its largest
    weight. Fewer than two varying features give nulls. What is gathered is a
    matrix of features by features.
    """
    moments = _moments(df, features) if features else {}
    if len(moments) < 2:
        return df.withColumns({"proj_x": F.lit(None).cast("double"), "proj_y": F.lit(None).cast("double")})
    z = _scaled(moments)
    axes = np.linalg.eigh(_products(df.select(*[c.alias(f) for f, c in z.items()])))[1][:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), [0, 1]])
    return df.withColumns({n: sum((c * float(w) for c, w in zip(z.values(), axes[:, i])), F.lit(0.0)) for i, n in enumerate(("proj_x", "proj_y"))})
