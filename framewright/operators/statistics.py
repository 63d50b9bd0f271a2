"""Descriptive statistics, outliers, shares and grids of the feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.geometry import SECTOR_COLUMNS, SECTORS, TRUNCATION_COLUMNS
from framewright.functions.numbers import known, small_side
from framewright.operators.features import class_ids
from framewright.operators.projection import numeric_features
from framewright.operators.quantiles import exact_percentiles, pivoted, unpivoted

NUMERIC = ("object_area", "object_relative_area", "object_width", "object_height", "object_aspect_ratio", "im_brightness", "im_contrast", "im_blur_score")
BINARY = (*SECTOR_COLUMNS, *TRUNCATION_COLUMNS)
#: How far from the quartiles a value still fits, in interquartile ranges.
REACH = 1.5


def class_counts(df: DataFrame) -> DataFrame:
    """(class_name, objects, share): objects of each class, most frequent first, and their percentage of all objects."""
    counts = df.groupBy("class_name").agg(F.count(F.lit(1)).alias("objects"))
    total = F.broadcast(counts.agg(F.sum("objects").alias("_total")))  # one row
    return counts.crossJoin(total).select("class_name", "objects", (F.col("objects") * 100 / F.col("_total")).alias("share")).filter("class_name IS NOT NULL").orderBy(F.desc("objects"), "class_name")


def density(df: DataFrame) -> DataFrame:
    """One row: distinct images, objects, mean objects of an image and their sample deviation; null images do not count."""
    per_image = df.groupBy("im_path").agg(F.count(F.lit(1)).alias("n"))
    n = F.when(F.col("im_path").isNotNull(), F.col("n"))
    return per_image.agg(F.count("im_path").alias("images"), F.avg(n).alias("mean_objects"), F.stddev_samp(n).alias("std_objects"), F.coalesce(F.sum("n"), F.lit(0)).alias("objects"))


def bounds(percentiles: DataFrame) -> DataFrame:
    """(..., q1, q3, iqr, lower, upper): the limits beyond which a value is an outlier; the lower is held to 0."""
    iqr = F.col("q3") - F.col("q1")
    return percentiles.withColumn("iqr", iqr).withColumn("lower", F.greatest(F.col("q1") - REACH * iqr, F.lit(0.0))).withColumn("upper", F.col("q3") + REACH * iqr)


def outlier_bounds(df: DataFrame, features: Sequence[str] = NUMERIC) -> DataFrame:
    """(class_name, feature, q1, q3, iqr, lower, upper)."""
    quartiles = exact_percentiles(unpivoted(df, ["class_name"], features), ["class_name"], [0.25, 0.75])
    return bounds(pivoted(quartiles, ["class_name"], {0.25: "q1", 0.75: "q3"}))


def mark_outliers(df: DataFrame, features: Sequence[str] | None = None, limits: DataFrame | None = None) -> DataFrame:
    """df with outlier_<feature> of the features, else of all that are numeric, and outlier_any, tinyint 0 or 1.

    Every feature is judged within its class; a null, a not-a-number and a
    null class are no outliers. Columns of these names are replaced.
    """
    features = numeric_features(df) if features is None else features
    limits = outlier_bounds(df, features) if limits is None else limits
    per_class = small_side(
        limits.groupBy("class_name").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("lower", "upper")))).alias("_limits"))
    )
    def flag(f: str) -> Column:
        x, limit = known(f), F.col("_limits")[f]
        return F.coalesce((x < limit["lower"]) | (x > limit["upper"]), F.lit(False)).cast("tinyint")

    marks = {f"outlier_{f}": flag(f) for f in features}
    marked = df.drop(*marks, "outlier_any").join(per_class, "class_name", "left").withColumns(marks).drop("_limits")
    return marked.withColumn("outlier_any", F.greatest(*[F.col(c) for c in marks]) if len(marks) > 1 else F.col(next(iter(marks))))


def outlier_counts(marked: DataFrame, features: Sequence[str] = NUMERIC) -> DataFrame:
    """(class_name, feature, outliers) per class and, with a null class, over all."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"outlier_{f}").alias("o")) for f in features]))
    long = marked.select("class_name", cells.alias("_c")).select("class_name", "_c.*")
    per_class = long.groupBy("class_name", "feature").agg(F.sum("o").alias("outliers"))
    return per_class.filter("class_name IS NOT NULL").unionByName(per_class.groupBy("feature").agg(F.sum("outliers").alias("outliers")).withColumn("class_name", F.lit(None).cast("string")))


def describe(df: DataFrame, by: Sequence[str], features: Sequence[str] = NUMERIC) -> DataFrame:
    """(*by, feature, n, mean, std, min, q1, median, q3, max) of known values; std divides by n - 1."""
    values = unpivoted(df, by, features)
    keys = [*by, "feature"]
    simple = values.dropna(subset=keys).groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    middle = pivoted(exact_percentiles(values, by, [0.25, 0.5, 0.75]), by, {0.25: "q1", 0.5: "median", 0.75: "q3"})
    return simple.join(middle, keys)


def binary_shares(df: DataFrame, by: Sequence[str], flags: Sequence[str] = BINARY) -> DataFrame:
    """(*by, flag, set_count, share): how often each flag is 1 and its percentage of the group's rows."""
    aggregates = [F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in flags]
    sums = df.dropna(subset=list(by)).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *aggregates) if by else df.agg(F.count(F.lit(1)).alias("_n"), *aggregates)
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("set_count")) for f in flags]))
    return sums.select(*by, "_n", cells.alias("_c")).select(*by, "_c.flag", "_c.set_count", F.try_divide(F.col("_c.set_count") * 100, F.col("_n")).alias("share"))


def spatial_grid(df: DataFrame) -> DataFrame:
    """(class_name, grid): objects in the 3 x 3 sectors, rows from the top."""
    sums = df.filter("class_name IS NOT NULL").groupBy("class_name").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SECTOR_COLUMNS])
    return sums.select("class_name", F.array(*[F.array(*names) for names in SECTORS]).alias("grid"))


def one_hot(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """df with an int column class_<name> per class."""
    return df.select("*", *[F.coalesce((F.col("class_name") == c).cast("int"), F.lit(0)).alias(f"class_{c}") for c in classes])


def one_hot_cells(df: DataFrame, id_col: str) -> DataFrame:
    """(id_col, class_no, class_name, value): the ones of the class columns, by the number of the column; all other cells are 0.

    Sparse, as names that differ only by case cannot be columns of one table.
    Rows without a class have no one. Columns are numbered by class_ids().
    """
    numbered = small_side(class_ids(df).withColumnRenamed("class_id", "class_no"))
    return df.select(id_col, "class_name").join(numbered, "class_name").select(id_col, "class_no", "class_name", F.lit(1).alias("value"))


def class_correlations(df: DataFrame, features: Sequence[str] = NUMERIC) -> DataFrame:
    """(class_name, feature_a, feature_b, corr): Pearson correlation of known pairs within each class, a before b.

    Undefined ones (no variance) are left out. One pass with partial
    aggregates for all pairs.
    """
    x = {f: known(f).alias(f) for f in features}
    clean = df.filter("class_name IS NOT NULL").select("class_name", *x.values())
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    def corr(a: str, b: str) -> Column:
        both = [F.when(F.col(o).isNotNull(), F.col(c)) for c, o in ((a, b), (b, a))]
        return F.try_divide(F.covar_pop(*both), F.stddev_pop(both[0]) * F.stddev_pop(both[1]))

    wide = clean.groupBy("class_name").agg(*[corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]))
    return wide.select("class_name", cells.alias("_c")).select("class_name", "_c.*").filter("corr IS NOT NULL")


def bias_matrix(df: DataFrame, features: Sequence[str] = NUMERIC) -> DataFrame:
    """(class_name, feature, corr): Pearson correlation of being of a class with a feature; undefined ones are left out.

    From each class's count and mean and the moments over all, so no column
    per class is made.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), known(f).alias("x")) for f in features]))
    long = df.select("class_name", cells.alias("_c")).select("class_name", "_c.*").filter("x IS NOT NULL")
    whole = long.groupBy("feature").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    each = long.filter("class_name IS NOT NULL").groupBy("class_name", "feature").agg(F.count("x").alias("k"), F.avg("x").alias("mk"))
    p = F.col("k") / F.col("n")
    corr = F.try_divide(p * (F.col("mk") - F.col("m")), F.sqrt(p * (1 - p)) * F.col("s"))
    return each.join(F.broadcast(whole), "feature").select("class_name", "feature", corr.alias("corr")).filter("corr IS NOT NULL")


def histogram(df: DataFrame, feature: str, edges: Sequence[float]) -> DataFrame:
    """(class_name, bin, objects): known values between consecutive edges; bin 0 lies below, the last at or above."""
    x = known(feature)
    place = F.lit(0)
    for e in edges:
        place = place + (x >= F.lit(float(e))).cast("int")
    return df.filter("class_name IS NOT NULL").select("class_name", place.alias("bin")).filter("bin IS NOT NULL").groupBy("class_name", "bin").agg(F.count(F.lit(1)).alias("objects"))


def box_plot(df: DataFrame, features: Sequence[str] = ("object_area", "object_aspect_ratio")) -> DataFrame:
    """(class_name, feature, q1, median, q3, whisker_low, whisker_high): whiskers end at the last value within reach."""
    values = unpivoted(df, ["class_name"], features)
    middle = pivoted(exact_percentiles(values, ["class_name"], [0.25, 0.5, 0.75]), ["class_name"], {0.25: "q1", 0.5: "median", 0.75: "q3"})
    joined = values.join(small_side(middle), ["class_name", "feature"])
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - REACH * iqr, F.col("q3") + REACH * iqr
    return joined.groupBy("class_name", "feature", "q1", "median", "q3").agg(F.min(F.when(F.col("x") >= low, F.col("x"))).alias("whisker_low"), F.max(F.when(F.col("x") <= high, F.col("x"))).alias("whisker_high"))


def stratified_sample(df: DataFrame, key: str, per_class: int = 2000, seed: int = 42, least: int = 10) -> DataFrame:
    """Up to per_class rows of each class in a fixed pseudo-random order of key; none if the sample has fewer than least rows."""
    order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    w = Window.partitionBy("class_name").orderBy(order, key)
    sample = df.filter("class_name IS NOT NULL").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_class).drop("_n")
    return sample if len(sample.select(key).take(least)) >= least else sample.limit(0)
