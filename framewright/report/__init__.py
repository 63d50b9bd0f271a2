"""The text report and the data of the charts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators import statistics
from framewright.operators.features import MOST_CLASSES
from framewright.session import bounded_rows
from framewright.sources.config import REPORT_SCHEMA

def report_rows(df: DataFrame, schema: Sequence[dict] = REPORT_SCHEMA) -> DataFrame:
    """(class_name, section, place, text): the lines of the report, a null class for what concerns all.

    df is the marked feature matrix (see statistics.mark_outliers).
    """
    out = None
    counts = statistics.outlier_counts(df, [c for s in schema if s["type"] == "numeric" for c in s["columns"]])
    for i, section in enumerate(schema):
        for by in (["class_name"], []):
            if not by and "IMAGE QUALITY" not in section["title"]:
                continue
            if section["type"] == "numeric":
                d = statistics.bounds(statistics.describe(df, by, section["columns"]))
                n = counts.filter("class_name IS NOT NULL" if by else "class_name IS NULL").select(*by, "feature", "outliers")
                shown = {"median": "median", "mean": "mean", "deviation": "std", "from": "min", "to": "max", "usual_from": "lower", "usual_to": "upper"}
                parts = [F.concat(F.lit(f"{name}="), F.coalesce(F.format_number(c, 2), F.lit("?"))) for name, c in shown.items()]
                text = F.concat_ws("  ", F.col("feature"), *parts, F.concat(F.lit("outliers="), F.col("outliers").cast("string")))
                rows = d.join(n, [*by, "feature"]).select(*by, F.col("feature").alias("place"), text.alias("text"))
            else:
                d = statistics.binary_shares(df, by, section["columns"])
                rows = d.select(*by, F.col("flag").alias("place"), F.concat_ws("  ", F.col("flag"), F.concat(F.lit("set="), F.col("set_count").cast("string")), F.concat(F.lit("percent="), F.format_number("share", 1))).alias("text"))
            order = F.array_position(F.array(*[F.lit(c) for c in section["columns"]]), F.col("place"))
            rows = rows.select(F.col("class_name") if by else F.lit(None).cast("string").alias("class_name"), F.lit(section["title"]).alias("section"), (F.lit(100 * i) + order).alias("place"), "text")
            out = rows if out is None else out.unionByName(rows)
    return out


def text_report(df: DataFrame, target_format: str, schema: Sequence[dict] = REPORT_SCHEMA) -> str:
    """The report as text. Its size goes with the classes, not the objects."""
    marked = df if "outlier_any" in df.columns else statistics.mark_outliers(df)
    d = statistics.density(marked).first()
    lines = [f"# {target_format} dataset: {d['images']} images, {d['objects']} objects, {d['mean_objects'] or 0:.2f} in an image (deviation {d['std_objects'] or 0:.2f})"]
    shares = {r["class_name"]: r["share"] for r in bounded_rows(statistics.class_counts(marked), MOST_CLASSES, "the class list")}
    rows = sorted(report_rows(marked, schema).collect(), key=lambda r: (r["class_name"] is not None, r["class_name"] or "", r["place"]))  # a line for each class and feature
    for (name, section), group in groupby(rows, key=lambda r: (r["class_name"], r["section"])):
        lines += ["", f"## {section}, " + ("all classes" if name is None else f"class {name} ({shares[name]:.1f} % of the objects)")]
        lines += [r["text"] for r in group]
    return "\n".join(lines) + "\n"


def chart_data(df: DataFrame) -> dict[str, DataFrame]:
    """What each chart shows, as a table; the manifold's too if the rows have been projected."""
    charts = {"manifold": statistics.stratified_sample(df, "path").select("class_name", "proj_x", "proj_y")} if {"path", "proj_x"} <= set(df.columns) else {}
    return charts | {
        "class_distribution": statistics.class_counts(df),
        "geometry": statistics.box_plot(df),
        "spatial_density": statistics.spatial_grid(df),
        "bias": statistics.bias_matrix(df),
        "correlation": statistics.class_correlations(df),
    }
