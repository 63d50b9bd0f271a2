"""Geometry of object boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sectors of the 3 x 3 grid, by row and column (fixed names of the feature matrix).
SECTORS = (
    ("object_in_left_top", "object_in_top_side", "object_in_right_top"),
    ("object_in_left_side", "object_in_center", "object_in_right_side"),
    ("object_in_left_bottom", "object_in_bottom_side", "object_in_right_bottom"),
)
SECTOR_COLUMNS = tuple(c for row in SECTORS for c in row)
TRUNCATION_COLUMNS = ("truncated_left", "truncated_right", "truncated_top", "truncated_bottom")
NO_CLASS = "unfilled"


def text_int(c: Column) -> Column:
    """A whole number in a text, blanks around it allowed; null for anything else."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int"))


def third(low: Column, high: Column, size: Column) -> Column:
    """Third of an axis the centre of (low, high) lies in; beyond the end counts as the last, before the start as -1."""
    return F.least(F.floor((low + high) * 3 / (size * 2)), F.lit(2)).cast("int")


def box_features(xmin: Column, ymin: Column, xmax: Column, ymax: Column, width: Column, height: Column, margin: int = 5) -> dict[str, Column]:
    """Sizes, place and truncation of a box in an image; negative sizes stay as they are."""
    w, h = xmax - xmin, ymax - ymin
    area = w.cast("bigint") * h
    column, row = third(xmin, xmax, width), third(ymin, ymax, height)
    cut = {
        "truncated_left": xmin < margin,
        "truncated_right": xmax > width - margin,
        "truncated_top": ymin < margin,
        "truncated_bottom": ymax > height - margin,
    }
    return {
        "object_width": w,
        "object_height": h,
        "object_aspect_ratio": F.when(h > 0, w / h).otherwise(F.lit(0.0)),
        "object_area": area,
        "object_relative_area": area / (width.cast("bigint") * height),
        **{c: ((row == i) & (column == k)).cast("int") for i, names in enumerate(SECTORS) for k, c in enumerate(names)},
        "full_size": (cut["truncated_left"] & cut["truncated_right"] & cut["truncated_top"] & cut["truncated_bottom"]).cast("int"),
        **{c: v.cast("int") for c, v in cut.items()},
    }


def corners(xc: Column, yc: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Corners in pixels of a centred box in parts of the image; halves go to the even number, what no int holds is null."""
    return {
        "xmin": F.rint((xc - w / 2) * width).try_cast("int"),
        "ymin": F.rint((yc - h / 2) * height).try_cast("int"),
        "xmax": F.rint((xc + w / 2) * width).try_cast("int"),
        "ymax": F.rint((yc + h / 2) * height).try_cast("int"),
    }


def touches_border(xmin: Column, ymin: Column, xmax: Column, ymax: Column, width: Column, height: Column) -> Column:
    """1 if a corner lies on or beyond the border of the image, as a VOC file states it."""
    return ((xmin <= 0) | (ymin <= 0) | (xmax >= width) | (ymax >= height)).cast("int")


def centred(xmin: Column, ymin: Column, xmax: Column, ymax: Column, width: Column, height: Column) -> dict[str, Column]:
    """Centre and size of a box in parts of the image, each held to 0 .. 1."""
    def held(x: Column) -> Column:
        return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))

    return {
        "x_center": held((xmin + xmax) / 2 / width),
        "y_center": held((ymin + ymax) / 2 / height),
        "width": held((xmax - xmin) / width),
        "height": held((ymax - ymin) / height),
    }


def six_places(x: Column, places: int = 6) -> Column:
    """A number from 0 to 1 as text with up to seven places, exact halves to the even digit.

    The product with the power of ten is taken with its rounding error (a
    split of the factor makes both partial products exact), so that what only
    looks like a half in decimal falls to its true side.
    """
    scale = F.lit(float(10**places))
    product = x * scale
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * scale - product) + (x - high) * scale
    whole = F.floor(product)
    beyond = (product - whole) - 0.5 + error
    up = F.when(beyond > 0, 1).when(beyond < 0, 0).otherwise(whole % 2)
    return F.format_string(f"%.{places}f", (whole + up) / scale)
