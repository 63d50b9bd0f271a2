"""Conversion between YOLO lines and VOC records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import geometry, paths
from framewright.functions.numbers import small_side
from framewright.operators.features import named_classes


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(path, line, line_no, first_no) of (path, no, line): a line that a path repeats counts once, with its first and last place; blanks around it do not count."""
    bare = lines.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).filter("line <> ''")
    return bare.groupBy("path", "line").agg(F.max("no").alias("line_no"), F.min("no").alias("first_no"))


def yolo_lines(texts: DataFrame) -> DataFrame:
    """distinct_lines() of whole texts (path, value)."""
    return distinct_lines(texts.select("path", F.posexplode(F.split("value", "\n")).alias("no", "line")))


#: A class and four numbers; texts such as "nan" and "1d", which a cast reads too, are none.
_FIELDS = r"^[^ \t]+([ \t]+[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?){4}\z"


def yolo_boxes(lines: DataFrame, *, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keep, class_id, x_center, y_center, width, height) of YOLO lines; a line with other than five fields or no finite numbers is left out."""
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    f = F.split(text, r"[ \t]+")
    out = lines.filter(text.rlike(_FIELDS)).select(*keep, f[0].alias("class_id"), *[f[i + 1].try_cast("double").alias(c) for i, c in enumerate(("x_center", "y_center", "width", "height"))])
    return out.filter(" AND ".join(f"abs({c}) < double('infinity')" for c in ("x_center", "y_center", "width", "height")))


def to_pixels(boxes: DataFrame, sizes: DataFrame, classes: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """YOLO boxes (path, ...) in pixels of their images, with the columns keep.

    sizes: (path, im_width, im_height) by the box's path, inner: without an
    image nothing can be converted. Adds the class name and the VOC truncated flag.
    A box with a corner beyond the whole numbers of 32 bits is left out.
    """
    joined = named_classes(boxes.join(sizes, "path"), classes)
    w, h = F.col("im_width"), F.col("im_height")
    made = joined.withColumns({f"_{k}": c for k, c in geometry.corners(F.col("x_center"), F.col("y_center"), F.col("width"), F.col("height"), w, h).items()})
    made = made.filter("_xmin IS NOT NULL AND _ymin IS NOT NULL AND _xmax IS NOT NULL AND _ymax IS NOT NULL")
    xy = [F.col(f"_{c}") for c in ("xmin", "ymin", "xmax", "ymax")]
    return made.select("path", *keep, "class_name", "im_width", "im_height", *[c.alias(k) for c, k in zip(xy, ("xmin", "ymin", "xmax", "ymax"))], geometry.touches_border(*xy, w, h).alias("truncated"))


def voc_records(pixels: DataFrame) -> DataFrame:
    """One nested VOC record per path of pixel boxes, objects by their number (column no, if there is one), then by content."""
    s = lambda c: F.col(c).cast("string")
    one = F.struct(
        F.col("class_name").alias("name"), F.lit("Unspecified").alias("pose"), s("truncated").alias("truncated"), F.lit("0").alias("difficult"),
        F.struct(*[s(c).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]).alias("bndbox"),
    )
    p = F.col("path")
    placed = F.struct((F.col("no") if "no" in pixels.columns else F.lit(0)).alias("no"), one.alias("o"))
    return pixels.groupBy("path", "im_width", "im_height").agg(F.transform(F.sort_array(F.collect_list(placed)), lambda x: x["o"]).alias("object")).select(
        "path",
        paths.name(p).alias("filename"),
        paths.stem(F.try_element_at(F.split(p, "/"), F.lit(-2))).alias("folder"),
        F.struct(F.lit("Unknown").alias("database")).alias("source"),
        F.struct(s("im_width").alias("width"), s("im_height").alias("height"), F.lit("3").alias("depth")).alias("size"),
        F.lit("0").alias("segmented"),
        "object",
    )


def voc_to_yolo(docs: DataFrame, classes: DataFrame, *, keep: tuple[str, ...] = ("path",), places: int = 6) -> DataFrame:
    """(keep, no, class_id, x_center, y_center, width, height, line) of the objects of VOC records, no being an object's place.

    Corners are decimal numbers; an object without four of them, or whose
    class is not in classes (class_name, class_id), is left out; so is a
    record without a positive size.
    """
    number = lambda c: F.trim(c).try_cast("double")
    boxes = docs.select(
        *keep, number(F.col("size.width")).alias("_w"), number(F.col("size.height")).alias("_h"),
        F.posexplode(F.filter("object", lambda o: o.isNotNull())).alias("no", "_o"),
    ).filter("_w > 0 AND _h > 0").select(*keep, "no", "_w", "_h", F.col("_o.name").alias("class_name"), *[number(F.col(f"_o.bndbox.{c}")).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    boxes = boxes.filter("xmin IS NOT NULL AND ymin IS NOT NULL AND xmax IS NOT NULL AND ymax IS NOT NULL")
    made = geometry.centred(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax", "_w", "_h")])
    out = boxes.join(small_side(classes.select("class_name", "class_id")), "class_name").select(*keep, "no", "class_id", *[c.alias(k) for k, c in made.items()])
    text = [geometry.six_places(F.col(c), places) for c in ("x_center", "y_center", "width", "height")]
    return out.withColumn("line", F.concat_ws(" ", F.col("class_id").cast("string"), *text))


def sized(docs: DataFrame) -> DataFrame:
    """VOC records with a positive size: those that a YOLO file can be made of, also without objects."""
    return docs.filter(" AND ".join(f"coalesce(try_cast(trim(size.{c}) AS double), 0) > 0" for c in ("width", "height")))


def yolo_files(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(stem, value): the text of a YOLO file for each of files (path) from (path, no, line).

    Lines stand in the order of their objects, each with its end; a file
    without lines is empty. Of files with one stem the greatest path stays.
    """
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("no", "line"))), lambda x: F.concat(x["line"], F.lit("\n")))
    texts = lines.filter("line <> ''").groupBy("path").agg(F.array_join(ordered, "").alias("value"))
    whole = files.filter("path IS NOT NULL").select("path").distinct().join(texts, "path", "left").select("path", F.coalesce("value", F.lit("")).alias("value"))
    return whole.groupBy(paths.stem(F.col("path")).alias("stem")).agg(F.max_by("value", "path").alias("value"))


def success_counts(files: DataFrame, converted: DataFrame, key: str) -> DataFrame:
    """One row (files, converted): how many files there are and how many of them were converted, by a key that is null for neither."""
    return files.agg(F.count(key).alias("files")).crossJoin(converted.agg(F.count_distinct(key).alias("converted")))  # one row each
