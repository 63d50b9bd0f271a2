"""The feature matrix: one row per annotated object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import geometry, paths
from framewright.functions.numbers import small_side
from framewright.session import bounded_rows

#: Most names of a class list; it is held on the driver and on every executor.
MOST_CLASSES = 100_000
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png")


def voc_features(docs: DataFrame, *, margin: int = 5, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Features of the objects of VOC records (columns size, object and those of keep).

    A record without a positive width and height gives no rows; neither does
    one in which a corner of any object is no whole number, since a file is
    taken or left as a whole. Null elements are no objects. A missing name is
    ``unfilled``. Narrow: no shuffle.
    """
    objects = F.filter("object", lambda o: o.isNotNull())
    corner = lambda o, c: geometry.text_int(o["bndbox"][c])
    boxes = F.transform(
        objects, lambda o: F.struct(o["name"].alias("name"), *[corner(o, c).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    )
    sized = docs.select(
        *keep,
        *[F.coalesce(geometry.text_int(F.col(f"size.{c}")), F.lit(0)).alias(f"im_{c}") for c in ("width", "height", "depth")],
        boxes.alias("_b"),
    ).filter("im_width > 0 AND im_height > 0 AND size(_b) > 0")
    whole = sized.filter(F.forall("_b", lambda b: b["xmin"].isNotNull() & b["ymin"].isNotNull() & b["xmax"].isNotNull() & b["ymax"].isNotNull()))
    n = F.size("_b")
    rows = whole.select(*keep, "im_width", "im_height", "im_depth", n.alias("objects_count"), (n > 1).cast("int").alias("has_neighbors"), F.explode("_b").alias("_o"))
    made = geometry.box_features(*[F.col(f"_o.{c}") for c in ("xmin", "ymin", "xmax", "ymax")], F.col("im_width"), F.col("im_height"), margin)
    return rows.select(
        *keep,
        F.coalesce("_o.name", F.lit(geometry.NO_CLASS)).alias("class_name"),
        "objects_count", "im_width", "im_height", "im_depth", "has_neighbors",
        *[c.alias(k) for k, c in made.items()],
    )


def broken_files(docs: DataFrame, *, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Records that voc_features leaves out, with the reason: ``size``, ``box`` or ``empty``."""
    objects = F.filter("object", lambda o: o.isNotNull())
    readable = F.forall(objects, lambda o: geometry.text_int(o["bndbox"]["xmin"]).isNotNull() & geometry.text_int(o["bndbox"]["ymin"]).isNotNull() & geometry.text_int(o["bndbox"]["xmax"]).isNotNull() & geometry.text_int(o["bndbox"]["ymax"]).isNotNull())
    side = lambda c: F.coalesce(geometry.text_int(F.col(f"size.{c}")), F.lit(0)) > 0
    reason = F.when(~(side("width") & side("height")), "size").when(F.coalesce(F.size(objects), F.lit(0)) <= 0, "empty").when(~F.coalesce(readable, F.lit(False)), "box")
    return docs.select(*keep, reason.alias("reason")).filter("reason IS NOT NULL")


def image_lookup(images: DataFrame, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """(stem, im_path): the greatest path of each stem among files with an image extension."""
    p = F.col("path")
    return images.filter(p.isNotNull() & paths.has_extension(p, extensions)).groupBy(paths.stem(p).alias("stem")).agg(F.max("path").alias("im_path"))


def with_image(annotations: DataFrame, lookup: DataFrame, how: str = "left") -> DataFrame:
    """Annotations with im_path by the stem of their path: ``left`` keeps those without an image, ``inner`` drops them."""
    return annotations.withColumn("stem", paths.stem(F.col("path"))).join(lookup, "stem", how)


def orphan_annotations(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotation paths without an image of their stem. Refuses to call all of them orphans for want of images."""
    stems = images.filter("path IS NOT NULL").select(paths.stem(F.col("path")).alias("stem")).distinct()
    if stems.isEmpty():
        raise ValueError("there are no images; every annotation would be an orphan")
    own = annotations.filter(F.col("path").isNotNull() & (paths.name(F.col("path")) != "classes.txt")).select("path").distinct()
    return own.withColumn("stem", paths.stem(F.col("path"))).join(stems, "stem", "left_anti").select("path")


def class_ids(names: DataFrame) -> DataFrame:
    """(class_name, class_id): places of the distinct names in code-point order, from 0. More than MOST_CLASSES names are an error."""
    rows = bounded_rows(names.filter("class_name IS NOT NULL").select("class_name").distinct(), MOST_CLASSES, "the class list")
    return names.sparkSession.createDataFrame([(name, i) for i, name in enumerate(sorted(r["class_name"] for r in rows))], "class_name string, class_id int")


def class_map(lines: DataFrame) -> DataFrame:
    """(class_name, class_id) of a class list (line_no, line): a repeated name has its last place."""
    return lines.filter("line <> ''").groupBy(F.col("line").alias("class_name")).agg(F.max("line_no").alias("class_id"))


def named_classes(boxes: DataFrame, classes: DataFrame) -> DataFrame:
    """boxes with class_name for their class_id text; an unknown id is ``object_<id>``."""
    dim = small_side(classes.select(F.col("class_id").cast("string").alias("class_id"), F.col("class_name").alias("_name")).groupBy("class_id").agg(F.max("_name").alias("_name")))
    return boxes.join(dim, "class_id", "left").withColumn("class_name", F.coalesce("_name", F.concat(F.lit("object_"), F.col("class_id")))).drop("_name")
