"""The seven commands on folders of files, and their command line.

Commands that move or delete return a plan and carry it out only if told to.
"""

from __future__ import annotations

import argparse
import logging
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import registry, report
from framewright.functions import paths, raster
from framewright.operators import cache_merge, convert, dedup, features, frames, hamming, projection, statistics
from framewright.sinks import files
from framewright.session import checkpointed, ship
from framewright.sources import cache, config, scan, video, voc

log = logging.getLogger("framewright")
#: Videos named in the log that could not be read to their end; the rest is in the result.
MOST_LOGGED = 100


def _existing(folder: str) -> str:
    if not Path(folder).is_dir():
        raise FileNotFoundError(folder)
    return folder


def _acted(plan: DataFrame, act: bool) -> DataFrame:
    """The plan, or what came of carrying it out; kept, as a second run would find the files gone."""
    if not act:
        return plan
    done = files.carry_out(plan).persist()
    done.count()
    return done


def move(spark: SparkSession, s: config.Settings, src: str, dst: str, act: bool = False) -> DataFrame:
    Path(dst).mkdir(parents=True, exist_ok=True)
    return _acted(files.move_plan(scan.listing(spark, _existing(src), s.pattern), dst), act)


def delete(spark: SparkSession, s: config.Settings, src: str, act: bool = False) -> DataFrame:
    if not s.pattern:
        raise ValueError("deleting needs a pattern")
    return _acted(files.delete_plan(scan.listing(spark, _existing(src), s.pattern)), act)


def slice_videos(spark: SparkSession, s: config.Settings, src: str, dst: str, act: bool = False) -> DataFrame:
    """Sampled frames to files. Only videos that were read to their end and gave frames are removed, and only with remove."""
    ship(spark)
    spark.dataSource.register(video.VideoFrames)
    rows = spark.read.format("video_frames").option("step_sec", s.step_sec).load(_existing(src))
    kept = frames.sampled(rows.filter("status IS NULL"), s.step_sec).unionByName(rows.filter("status IS NOT NULL"), allowMissingColumns=True)
    done = files.write_frames(kept, dst, s.suffix)
    for r in done.filter(F.col("status") != video.DONE).take(MOST_LOGGED):
        log.warning("%s was not read to its end: %s", r["video"], r["status"])
    plan = files.delete_plan(done.filter((F.col("status") == video.DONE) & (F.col("frames") > 0)).select(F.col("video").alias("path")))
    return _acted(plan, act and s.remove)


def hash_cache(spark: SparkSession, s: config.Settings, src: str) -> DataFrame:
    """(path, mtime, length, hash) of the images of a folder; only new and changed ones are read."""
    now = scan.listing(spark, _existing(src), s.pattern).filter(paths.has_extension(F.col("path"), s.extensions)).select("path", "mtime", "length")
    folder = str(Path(s.cache_file_path) / cache.file_name(src, s.cache_name, method=s.method, size=s.core_size))
    stored = cache.load(spark, folder, cache.HASH_SCHEMA)
    same = [now[c].eqNullSafe(stored[c]) for c in ("path", "mtime", "length")]
    kept = stored.join(now, same, "left_semi")
    todo = now.join(stored, same, "left_anti")
    done = raster.image_features(scan.images_at(todo), s.core_size).select(paths.of_uri(F.col("path")).alias("path"), "hash")
    whole = cache_merge.combined(kept, todo.join(done, "path"))
    target = cache.save(whole, folder)
    return spark.read.schema(cache.HASH_SCHEMA).parquet(str(target)) if target else whole


def dedup_images(spark: SparkSession, s: config.Settings, src: str, act: bool = False) -> DataFrame:
    """Plan to delete near-duplicates; of similar images the first path stays."""
    from pyspark.sql import Window

    duplicates = registry.lookup("duplicates", s.method)
    hashes = hash_cache(spark, s, src).filter("hash IS NOT NULL")
    # ids in the order of paths, without bringing all rows to one place
    placed = hashes.select("path", "hash").repartitionByRange("path").sortWithinPartitions("path").withColumn("_p", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("_p").orderBy("path")).cast("bigint")
    numbered = checkpointed(placed.select("path", "hash", (F.shiftleft(F.col("_p").cast("bigint"), 40) + within).alias("id")))
    gone = duplicates(numbered, bits=s.core_size**2, most=hamming.threshold_bits(s.core_size, s.hash_threshold), id_col="id")
    return _acted(files.delete_plan(numbered.join(gone, "id").select("path")), act and s.remove)


def clean_annotations(spark: SparkSession, s: config.Settings, src: str, act: bool = False) -> DataFrame:
    images = scan.listing(spark, _existing(src), s.pattern)
    annotations = scan.listing(spark, _existing(s.a_source or src), s.a_suffix)
    return _acted(files.delete_plan(features.orphan_annotations(annotations, images)), act)


def convert_annotations(spark: SparkSession, s: config.Settings, src: str, dst: str, img_path: str | None = None, source_type: str = "voc") -> int:
    """Writes the other format's files and returns how many."""
    to_format = registry.lookup("converter", f"{source_type}:{s.destination_type}")
    if source_type == "voc":
        docs = voc.read(spark, _existing(src)).filter(F.lower(paths.suffix(F.col("path"))) == ".xml")
        classes = features.class_ids(docs.select(F.explode("object.name").alias("class_name")))
        done = files.write_texts(convert.yolo_files(to_format(docs, classes), convert.sized(docs)), dst, ".txt")
        files.write_class_file(classes, dst)
        return done
    texts = voc.to_text(to_format(yolo_pixels(spark, s, src, img_path or src)))
    return files.write_texts(texts.withColumn("stem", paths.stem(F.col("path"))), dst, ".xml")


def _image_files(spark: SparkSession, s: config.Settings, folder: str) -> DataFrame:
    """(stem, im_path) of the images of a folder, by their names."""
    return features.image_lookup(scan.listing(spark, _existing(folder)), s.extensions)


def yolo_pixels(spark: SparkSession, s: config.Settings, src: str, img_path: str, only: DataFrame | None = None) -> DataFrame:
    """Boxes of the YOLO files of a folder in pixels of their images, by stem; only images of such files are read. only: see feature_matrix."""
    texts = scan.whole_texts(spark, _existing(src), "*.txt").filter(paths.name(F.col("path")) != "classes.txt")
    if only is not None:
        texts = texts.join(only.select("path").distinct(), "path", "left_semi")
    listed = Path(src) / "classes.txt"
    classes = scan.class_file(spark, str(listed)) if listed.exists() else spark.createDataFrame([], "class_id int, class_name string")
    by_path = features.with_image(texts.select("path"), _image_files(spark, s, img_path), "inner").select("path", "im_path")
    images = scan.images_at(by_path.select(F.col("im_path").alias("path"))).filter("image.height > 0")
    sizes = images.select(paths.of_uri(F.col("image.origin")).alias("im_path"), F.col("image.width").alias("im_width"), F.col("image.height").alias("im_height"))
    lines = convert.yolo_lines(texts).select("path", F.col("first_no").alias("no"), "line")
    return convert.to_pixels(convert.yolo_boxes(lines, keep=("path", "no")), by_path.join(sizes, "im_path").drop("im_path"), classes, keep=("no",))


def feature_matrix(spark: SparkSession, s: config.Settings, src: str, img_path: str, source_type: str = "voc", only: DataFrame | None = None) -> DataFrame:
    """The feature matrix of a folder of annotations with the quality of their images.

    only: (path) of the files to take, else all. Images that no such file has are not read.
    """
    if source_type == "yolo":
        docs = convert.voc_records(yolo_pixels(spark, s, src, img_path, only))
    else:
        docs = voc.read(spark, _existing(src)).drop("mtime")
    if only is not None:
        docs = docs.join(only.select("path").distinct(), "path", "left_semi")
    found = features.voc_features(docs, margin=s.margin_threshold)
    lookup = _image_files(spark, s, img_path)
    wanted = lookup.join(found.select(paths.stem(F.col("path")).alias("stem")).distinct(), "stem", "left_semi").select(F.col("im_path").alias("path"))
    quality = raster.image_features(scan.images_at(wanted), s.core_size).select(paths.of_uri(F.col("path")).alias("im_path"), "im_brightness", "im_contrast", "im_blur_score")
    return features.with_image(found, lookup.join(quality, "im_path"), "inner" if source_type == "yolo" else "left").drop("stem")


def cached_matrix(spark: SparkSession, s: config.Settings, src: str, img_path: str, source_type: str = "voc") -> DataFrame:
    """The feature matrix with mtime, of which only new and changed files are worked on; kept as the cache's next version."""
    now = scan.listing(spark, _existing(src), (".txt",) if source_type == "yolo" else (".xml",)).select("path", "mtime")
    folder = str(Path(s.cache_file_path) / cache.file_name(src, s.cache_name, format=source_type, margin=s.margin_threshold))
    done = cache.versions(folder)
    if not done:
        whole = feature_matrix(spark, s, src, img_path, source_type).join(now, "path")
    else:
        stored = spark.read.parquet(str(done[-1]))
        fresh = feature_matrix(spark, s, src, img_path, source_type, cache_merge.to_update(now, stored)).join(now, "path")
        whole = cache_merge.combined(cache_merge.still_valid(stored, now), fresh)
    target = cache.save(whole, folder)
    return spark.read.parquet(str(target)) if target else whole


def configure_logging(s: config.Settings, name: str) -> None:
    """Log lines of a command to the console and to a file of its name below the log folder."""
    Path(s.log_path).mkdir(parents=True, exist_ok=True)
    log.handlers.clear()
    for handler in (logging.StreamHandler(), logging.FileHandler(Path(s.log_path) / f"{name}.log")):
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
    log.setLevel(s.log_level.upper())


def stats(spark: SparkSession, s: config.Settings, src: str, img_path: str | None = None, source_type: str = "voc") -> str:
    """The text report; the marked and projected matrix and the charts' tables are written below the report folder."""
    matrix = cached_matrix(spark, s, src, img_path or src, source_type)
    marked = projection.projected(statistics.mark_outliers(matrix), projection.numeric_features(matrix))
    folder = scan.next_report_folder(s.report_path)
    marked.write.parquet(str(folder / "features"))
    stored = spark.read.parquet(str(folder / "features"))
    for name, table in report.chart_data(stored).items():
        table.write.parquet(str(folder / name))
    text = registry.lookup("report", s.datatype)(stored, source_type, s.img_dataset_report_schema)
    (folder / "report.txt").write_text(text)
    return text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="framewright")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("move", "slice", "delete", "dedup", "clean-annotations", "convert-annotations", "stats"):
        p = commands.add_parser(name)
        p.add_argument("src")
        p.add_argument("-p", "--pattern", nargs="*")
        p.add_argument("-r", "--repeat", action="store_true", default=None)
        p.add_argument("-s", "--sleep", type=int)
        p.add_argument("--log_path")
        p.add_argument("--log_level")
        p.add_argument("--yes", action="store_true", help="carry out what the plan says")
        p.add_argument("--dst")
        p.add_argument("-rm", "--remove", action="store_true", default=None)
        p.add_argument("-t", "--type", dest="suffix")
        p.add_argument("-step", "--step_sec", type=float)
        p.add_argument("--threshold", dest="hash_threshold", type=int)
        p.add_argument("--datatype")
        p.add_argument("-m", "--method")
        p.add_argument("--core_size", type=int)
        p.add_argument("--cache_name")
        p.add_argument("--n_jobs", help="taken for compatibility; the session's cores decide")
        p.add_argument("--a_suffix", nargs="+")
        p.add_argument("--a_source")
        p.add_argument("--destination-type", dest="destination_type")
        p.add_argument("--img_path")
        p.add_argument("--ext", dest="extensions", nargs="+")
        p.add_argument("--margin", dest="margin_threshold", type=int)
        p.add_argument("--report_path")
    return top


def run(spark: SparkSession, arguments: list[str], config_file: str = "config.json", ask: Callable[[str], str] | None = None):
    """One command line; with repeat again after sleep seconds until interrupted.

    ask is given a question and its answer, if it is one of confirm_choice,
    does what --yes does.
    """
    a = parser().parse_args(arguments)
    s = config.load(config_file, **vars(a))
    if not a.yes and ask is not None:
        a.yes = ask(f"{a.command} {a.src}? ({'/'.join(s.confirm_choice)}) ").strip().lower() in s.confirm_choice
    configure_logging(s, a.command)
    kind = next((p for p in s.pattern if p in ("voc", "yolo")), "voc")
    actions = {
        "move": lambda: move(spark, s, a.src, a.dst, a.yes),
        "slice": lambda: slice_videos(spark, s, a.src, a.dst, a.yes),
        "delete": lambda: delete(spark, s, a.src, a.yes),
        "dedup": lambda: dedup_images(spark, s, a.src, a.yes),
        "clean-annotations": lambda: clean_annotations(spark, s, a.src, a.yes),
        "convert-annotations": lambda: convert_annotations(spark, s, a.src, a.dst, a.img_path, kind),
        "stats": lambda: stats(spark, s, a.src, a.img_path, kind),
    }
    while True:
        result = actions[a.command]()
        log.info("%s of %s is done", a.command, a.src)
        if not s.repeat:
            return result
        log.info("sleeping %s seconds", s.sleep)
        time.sleep(s.sleep)
