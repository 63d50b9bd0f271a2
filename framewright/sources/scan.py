"""Listing and reading files."""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import paths


def listing(spark: SparkSession, folder: str, patterns: Sequence[str] = ()) -> DataFrame:
    """(path, mtime, length, stem, suffix) of the files right in a folder whose name holds one of patterns, each once.

    No patterns take every file. The content is not read. Names that begin
    with ``_`` or ``.`` are skipped, as Spark's file sources do.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(folder).select("path", F.col("modificationTime").alias("mtime"), "length")
    files = files.withColumn("path", paths.local(F.col("path")))
    p = F.col("path")
    if patterns:
        files = files.filter(paths.matches_any(p, patterns))
    return files.withColumn("stem", paths.stem(p)).withColumn("suffix", paths.suffix(p))


def whole_texts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, value): each file of a folder as one text."""
    read = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return read.select(paths.of_uri(F.col("_metadata.file_path")).alias("path"), "value")


def class_file(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, class_name) of a class list; a line's place from 0 is its id, of a repeated name the last."""
    from framewright.operators.features import class_map

    lines = whole_texts(spark, path).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    return class_map(lines).select("class_id", "class_name")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Spark's image rows (column image: origin, height, width, nChannels, data), unreadable ones with height -1."""
    return spark.read.format("image").option("dropInvalid", False).load(folder)


def images_at(files: DataFrame) -> DataFrame:
    """Image rows of just the files (path); no other is opened.

    Their paths come to the driver, as those of any files that Spark lists.
    """
    spark = files.sparkSession
    found = [r["path"] for r in files.select("path").distinct().toLocalIterator()]
    if not found:
        return spark.createDataFrame([], "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    plain = [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in found]  # no patterns
    return spark.read.format("image").option("dropInvalid", False).load(plain)


def next_report_folder(root: str) -> Path:
    """The folder after the greatest numbered one below root; other names do not count."""
    numbers = [int(p.name) for p in Path(root).iterdir() if p.is_dir() and p.name.isdigit()] if Path(root).exists() else []
    return Path(root) / str(max(numbers, default=0) + 1)
