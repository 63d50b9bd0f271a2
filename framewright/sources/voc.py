"""Pascal VOC annotations: reading XML files, and records to and from XML texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import paths

_BOX = "struct<xmin:string,ymin:string,xmax:string,ymax:string>"
#: Schema of a VOC record; every leaf is text as it stands in the file.
SCHEMA = (
    "filename string, path string, folder string, source struct<database:string>, size struct<width:string,height:string,depth:string>, segmented string, "
    f"object array<struct<name:string,pose:string,truncated:string,difficult:string,bndbox:{_BOX},part:array<struct<name:string,bndbox:{_BOX}>>>>"
)
_OPTIONS = {"rowTag": "annotation", "ignoreSurroundingSpaces": "true"}


def parsed(texts: DataFrame, column: str = "value") -> DataFrame:
    """texts with doc: the record of an XML text. A text that is no XML gives nulls; one object gives an array of one."""
    return texts.withColumn("doc", F.from_xml(F.col(column), SCHEMA, _OPTIONS))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per XML file of a folder: path, mtime and the record's columns."""
    files = spark.read.text(path, wholetext=True).select("value", paths.of_uri(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_modification_time").alias("mtime"))
    doc = parsed(files)
    return doc.select(F.col("file").alias("path"), "mtime", "doc.filename", "doc.folder", "doc.size", "doc.segmented", "doc.object")


def text_of(record: Column) -> Column:
    """The XML text of a record."""
    return F.to_xml(record, {"rowTag": "annotation", "indent": " "})


def to_text(records: DataFrame, key: str = "path") -> DataFrame:
    """(key, value): the XML text of each record."""
    rest = [c for c in records.columns if c != key]
    return records.select(key, text_of(F.struct(*rest)).alias("value"))
