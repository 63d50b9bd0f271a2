"""Repeated processing of a folder as a stream of its new files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from framewright.functions import paths
from framewright.session import checkpointed, removed, shared_folder

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def watch(
    spark: SparkSession, folder: str, work: Callable[[DataFrame, int], None], checkpoint: str, *, pattern: str = "*", sleep: float | None = None, content: bool = False
) -> StreamingQuery:
    """Calls work(files, batch) for the files that have come since the checkpoint.

    Without sleep once, over what is there; else every sleep seconds. A batch
    that failed is given again under its number. The source tells neither of
    changed nor of removed files: merge those with operators.cache_merge.
    """
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).load(folder)
    chosen = files.select(paths.local(F.col("path")).alias("path"), F.col("modificationTime").alias("mtime"), "length", *(["content"] if content else []))
    writer = chosen.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if sleep is None else writer.trigger(processingTime=f"{sleep} seconds")).start()


def read_once(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """A Parquet table of a folder, taken in as a stream until nothing is left, from the batches it was kept in.

    The stream's checkpoint and its batches lie in the folder that all
    executors share until the rows are together; a batch that is repeated replaces itself.
    """
    root = f"{shared_folder(spark)}/poll-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name[:-1]}[{name[-1]}]")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    source.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = checkpointed(spark.read.schema(schema).parquet(f"{root}/rows"))
    removed(spark, root)
    return rows


def appended_features(docs: DataFrame, target: str) -> Callable[[DataFrame, int], None]:
    """work for watch: features of the records of new files (docs: path and record), kept once per batch number."""
    from framewright.operators.features import voc_features

    def work(files: DataFrame, batch: int) -> None:
        fresh = docs.join(files.select("path").distinct(), "path", "left_semi")
        voc_features(fresh).write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return work
