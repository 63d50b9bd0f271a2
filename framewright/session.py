"""Session helpers: reading tables, cutting lineage, one place for defaults."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("framewright")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="framewright-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; for a local master without the setting a temporary one, gone at the end."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", "")
    if not configured and not _one_machine(sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return configured or _own_folder()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for a context.

    Left out for a local master whose workers find it by themselves.
    """
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(sc, "_framewright_shipped", False):
        return
    known = [Path(p or ".").resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    if not (_one_machine(sc.master) and root in known):
        shared = None if _one_machine(sc.master) else shared_folder(spark).removeprefix("file://")
        if shared and "://" in shared:  # no path of the driver's: it serves the archive to the executors
            shared = None
        if shared:
            os.makedirs(shared, exist_ok=True)
        here = tempfile.mkdtemp(prefix="framewright", dir=shared)
        atexit.register(shutil.rmtree, here, ignore_errors=True)
        archive = Path(here) / "framewright.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted((root / "framewright").rglob("*.py")):
                z.write(f, f.relative_to(root))
        sc.addPyFile(str(archive))
    sc._framewright_shipped = True


def mapped(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """df by an iterator of Arrow batches, the package being there for the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores before costly work on each row, where its files make fewer partitions than that.

    Concerns plain scans only; other plans have their partitions from a
    shuffle, and asking for their number would run it.
    """
    plan = df._jdf.queryExecution().sparkPlan().toString()
    steps = re.findall(r"^[\s:+*()\d-]*(\w+)", plan, re.M)
    if steps.count("FileScan") != 1 or not set(steps) <= {"FileScan", "Filter", "Project"}:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a test-data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of df with a reliable checkpoint.

    The folder is the one named by ``spark.checkpoint.dir`` (shared by all
    executors). Only a local master without that setting gets a temporary one.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df written to a folder of its own in the shared one, and that folder, to be removed() once what comes of it is checkpointed.

    Cuts the lineage as a checkpoint does, but in compressed columns, of which later steps read what they need.
    """
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def removed(spark: SparkSession, folder: str) -> None:
    """Takes away a folder of this package's own, whatever its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collects a dimension that must be small; more than limit rows is an error, never a cut."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it cannot be held on every executor")
    return rows
