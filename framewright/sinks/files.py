"""Files written, moved and deleted from a plan, which is a DataFrame until it is carried out.

Paths are of a file system that all executors share.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import paths
from framewright.session import bounded_rows, checkpointed, ship

_DONE = "path string, target string, done boolean, message string"


def move_plan(files: DataFrame, target: str) -> DataFrame:
    """(path, target) of the files that are not in the target folder already."""
    to = F.concat(F.lit(target.rstrip("/") + "/"), paths.name(F.col("path")))
    return files.select("path", to.alias("target")).filter("path <> target").distinct()


def delete_plan(files: DataFrame) -> DataFrame:
    """(path, target) with a null target, each path once."""
    return files.select("path", F.lit(None).cast("string").alias("target")).filter("path IS NOT NULL").distinct()


def paths_frame(spark: SparkSession, given: Sequence[str | Path] | str | Path) -> DataFrame:
    """(path) of a path or a list or tuple of paths."""
    if isinstance(given, (str, Path)):
        given = [given]
    if not isinstance(given, (list, tuple)):
        raise TypeError("give a path or a list or tuple of paths")
    return spark.createDataFrame([(str(p),) for p in given], "path string")


def carry_out(plan: DataFrame) -> DataFrame:
    """Moves or deletes what a plan names and returns (path, target, done, message).

    What is gone already counts as done, so a repeated task does no harm; a
    file of the target's name is replaced.
    """
    def act(batches):
        for batch in batches:
            done, messages = [], []
            for source, target in zip(batch["path"], batch["target"]):
                try:
                    if os.path.exists(source):
                        shutil.move(source, target) if target else os.remove(source)
                    done.append(True)
                    messages.append(None)
                except OSError as e:
                    done.append(False)
                    messages.append(str(e))
            yield batch.assign(done=done, message=messages)

    ship(plan.sparkSession)
    return plan.mapInPandas(act, _DONE)


def write_texts(texts: DataFrame, folder: str, suffix: str) -> int:
    """Writes (stem, value) to one file each and returns how many; a file appears whole or not at all."""
    os.makedirs(folder, exist_ok=True)

    def act(batches):
        for batch in batches:
            for stem, value in zip(batch["stem"], batch["value"]):
                _put(Path(folder) / f"{stem}{suffix}", (value or "").encode())
            yield batch[["stem"]]

    ship(texts.sparkSession)
    return texts.select("stem", "value").mapInPandas(act, "stem string").count()


def write_frames(frames: DataFrame, folder: str, suffix: str = ".npy") -> DataFrame:
    """Writes sampled frames (video, number, height, width, channels, data, status) as ``<stem>_<number><suffix>``.

    Returns (video, frames, status), worked out once: the frames written of
    each video and how reading it ended. Rows with a status have no frame.
    """
    os.makedirs(folder, exist_ok=True)

    def act(batches):
        import io

        import numpy as np

        for batch in batches:
            written = batch["status"].isna()
            for r in batch[written].itertuples():
                raster = np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), int(r.channels))
                if suffix == ".npy":
                    buffer = io.BytesIO()
                    np.save(buffer, raster)
                    data = buffer.getvalue()
                else:
                    import cv2

                    data = cv2.imencode(suffix, raster)[1].tobytes()
                _put(Path(folder) / f"{Path(r.video).stem}_{int(r.number)}{suffix}", data)
            yield batch[["video", "status"]].assign(frames=written.astype("int64"))

    ship(frames.sparkSession)
    rows = frames.select("video", "number", "height", "width", "channels", "data", "status").mapInPandas(act, "video string, status string, frames bigint")
    return checkpointed(rows.groupBy("video").agg(F.sum("frames").alias("frames"), F.max("status").alias("status")))


def write_class_file(classes: DataFrame, folder: str) -> None:
    """Writes classes.txt, names by id; also with no classes."""
    rows = sorted(bounded_rows(classes.select("class_id", "class_name"), 100_000, "the class list"))
    os.makedirs(folder, exist_ok=True)
    _put(Path(folder) / "classes.txt", "".join(r["class_name"] + "\n" for r in rows).encode())


def _put(path: Path, data: bytes) -> None:
    part = path.with_name(f".{path.name}.{os.getpid()}")
    part.write_bytes(data)
    os.replace(part, path)
