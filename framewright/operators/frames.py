"""Choosing frames of videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame_step(fps: Column, step_sec: float) -> Column:
    """Frames from one kept frame to the next, at least 1."""
    return F.greatest(F.lit(1), F.floor(fps * F.lit(float(step_sec))).cast("int"))


def sampled(frames: DataFrame, step_sec: float) -> DataFrame:
    """Every n-th of the frames (video, frame_id from 0, fps) with its number among the kept ones.

    The number follows from the place, so no frame waits for another.
    """
    step = frame_step(F.col("fps"), step_sec)
    return frames.filter(F.col("frame_id") % step == 0).withColumn("number", (F.col("frame_id") / step).cast("bigint"))


def numbered(rows: DataFrame, video: str, order: list[str]) -> DataFrame:
    """rows with frame_id: their place from 0 within a video."""
    return rows.withColumn("frame_id", F.row_number().over(Window.partitionBy(video).orderBy(*order)).cast("bigint") - 1)
