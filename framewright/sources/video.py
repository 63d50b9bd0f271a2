"""Frames of videos as a DataFrame, by a Python data source.

Decoders are registered by suffix. One for stacks of raw frames (``.npy``,
frames x height x width x channels) is built in; others are found where their
library is installed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Frame = tuple[int, float, bytes, int, int, int]


def _stack(path: str) -> Iterator[Frame]:
    frames = np.load(path, mmap_mode="r")
    for i, f in enumerate(frames):
        yield i, 25.0, f.tobytes(), f.shape[0], f.shape[1], f.shape[2]


def _opencv(path: str) -> Iterator[Frame]:
    import cv2

    video = cv2.VideoCapture(path)
    if not video.isOpened():
        raise OSError("the video cannot be opened")
    fps, expected, i = video.get(cv2.CAP_PROP_FPS), int(video.get(cv2.CAP_PROP_FRAME_COUNT)), 0
    while (got := video.read())[0]:
        yield i, fps, got[1].tobytes(), *got[1].shape
        i += 1
    video.release()
    if i < expected:
        raise ValueError(f"{i} of {expected} frames could be read")


DECODERS: dict[str, Callable[[str], Iterator[Frame]]] = {".npy": _stack, ".mp4": _opencv, ".avi": _opencv}


#: Status of a video that was read to its end.
DONE = "done"


class VideoFrames(DataSource):
    """``spark.read.format("video_frames").load(folder)``: one task per video.

    With the option step_sec only every n-th frame leaves the task. After its
    frames each video gives one row without a frame, whose status is ``done``
    or tells why the video could not be read, or not to its end.
    """

    @classmethod
    def name(cls) -> str:
        return "video_frames"

    def schema(self) -> str:
        return "video string, frame_id bigint, fps double, height int, width int, channels int, data binary, status string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.step = options["path"], float(options.get("step_sec", 0))

    def partitions(self):
        return [InputPartition(str(p)) for p in sorted(Path(self.folder).iterdir()) if p.suffix.lower() in DECODERS]

    def read(self, partition):
        status = DONE
        try:
            for i, fps, data, h, w, c in DECODERS[Path(partition.value).suffix.lower()](partition.value):
                if not self.step or i % max(1, int(fps * self.step)) == 0:
                    yield partition.value, i, fps, h, w, c, data, None
        except Exception as e:  # noqa: BLE001 - decoders raise what they like
            status = f"{type(e).__name__}: {e}"
        yield partition.value, None, None, None, None, None, None, status
