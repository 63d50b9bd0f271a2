"""Settings: defaults, then the environment, then a JSON file, then what a caller gives."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

from framewright.functions.geometry import SECTOR_COLUMNS, TRUNCATION_COLUMNS

#: Sections of the report (fixed values).
REPORT_SCHEMA = (
    {"title": "GEOMETRY", "type": "numeric", "columns": ("object_area", "object_relative_area", "object_width", "object_height", "object_aspect_ratio")},
    {"title": "SPATIAL BIAS", "type": "binary", "columns": SECTOR_COLUMNS},
    {"title": "TRUNCATION", "type": "binary", "columns": TRUNCATION_COLUMNS},
    {"title": "IMAGE QUALITY", "type": "numeric", "columns": ("im_brightness", "im_contrast", "im_blur_score")},
)


@dataclass(frozen=True)
class Settings:
    """Parameters of the commands; a value out of its range is an error."""

    pattern: tuple[str, ...] = ()
    repeat: bool = False
    sleep: int = 60
    remove: bool = False
    suffix: str = ".jpg"
    step_sec: float = 1.0
    log_path: str = "./log"
    log_level: str = "INFO"
    datatype: str = "image"
    method: str = "dhash"
    hash_threshold: int = 10
    confirm_choice: tuple[str, ...] = ("yes",)
    core_size: int = 8
    cache_file_path: str = "./cache"
    cache_name: str | None = None
    a_suffix: tuple[str, ...] = ()
    a_source: str | None = None
    destination_type: str | None = None
    extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png")
    margin_threshold: int = 5
    report_path: str = "./reports"
    img_dataset_report_schema: tuple = REPORT_SCHEMA

    def __post_init__(self):
        checks = {
            "sleep must be 0 or more": self.sleep >= 0,
            "step_sec must be 0.1 or more": self.step_sec >= 0.1,
            "hash_threshold must be from 0 to 100": 0 <= self.hash_threshold <= 100,
            "margin_threshold must be from 0 to 100": 0 <= self.margin_threshold <= 100,
            "core_size must be a power of two of 8 or more": self.core_size >= 8 and self.core_size & (self.core_size - 1) == 0,
        }
        for message, good in checks.items():
            if not good:
                raise ValueError(message)

    def merged(self, given: dict) -> "Settings":
        """These settings with the known, non-null entries of given."""
        names = {f.name: f for f in fields(self)}
        return replace(self, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in names and v is not None})


def _environment() -> dict:
    """Settings from variables APP_<NAME>; lists and numbers are written as JSON, texts plainly."""
    out = {}
    for f in fields(Settings):
        text = os.environ.get(f"APP_{f.name.upper()}")
        if text is not None:
            try:
                value = json.loads(text)
            except ValueError:
                value = text
            out[f.name] = text if f.default is None or isinstance(f.default, str) else value
    return out


def load(path: str = "config.json", **given) -> Settings:
    """Defaults, under the environment, under a file if it is there and is JSON, under what is given."""
    try:
        stored = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        stored = {}
    return Settings().merged(_environment()).merged(stored if isinstance(stored, dict) else {}).merged(given)
