"""PNG files made with zlib alone."""

import struct
import zlib

import numpy as np


def png(path, raster: np.ndarray) -> None:
    """Writes an 8-bit gray (h, w) or red-green-blue (h, w, 3) raster."""
    h, w = raster.shape[:2]
    rows = b"".join(b"\0" + r.tobytes() for r in raster.astype(np.uint8))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if raster.ndim == 2 else 2, 0, 0, 0)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))
