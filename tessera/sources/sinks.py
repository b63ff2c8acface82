"""Grids to files: a PNG or NumPy array for each image, written by the tasks that hold its rows."""

import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def interleaved(grid: DataFrame, channels: list[str], depth: int = 8, image: str = "image_id") -> DataFrame:
    """(image, y, row): each row's samples, channel by channel within a pixel, as big-endian integers."""
    packed = grid.groupBy(image, "y").agg(F.sort_array(F.collect_list(F.struct("x", *channels))).alias("cells"))
    wide = "%02X" if depth == 8 else "%04X"
    pixel = lambda c: F.concat(*(F.format_string(wide, c[n].cast("int")) for n in channels))
    return packed.select(image, "y", F.unhex(F.array_join(F.transform("cells", pixel), "")).alias("row"))


def png(rows: list[bytes], channels: int, depth: int) -> bytes:
    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    width = len(rows[0]) // (channels * depth // 8)
    head = struct.pack(">IIBBBBB", width, len(rows), depth, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")


def npy(rows: list[bytes], channels: int, depth: int) -> bytes:
    top = (1 << depth) - 1
    samples = np.frombuffer(b"".join(rows), ">u1" if depth == 8 else ">u2").reshape(1, len(rows), -1, channels)
    out = io.BytesIO()
    np.save(out, (samples / top).astype("<f4"))
    return out.getvalue()


def encode(packed: DataFrame, channels: int, form: str = "png", depth: int = 8, image: str = "image_id") -> DataFrame:
    """(image, content): one file an image; an image is what a format of one stream must hold at once."""
    make = {"png": png, "npy": npy}[form]

    def run(key, rows):
        ordered = rows.sort_by("y").column("row").to_pylist()
        return pa.table([pa.array([key[0].as_py()]), pa.array([make(ordered, channels, depth)], pa.binary())], [image, "content"])

    return packed.groupBy(image).applyInArrow(run, f"{image} {packed.schema[image].dataType.simpleString()}, content binary")
