"""ETS image files as frames: the chunk table is read first, then a task reads ranges of frames."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import FRAMES, Read, framed, opened, reader

#: Numpy kinds of the format's sample codes.
KINDS = {1: "<i1", 2: "<u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 9: "<f4"}


def parse_header(source: bytes | Read) -> dict:
    """Sample code, width, height, and the offset of every chunk by (channel, frame)."""
    read = reader(source)
    head = read(0, 44)
    if head[:4] != b"SIS\0":
        raise ValueError("not an ETS file")
    dimensions, more = struct.unpack_from("<IQ", head, 12)
    table, count = struct.unpack_from("<QI", head, 32)
    second = read(more, 36)
    if second[:4] != b"ETS\0":
        raise ValueError("the ETS header is missing")
    code = struct.unpack_from("<I", second, 8)[0]
    if code not in KINDS:
        raise ValueError(f"unknown ETS sample code {code}")
    width, height = struct.unpack_from("<II", second, 28)
    step = 4 + 4 * dimensions + 8 + 8
    entries = read(table, count * step)
    chunks = {}
    for k in range(count):
        place = struct.unpack_from(f"<{dimensions}I", entries, k * step + 4)
        offset = struct.unpack_from("<Q", entries, k * step + 4 + 4 * dimensions)[0]
        chunks[place[4] if dimensions > 4 else 0, place[2]] = offset
    return {"code": code, "width": width, "height": height, "chunks": chunks}


def chunk(source: bytes | Read, header: dict, offset: int) -> np.ndarray:
    n = header["width"] * header["height"]
    data = reader(source)(offset, n * np.dtype(KINDS[header["code"]]).itemsize)
    return np.frombuffer(data, KINDS[header["code"]], n).reshape(header["height"], header["width"])


def listed_chunk(read: Read, one: dict) -> np.ndarray:
    return chunk(read, one, one["offset"]).astype(np.float32)


def write_ets(videos: dict[int, dict[int, np.ndarray]], code: int = 4) -> bytes:
    """An ETS file of images by channel and frame; frames may be missing."""
    images = [(c, f, np.asarray(p)) for c, frames in sorted(videos.items()) for f, p in sorted(frames.items())]
    h, w = images[0][2].shape
    head, more = 44, 44
    body = bytearray(b"\0" * head)
    body += b"ETS\0" + struct.pack("<II", 0, code) + b"\0" * 16 + struct.pack("<II", w, h)
    offsets = []
    for _, _, p in images:
        offsets.append(len(body))
        body += p.astype(KINDS[code]).tobytes()
    table = len(body)
    for (c, f, _), offset in zip(images, offsets, strict=True):
        body += struct.pack("<I5IQ", 0, 0, 0, f, 0, c, offset) + b"\0" * 8
    body[:44] = b"SIS\0" + b"\0" * 8 + struct.pack("<IQ", 5, more) + b"\0" * 8 + struct.pack("<QI", table, len(images))
    return bytes(body)


def read_ets(spark: SparkSession, path: str, channel: int | None = None, compact_missing: bool = False, glob: str = "*.ets", frames: int = FRAMES, open_file: Callable[[str], Read] = opened) -> DataFrame:
    """video_id (path), channel, frame, nrows, ncols, px; samples by the file's code, missing frames left out.

    frame keeps the file's numbers; with compact_missing they are counted through. With a channel, the bytes of
    the others aren't read.
    """

    def listed(read: Read) -> Iterator[dict]:
        header, counts = parse_header(read), {}
        for (c, f), offset in sorted(header["chunks"].items()):
            if channel is None or c == channel:
                k = counts[c] = counts.get(c, -1) + 1
                yield {"channel": c, "frame": k if compact_missing else f, "offset": offset} | {n: header[n] for n in ("code", "width", "height")}

    return framed(spark, path, glob, listed, listed_chunk, ["channel", "frame"], frames, open_file)


def channels(spark: SparkSession, path: str) -> DataFrame:
    """Frames found of each channel."""
    return read_ets(spark, path).groupBy("video_id", "channel").agg(F.count("*").alias("frames"))
