"""Multi-page TIFF files as frames: 8- and 16-bit grey, classic and BigTIFF, plain or PackBits, Deflate or LZW, with or without differences."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import FRAMES, Read, framed, listing, opened, reader

#: Sizes of TIFF field types.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
WHOLE = {1: "B", 3: "H", 4: "I", 13: "I", 16: "Q", 18: "Q"}


def directories(source: bytes | Read) -> Iterator[dict[int, list[int]]]:
    """Tags with whole-number values of each page, in order; reads the directories and nothing else."""
    read = reader(source)
    head = read(0, 16)
    if head[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF file")
    end = "<" if head[:2] == b"II" else ">"
    version = struct.unpack(end + "H", head[2:4])[0]
    if version not in (42, 43):
        raise ValueError(f"TIFF version {version}")
    big = version == 43
    word, size, entry = ("Q", 8, 20) if big else ("I", 4, 12)
    at = struct.unpack(end + word, head[8:16] if big else head[4:8])[0]
    seen = set()
    while at and at not in seen:
        seen.add(at)
        lead = 8 if big else 2
        count = struct.unpack(end + ("Q" if big else "H"), read(at, lead))[0]
        body = read(at + lead, count * entry + size)
        tags = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(end + "HH" + word, body, k * entry)
            if kind in WHOLE:
                held = body[k * entry + 4 + size : (k + 1) * entry]
                if TYPE_SIZE[kind] * n > size:
                    held = read(struct.unpack(end + word, held)[0], TYPE_SIZE[kind] * n)
                tags[tag] = list(struct.unpack_from(f"{end}{n}{WHOLE[kind]}", held))
        yield tags | {-1: [end == ">"]}
        at = struct.unpack_from(end + word, body, count * entry)[0]


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, a bit wider one code before they have to be."""
    out, table, last = bytearray(), [], None
    bits = held = 0
    width = 9
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out += word
        last = word
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def page(source: bytes | Read, tags: dict[int, list[int]]) -> np.ndarray:
    """Pixels of a page as float32; reads its strips and nothing else."""
    read = reader(source)
    width, height = tags[256][0], tags[257][0]
    bits, packing, differences = tags.get(258, [1])[0], tags.get(259, [1])[0], tags.get(317, [1])[0]
    if bits not in (8, 16) or tags.get(277, [1])[0] != 1 or tags.get(339, [1])[0] != 1 or differences not in (1, 2):
        raise ValueError("only 8- and 16-bit unsigned grey pages are read")
    strips = [read(a, n) for a, n in zip(tags[273], tags[279], strict=True)]
    if packing in (8, 32946):
        strips = [zlib.decompress(s) for s in strips]
    elif packing == 32773:
        strips = [unpack_bits(s) for s in strips]
    elif packing == 5:
        strips = [unpack_lzw(s) for s in strips]
    elif packing != 1:
        raise ValueError(f"TIFF compression {packing} isn't read")
    kind = np.dtype(f"{'>' if tags[-1][0] else '<'}u{bits // 8}")
    p = np.frombuffer(b"".join(strips), kind, width * height).reshape(height, width)
    if differences == 2:
        p = np.cumsum(p, axis=1, dtype=np.uint64).astype(f"u{bits // 8}")
    return p.astype(np.float32)


def write_tiff(video) -> bytes:
    """A little-endian TIFF with one strip a page, of an unsigned 8- or 16-bit array [frame, row, column]."""
    a = np.asarray(video)
    if a.ndim != 3 or a.dtype not in (np.uint8, np.uint16):
        raise ValueError("an array [frame, row, column] of uint8 or uint16 is needed")
    n, h, w = a.shape
    out, size = bytearray(b"II*\0" + struct.pack("<I", 8)), a.dtype.itemsize
    for k in range(n):
        at = len(out)
        pixels = at + 2 + 8 * 12 + 4
        following = pixels + (h * w * size + 1) // 2 * 2
        entries = [(256, 4, w), (257, 4, h), (258, 3, 8 * size), (259, 3, 1), (262, 3, 1), (273, 4, pixels), (278, 4, h), (279, 4, h * w * size)]
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", tag, kind, 1, value) for tag, kind, value in entries)
        out += struct.pack("<I", following if k + 1 < n else 0) + a[k].astype(f"<u{size}").tobytes()
        out += b"\0" * (following - len(out))
    return bytes(out)


#: The tags that pixels depend on.
PIXEL_TAGS = (256, 257, 258, 259, 273, 277, 279, 317, 339)


def pages(read: Read) -> Iterator[dict]:
    """frame and tags of each page."""
    for k, tags in enumerate(directories(read)):
        yield {"frame": k, "tags": [[t, tags[t]] for t in (*PIXEL_TAGS, -1) if t in tags]}


def listed_page(read: Read, one: dict) -> np.ndarray:
    return page(read, dict(one["tags"]))


def read_tiff(spark: SparkSession, path: str, glob: str = "*.tif*", frames: int = FRAMES, open_file: Callable[[str], Read] = opened) -> DataFrame:
    """video_id (path), frame, nrows, ncols, px of all files below path; a task reads ranges of `frames` pages."""
    return framed(spark, path, glob, pages, listed_page, ["frame"], frames, open_file)


def manifest(spark: SparkSession, path: str, experiment: str, glob: str = "*.tif") -> DataFrame:
    """path, experiment_type, replicate (place in the sorted folder), without reading the files' contents."""
    from pyspark.sql import Window

    files = listing(spark, path, glob).select("path")
    return files.select("path", F.lit(experiment).alias("experiment_type"), (F.row_number().over(Window.partitionBy(F.lit(experiment)).orderBy("path")) - 1).alias("replicate"))


def content_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path and SHA-1 of each file's content: the key under which calibrations are kept."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", F.sha1("content").alias("sha1"))
