"""Frames as a stream from TIFF files that grow while they are recorded.

An offset is the number of complete pages of each file; a batch is the pages between two offsets, in ranges that tasks
read by themselves. Pages are complete once all bytes that their directory names are there.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.ranges import FRAMES, Read, opened
from ..sources.tiff import PIXEL_TAGS, directories, listed_page

SCHEMA = "video_id string, frame int, nrows int, ncols int, px array<float>"


def listed_files(path: str, suffixes: tuple[str, ...] = (".tif", ".tiff")) -> dict[str, int]:
    """Names and sizes of the files below path."""
    name = path.removeprefix("file:")
    store, root = (fs.LocalFileSystem(), "/" + name.lstrip("/")) if path.startswith("file:") or ":" not in path else fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    lead = path[: len(path) - len(root)] if path.endswith(root) else ""
    return {lead + f.path: f.size for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffixes)}


def complete_pages(read: Read, size: int) -> Iterator[dict]:
    """frame and tags of each page whose directory and pixels are there; the first that isn't ends the file for now."""
    try:
        for k, tags in enumerate(directories(read)):
            ends = [a + n for a, n in zip(tags.get(273, []), tags.get(279, []), strict=True)]
            if not ends or 256 not in tags or 257 not in tags or max(ends) > size:
                return
            yield {"frame": k, "tags": [[t, tags[t]] for t in (*PIXEL_TAGS, -1) if t in tags]}
    except (struct.error, ValueError):  # a directory that is being written
        return


class Pages(InputPartition):
    def __init__(self, name: str, found: list[dict]):
        self.name, self.found = name, found


class FrameReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.frames = options["path"], int(options.get("frames", FRAMES))
        self.known: dict[str, tuple[int, list[dict]]] = {}

    def pages(self, name: str, size: int) -> list[dict]:
        """Pages of a file, looked up anew only where it has grown."""
        held = self.known.get(name)
        if held is None or held[0] != size:
            self.known[name] = held = (size, list(complete_pages(opened(name), size)))
        return held[1]

    def initialOffset(self) -> dict:
        return {"pages": "{}"}

    def latestOffset(self) -> dict:
        counts = {name: len(self.pages(name, size)) for name, size in sorted(listed_files(self.path).items())}
        return {"pages": json.dumps(counts)}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        before, upto, sizes = json.loads(start["pages"]), json.loads(end["pages"]), listed_files(self.path)
        out = []
        for name, n in sorted(upto.items()):
            fresh = self.pages(name, sizes[name])[before.get(name, 0) : n]
            out += [Pages(name, fresh[i : i + self.frames]) for i in range(0, len(fresh), self.frames)]
        return out

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        read = opened(partition.name)
        for one in partition.found:
            p = listed_page(read, one)
            numbers = [one["frame"], *p.shape]
            yield pa.RecordBatch.from_arrays([pa.array([partition.name]), *(pa.array([x], pa.int32()) for x in numbers), pa.array([p.ravel()], pa.list_(pa.float32()))], ["video_id", "frame", "nrows", "ncols", "px"])

    def commit(self, end: dict) -> None:
        pass


class GrowingTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_tiff"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FrameReader:
        return FrameReader(dict(self.options))


def frame_stream(spark: SparkSession, path: str, frames: int = FRAMES) -> DataFrame:
    """video_id (file), frame, nrows, ncols, px of the TIFF files below path, as a stream: pages come once, as soon as they are complete.

    The folder has to be one that the driver and all tasks can open. Frames of a file come in order, batch by batch.
    """
    spark.dataSource.register(GrowingTiff)
    return spark.readStream.format("growing_tiff").option("path", path).option("frames", str(frames)).load()
