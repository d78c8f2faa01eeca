"""Files of frames read range by range: a task reads the bytes of its own frames and no others."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

Read = Callable[[int, int], bytes]
#: Frames in one range.
FRAMES = 32


def reader(source: bytes | Read) -> Read:
    """read(at, n) of bytes at hand; a function stays as it is."""
    return source if callable(source) else lambda at, n: bytes(source[at : at + n])


def opened(uri: str) -> Read:
    """read(at, n) of a file that workers can open themselves: a local or mounted one, or one of a store that Arrow knows (s3, gs, hdfs and others).

    Raises OSError where it can't be opened.
    """
    if uri.startswith("file:") or ":" not in uri:
        return _read_at(fs.LocalFileSystem().open_input_file("/" + uri.removeprefix("file:").lstrip("/")))
    try:
        store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
        return _read_at(store.open_input_file(path))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, ImportError) as why:
        raise OSError(f"{uri} isn't of a store that workers can open") from why


def _read_at(file) -> Read:
    return lambda at, n: file.read_at(n, at)


def listing(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def framed(spark: SparkSession, path: str, glob: str, listed: Callable[[Read], Iterator[dict]], pixels: Callable[[Read, dict], np.ndarray], labels: list[str], frames: int = FRAMES, open_file: Callable[[str], Read] = opened) -> DataFrame:
    """video_id (path), labels, nrows, ncols, px of all files below path.

    listed() gives what is known of each frame before its pixels are read: the labels, and what pixels() needs.
    A file that open_file() opens, wherever it is, is read in ranges of `frames` frames, dealt over all cores; one for which it raises OSError,
    as only Spark's readers can open it, comes whole, a file to a task. That is decided file by file.
    """
    files = listing(spark, path, glob)
    names = ["video_id", *labels, "nrows", "ncols", "px"]
    schema = ", ".join(["video_id string", *(f"{n} int" for n in labels), "nrows int, ncols int, px array<float>"])

    def rows(name: str, read: Read, found: list[dict]) -> Iterator[pa.RecordBatch]:
        for one in found:
            p = pixels(read, one)
            yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([one[n]], pa.int32()) for n in labels), pa.array([p.shape[0]], pa.int32()), pa.array([p.shape[1]], pa.int32()), pa.array([p.ravel()], pa.list_(pa.float32()))], names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                read = reader(data)
                yield from rows(name, read, list(listed(read)))

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    read = open_file(name)
                except OSError:
                    parts = [None]
                else:
                    found = list(listed(read))
                    parts = [json.dumps(found[i : i + frames]) for i in range(0, len(found), frames)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], ["video_id", "part", "found"])

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, found in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                yield from rows(name, open_file(name), json.loads(found))

    plan = stored(files.select("path").mapInArrow(planned, "video_id string, part int, found string"), "ranges")
    closed = plan.where("found IS NULL").select(F.col("video_id").alias("path"))
    parts = plan.where("found IS NOT NULL")
    tasks = max(1, min(parts.count(), 8 * spark.sparkContext.defaultParallelism))
    made = parts.repartition(tasks, "video_id", "part").mapInArrow(ranged, schema)
    if not closed.limit(1).count():
        return made
    return made.unionByName(files.join(closed, "path", "left_semi").select("path", "content").mapInArrow(whole, schema))
