"""Frames cut into tiles, for frames that are too large for one task.

A tile has its own pixels and a halo of others round them, as wide as what is computed reaches. Values in the halo's outer
part are wrong, as it ends where no frame does, but only a tile's own pixels are kept, whose surroundings are whole. So
the result doesn't depend on the tiles' size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import imaging
from ..params import TrackingParams
from .frames import images, locate_frame

#: Side of a tile in pixels.
TILE = 1024
#: Pixels of tiles that go on together.
AT_ONCE = 1 << 20
#: Where a tile's px lies in its frame, which part of it is its own, and how wide the frame is.
PLACE = ["top", "left", "own_top", "own_left", "own_rows", "own_cols", "width"]


def listed(parts: list[np.ndarray]) -> pa.Array:
    """Arrays of doubles as one column of lists."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), pa.float64()))


def tiled(frames: DataFrame, tile: int, halo: int, spread: bool = True) -> DataFrame:
    """frames with a row for each tile: px is the tile with its halo, PLACE says where it is.

    Halos end where the frame does. With spread, tiles are dealt over the tasks, else they stay where their frame is read.
    """
    kept = [c for c in frames.columns if c not in ("nrows", "ncols", "px", *PLACE)]
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tiles of a batch's frames, in rows of batches that hold AT_ONCE pixels and one tile at most."""
        for batch in batches:
            source, where, parts, held = [], [], [], 0

            def made() -> pa.RecordBatch:
                own = [batch.column(batch.schema.names.index(n)).take(pa.array(source, pa.int32())) for n in kept]
                return pa.RecordBatch.from_arrays([*own, *(pa.array(x, pa.int32()) for x in zip(*where, strict=True)), listed(parts)], [*kept, "nrows", "ncols", *PLACE, "px"])

            for k, (_, image) in enumerate(images(batch)):
                h, w = image.shape
                for top in range(0, h, tile):
                    for left in range(0, w, tile):
                        a, c = max(0, top - halo), max(0, left - halo)
                        part = image[a : top + tile + halo, c : left + tile + halo]
                        source.append(k)
                        where.append((*part.shape, a, c, top, left, min(tile, h - top), min(tile, w - left), w))
                        parts.append(part.ravel())
                        held += part.size
                        if held >= AT_ONCE:
                            yield made()
                            source, where, parts, held = [], [], [], 0
            if parts:
                yield made()

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"{c} int" for c in ("nrows", "ncols", *PLACE)), "px array<double>"])
    made = frames.select(*kept, "nrows", "ncols", "px").mapInArrow(cut, schema)
    return made.repartition("video_id", "frame", "own_top", "own_left") if spread else made


def map_tiles(frames: DataFrame, fn: Callable[[np.ndarray], np.ndarray], reach: int, tile: int = TILE, spread: bool = True) -> DataFrame:
    """video_id, frame, top, left, nrows, ncols, px: every tile's own part of fn(image), where a pixel depends on others up to `reach` away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            videos, numbers, parts = [], [], []
            for row, image in images(batch):
                a, c = row["own_top"] - row["top"], row["own_left"] - row["left"]
                part = fn(image)[a : a + row["own_rows"], c : c + row["own_cols"]]
                videos.append(row["video_id"])
                numbers.append((row["frame"], row["own_top"], row["own_left"], *part.shape))
                parts.append(part.ravel())
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(videos, pa.string()), *(pa.array(x, pa.int32()) for x in zip(*numbers, strict=True)), listed(parts)], ["video_id", "frame", "top", "left", "nrows", "ncols", "px"])

    return tiled(frames.select("video_id", "frame", "nrows", "ncols", "px"), tile, reach, spread).mapInArrow(run, "video_id string, frame int, top int, left int, nrows int, ncols int, px array<double>")


def tile_pixels(tiles: DataFrame) -> DataFrame:
    """video_id, frame, u, v, p of map_tiles(), in the frame's rows and columns."""
    found = tiles.select("video_id", "frame", "top", "left", "ncols", F.posexplode("px").alias("k", "p"))
    return found.select("video_id", "frame", (F.col("top") + F.floor(F.col("k") / F.col("ncols"))).cast("int").alias("u"), (F.col("left") + F.col("k") % F.col("ncols")).cast("int").alias("v"), "p")


def bandpassed_tiles(frames: DataFrame, noise_size: float, smoothing_size: int, threshold: float = 0.0, replicate: bool = False, tile: int = TILE, spread: bool = True) -> DataFrame:
    if noise_size >= smoothing_size:
        raise ValueError("noise_size has to be below smoothing_size")
    reach = max(smoothing_size // 2, int(4 * noise_size + 0.5) if replicate else 0)
    return map_tiles(frames, lambda p: imaging.bandpass(p, noise_size**2, smoothing_size, threshold, replicate), reach, tile, spread)


def picked_tiles(frames: DataFrame, pick: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]], columns: list[str], reach: int, tile: int = TILE, spread: bool = True) -> DataFrame:
    """video_id, frame, u, v, columns of the pixels that pick(image) names, each by the tile whose own it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_own(row, *pick(image), columns, ["u", "v"]) for row, image in images(batch)]
            if own:
                yield from pa.Table.from_batches(own).combine_chunks().to_batches()

    return tiled(frames.select("video_id", "frame", "nrows", "ncols", "px"), tile, reach, spread).mapInArrow(run, ", ".join(["video_id string, frame int, u int, v int", *(f"{c} double" for c in columns)]))


def _own(row: dict, u: np.ndarray, v: np.ndarray, found: dict[str, np.ndarray], columns: list[str], names: list[str]) -> pa.RecordBatch:
    """The tile's own ones of the pixels (u, v), in the frame's rows and columns."""
    u, v = np.asarray(u, np.int64) + row["top"], np.asarray(v, np.int64) + row["left"]
    own = (u >= row["own_top"]) & (u < row["own_top"] + row["own_rows"]) & (v >= row["own_left"]) & (v < row["own_left"] + row["own_cols"])
    place = [pa.array(u[own].astype(np.int32)), pa.array(v[own].astype(np.int32))] if len(names) == 2 else [pa.array(u[own] * row["width"] + v[own])]
    n = int(own.sum())
    values = (pa.array(np.asarray(found[c], float)[own], pa.float64(), from_pandas=True) for c in columns)
    return pa.RecordBatch.from_arrays([pa.array([row["video_id"]] * n, pa.string()), pa.array([row["frame"]] * n, pa.int32()), *place, *values], ["video_id", "frame", *names, *columns])


def locating_reach(params: TrackingParams) -> int:
    """How far away pixels can matter for a detection: those under the band pass, disc and window of any candidate that may come near it."""
    walked = params.max_iterations + 2
    before = params.smoothing_size // 2 + params.radius + imaging.window_size(params.separation) + 1
    near = 2 * walked + params.separation if params.filter_close else walked
    return before + near + math.ceil(max(params.sig_radius or 0, params.bg_radius or 0)) + params.radius


def locate_tiles(frames: DataFrame, params: TrackingParams, tile: int = TILE, spread: bool = True) -> DataFrame:
    """locate(), tile by tile: the same detections, to the last digit of y and x; seq is the raster place of a detection's candidate in its frame, as a long.

    What depends on a whole frame isn't known in a tile: invert, percentile, topn and margin raise. brightest() and within_margin() have the
    latter two for detections, and a frame can be inverted before.
    """
    if params.invert or params.percentile is not None or params.topn is not None or params.margin:
        raise ValueError("invert, percentile, topn and margin depend on whole frames")
    own_minmass = ["minmass"] if "minmass" in frames.columns else []
    names = [n for n, _ in params.columns() if n not in ("frame", "particle")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, image in images(batch):
                found = locate_frame(image, params, row.get("minmass"))
                found["y"], found["x"] = found["y"] + row["top"], found["x"] + row["left"]
                yield _own(row, found["u"], found["v"], found, names, ["seq"])

    cut = tiled(frames.select("video_id", "frame", "nrows", "ncols", "px", *own_minmass), tile, locating_reach(params), spread)
    return cut.mapInArrow(run, ", ".join(["video_id string, frame int, seq long", *(f"{n} double" for n in names)]))
