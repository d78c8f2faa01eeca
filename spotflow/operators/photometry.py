"""Photometry: raw signal and local background round detections or constant positions."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import imaging
from ..storage import stored

LAB = ["int", "bg", "sig_pixel_size", "int_mean", "bg_mean"]


def prefix(colour: str) -> str:
    return f"{colour.lower()}_"


def _measure(frames: DataFrame, detections: DataFrame, by: list[str], measure, columns: dict[str, str]) -> DataFrame:
    """Detections beside their frame, measured frame by frame: one shuffle of detections and frames on their key.

    Each frame carries its detections as an array, so a frame's pixels cross the wire once.
    """
    own = [c for c in detections.columns if c not in by]
    packed = detections.groupBy(*by).agg(F.collect_list(F.struct(*own)).alias("_points"))
    joined = frames.select(*by, "nrows", "ncols", "px").join(packed, by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..operators.frames import images

        for batch in batches:
            out: dict[str, list] = {c: [] for c in (*by, *own, *columns)}
            for row, image in images(batch):
                points = row["_points"]
                found = measure(image, np.array([p["y"] for p in points], float), np.array([p["x"] for p in points], float))
                for c in by:
                    out[c] += [row[c]] * len(points)
                for c in own:
                    out[c] += [p[c] for p in points]
                for c in columns:
                    out[c] += found[c]
            yield pa.RecordBatch.from_pydict(out, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    schema = StructType([*(detections.schema[c] for c in (*by, *own)), *(StructField(c, _kind(k), True) for c, k in columns.items())])
    target = to_arrow_schema(StructType([StructField(f.name, f.dataType, True) for f in schema]))
    return joined.mapInArrow(run, StructType([StructField(f.name, f.dataType, True) for f in schema]))


def _kind(name: str):
    from pyspark.sql import types as T

    return {"double": T.DoubleType(), "long": T.LongType()}[name]


def _numbers(values) -> list:
    return [None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in (x.item() if hasattr(x, "item") else x for x in values)]


def native_roi(frames: DataFrame, detections: DataFrame, sig_radius: float, bg_radius: float | None = None, gap_radius: float = 0.0, by: tuple[str, ...] = ("video_id", "frame")) -> DataFrame:
    """detections with raw_mass, and raw_bg_median and raw_mass_corrected if bg_radius is given."""
    columns = {"raw_mass": "double"} | ({"raw_bg_median": "double", "raw_mass_corrected": "double"} if bg_radius is not None else {})

    def measure(image, y, x):
        found = imaging.native_roi(image, y, x, sig_radius, bg_radius, gap_radius)
        return {c: _numbers(v) for c, v in zip(columns, found, strict=False)}

    return _measure(frames, detections, list(by), measure, columns)


def lab_roi(frames: DataFrame, detections: DataFrame, int_r2: float, bg_r2: float, gap_r2: float = 0.0, colour: str = "red", means: bool = False, by: tuple[str, ...] = ("video_id", "frame")) -> DataFrame:
    """detections with <colour>_int, _bg, _sig_pixel_size, with means also _int_mean and _bg_mean, and _int_corrected.

    Radii are squared; where detections have a column background, _int_gausscorrected uses it.
    """
    at = prefix(colour)
    columns = {at + c: "long" if c == "sig_pixel_size" else "double" for c in LAB if means or not c.endswith("mean")}

    def measure(image, y, x):
        found = imaging.lab_rois(image, y, x, int_r2, bg_r2, gap_r2)
        return {c: _numbers(found[c.removeprefix(at)]) for c in columns}

    return corrected(_measure(frames, detections, list(by), measure, columns), colour)


def corrected(measured: DataFrame, colour: str = "red", nominal: int | None = None) -> DataFrame:
    """Signal less background times area: that in the frame, or the nominal number of pixels."""
    at = prefix(colour)
    area = F.lit(nominal) if nominal is not None else F.col(at + "sig_pixel_size")
    out = measured.withColumn(at + "int_corrected", F.col(at + "int") - F.col(at + "bg") * area)
    return out.withColumn(at + "int_gausscorrected", F.col(at + "int") - F.col("background") * area) if "background" in measured.columns else out


def constant_positions(frames: DataFrame, positions: DataFrame, int_r2: float, bg_r2: float, gap_r2: float = 0.0, colour: str = "red", means: bool = False, most: int = 100_000) -> DataFrame:
    """Traces of fixed positions (particle, y, x) in every frame, without a shuffle of frames.

    Positions are broadcast, at most `most` different ones; more are dealt into groups, each with its own pass over the frames. Repeated
    ones are measured once, and have a row each.
    """
    found = stored(positions.groupBy("particle", "y", "x").agg(F.count("*").alias("copies")), "positions")
    groups = -(-found.count() // most) * 2  # a pass over the frames for each, whose positions are broadcast
    if groups <= 2:
        return _fixed(frames, found, int_r2, bg_r2, gap_r2, colour, means)
    parts = [found.where(F.pmod(F.xxhash64("particle", "y", "x"), F.lit(groups)) == g) for g in range(groups)]
    return functools.reduce(DataFrame.union, (_fixed(frames, part, int_r2, bg_r2, gap_r2, colour, means) for part in parts))


def _fixed(frames: DataFrame, found: DataFrame, int_r2: float, bg_r2: float, gap_r2: float, colour: str, means: bool) -> DataFrame:
    at = prefix(colour)
    names = [c for c in LAB if means or not c.endswith("mean")]
    rows = found.collect()  # about half of `most`, at most `most` where they are all
    particles = np.array([r.particle for r in rows], np.int64)
    ys, xs = (np.array([r[c] for r in rows], float) for c in ("y", "x"))
    again = np.repeat(np.arange(len(rows)), [r.copies for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..operators.frames import images

        for batch in batches:
            for row, image in images(batch):
                measured = imaging.lab_rois(image, ys, xs, int_r2, bg_r2, gap_r2)
                fixed = [pa.array([row["video_id"]] * len(again), pa.string()), pa.array([row["frame"]] * len(again), pa.int32()), pa.array(particles[again]), pa.array(ys[again]), pa.array(xs[again])]
                yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(np.asarray(measured[c])[again], from_pandas=True) for c in names)], ["video_id", "frame", "particle", "y", "x", *(at + c for c in names)])

    schema = "video_id string, frame int, particle long, y double, x double, " + ", ".join(f"{at}{c} {'long' if c == 'sig_pixel_size' else 'double'}" for c in names)
    return corrected(frames.select("video_id", "frame", "nrows", "ncols", "px").mapInArrow(run, schema), colour)
