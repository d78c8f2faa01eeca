"""Whole analyses: locating and linking of videos, tracks with photometry and motion, trace extraction."""

from __future__ import annotations

import dataclasses
from itertools import product

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calibration import random_pixel_calibration, refined
from ..operators import frames as fr
from ..operators import motion, photometry
from ..operators.detections import relabelled, unique_ids
from ..operators.link import link
from ..params import LabParams, TrackingParams
from ..sources.ets import read_ets
from ..sources.tables import read_frames, write_results, write_traces
from ..sources.tiff import content_hashes, manifest, read_tiff
from ..storage import stored

#: Videos whose mass limits are broadcast; beyond it they are joined.
SENT_VIDEOS = 500_000


def batch(frames: DataFrame, diameter: int, **params) -> DataFrame:
    """Detections of a frames table, linked if search_range is given; columns as TrackingParams has them.

    With several videos video_id comes first; rows of a frame keep their raster order in seq, which is dropped.
    """
    p = TrackingParams(diameter, **params)
    found = fr.locate(frames, p)
    if p.search_range is not None:
        found = link(found, p.search_range, p.memory)
    return found.select("video_id", *(F.col(n).cast(t).alias(n) for n, t in p.columns()))


def batch_array(spark: SparkSession, video, diameter: int, **params) -> DataFrame:
    return batch(fr.frames_from_array(spark, video), diameter, **params).drop("video_id")


def batch_file(spark: SparkSession, path: str, diameter: int, channel: int = 0, **params) -> DataFrame:
    return batch(read_frames(spark, path, channel), diameter, **params).drop("video_id")


def parse_ets(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all channels; missing frames are dropped."""
    return read_ets(spark, path, glob="*")


def first_frame_mean(frames: DataFrame) -> float:
    """Mean pixel of the first frame: one aggregate over a filtered scan."""
    first = frames.agg(F.min("frame")).first()[0]
    row = frames.where(F.col("frame") == first).select(F.explode("px").alias("p")).agg(F.avg("p")).first()
    return float(row[0] or 0.0)


def first_frame_means(frames: DataFrame) -> DataFrame:
    """video_id and mean: the mean pixel of each video's first frame."""
    first = frames.groupBy("video_id").agg(F.min("frame").alias("frame"))
    return frames.join(first, ["video_id", "frame"], "left_semi").select("video_id", F.explode("px").alias("p")).groupBy("video_id").agg(F.avg("p").alias("mean"))


def with_minmass(frames: DataFrame, multiplier: float) -> DataFrame:
    """frames with minmass: the multiplier times the mean of the first frame of their own video."""
    means = stored(first_frame_means(frames).select("video_id", (F.coalesce("mean", F.lit(0.0)) * multiplier).alias("minmass")), "minmass")
    small = means.count() <= SENT_VIDEOS
    return frames.join(F.broadcast(means) if small else means, "video_id")


def detections_of(frames: DataFrame, params: LabParams) -> DataFrame:
    smooth = with_minmass(fr.blurred(frames, 0.5), params.mean_multiplier)
    return fr.locate(smooth, TrackingParams(params.object_size, separation=params.sep))


def tracker(frames: DataFrame, params: LabParams, colour: str = "red") -> tuple[DataFrame, DataFrame]:
    """Tracks with photometry, steps and duration, and the mean squared displacements (time, particle, msd).

    Steps are in units of pixel_size. Lags are frames times tracking_time; with reference_units positions are
    scaled twice and lags divided by it, as they were in earlier records.
    """
    found = photometry.lab_roi(frames, detections_of(frames, params), params.lip_int_size, params.lip_BG_size, params.gap_size, colour)
    by = ["video_id", "particle"]
    tracks = motion.filter_stubs(link(found, params.search_range, params.memory), params.duration_filter, by)
    moved = motion.durations(motion.steps(tracks, params.pixel_size, by), by)
    longest = motion.longest_duration(moved, by)
    mpp, fps = (params.pixel_size, params.tracking_time) if params.reference_units else (1.0, 1.0 / params.tracking_time)
    if not longest:
        return moved, moved.select(*by, F.lit(0.0).alias("time"), F.lit(0.0).alias("msd")).limit(0)
    return moved, motion.msd(moved, longest, mpp, fps, by).select(*by, "time", "msd")


def run_experiments(spark: SparkSession, params: LabParams, run_id: str = "run", colour: str = "red") -> tuple[DataFrame, DataFrame]:
    """tracker() over all TIFF videos of all experiments at once, written by type and replicate if save_path is set.

    Each video has its own mass limit, from its own first frame.
    """
    if not params.exp_types or len(params.exp_types) != len(params.exp_type_folders):
        raise ValueError("exp_types and exp_type_folders have to be of one length, 1 at least")
    listed = None
    for name, folder in zip(params.exp_types, params.exp_type_folders, strict=True):
        one = manifest(spark, folder, name)
        listed = one if listed is None else listed.union(one)
    frames = None
    for folder in params.exp_type_folders:
        one = read_tiff(spark, folder, "*.tif")
        frames = one if frames is None else frames.union(one)
    tracks, msds = tracker(frames, params, colour)
    named = listed.withColumnRenamed("path", "video_id")
    label = lambda df: unique_ids(df.join(named, "video_id"), run_id).withColumn("particle", F.concat_ws("_", "particle", "experiment_type", "replicate"))
    tracks, msds = label(tracks), label(msds)
    if params.save_path:
        write_results(tracks, f"{params.save_path}/tracked")
        write_results(msds, f"{params.save_path}/msd")
    return tracks, msds


def sweep(frames: DataFrame, mean_multipliers: list[float], seps: list[int], object_sizes: list[int]) -> DataFrame:
    """Detections in the first frame under every combination of parameters: mean_multiplier, sep, object_size, n."""
    first = frames.agg(F.min("frame")).first()[0]
    one = fr.blurred(frames.where(F.col("frame") == first), 0.5)
    mean = first_frame_mean(one)
    out = None
    for m, s, d in product(mean_multipliers, seps, object_sizes):
        n = fr.locate(one, TrackingParams(d, minmass=mean * m, separation=s)).agg(F.count("*").alias("n"))
        row = n.select(F.lit(m).alias("mean_multiplier"), F.lit(s).alias("sep"), F.lit(d).alias("object_size"), "n")
        out = row if out is None else out.union(row)
    return out


@dataclasses.dataclass(frozen=True)
class TraceParams:
    """Squared radii of the photometry, then locating and linking of static and dynamic videos."""

    lip_int_size: float = 8
    lip_BG_size: float = 70
    gap_size: float = 2
    static_diameter: int = 11
    static_sep: int = 8
    static_mean_multiplier: float = 1.0
    dynamic_diameter: int = 11
    dynamic_sep: int = 7
    dynamic_mean_multiplier: float = 1.0
    dynamic_search_range: float = 4
    dynamic_memory: int = 0
    static_fit: bool = False


def kept_calibration(spark: SparkSession, path: str, cache: str) -> tuple[float, float]:
    """Gain and offset of a video without particles; fitted once for each content and kept in a table at cache."""
    sha1 = content_hashes(spark, path).first()["sha1"]
    try:
        known = spark.read.parquet(cache).where(F.col("sha1") == sha1).select("gain", "offset").first()
    except AnalysisException:  # no table yet
        known = None
    if known is None:
        known = random_pixel_calibration(read_frames(spark, path))
        spark.createDataFrame([(sha1, *known)], "sha1 string, gain double, offset double").coalesce(1).write.mode("append").parquet(cache)
    return float(known[0]), float(known[1])


def extract_pairs(spark: SparkSession, static: list[str], dynamic: list[str], save: str, no_particle: str | None = None, params: TraceParams | None = None) -> list[str]:
    """extract_traces for each static video and the dynamic one at its place, written under the pair's number; the paths."""
    paths = []
    for video, (still, moving) in enumerate(zip(static, dynamic, strict=True)):
        empty = read_frames(spark, no_particle) if no_particle else None
        paths += write_traces(extract_traces(read_frames(spark, still), read_frames(spark, moving), empty, params, str(video)), save, video)
    return paths


def extract_traces(static: DataFrame, dynamic: DataFrame, no_particle: DataFrame | None = None, params: TraceParams | None = None, run_id: str = "run") -> dict[str, DataFrame]:
    """static particles, their traces in the dynamic video, and dynamic tracks; both videos may hold one video_id.

    The camera's gain and offset come from a video without particles, if there is one. Illumination is
    corrected by the dynamic video's own mean. With params.static_fit, static positions are those of Gaussians
    fitted to the mean image.
    """
    p = params or TraceParams()
    gain, offset = random_pixel_calibration(no_particle) if no_particle is not None else (1.0, 0.0)
    still = fr.mean_frames(static).groupBy().agg(F.array_sort(F.collect_list(F.struct("u", "v", "p"))).alias("m"), (F.max("u") + 1).alias("nrows"), (F.max("v") + 1).alias("ncols"))
    mean_image = still.select(F.lit("static").alias("video_id"), F.lit(0).alias("frame"), "nrows", "ncols", F.transform("m", lambda x: x["p"]).alias("px"))
    located = fr.locate(mean_image, TrackingParams(p.static_diameter, minmass=first_frame_mean(mean_image) * p.static_mean_multiplier, separation=p.static_sep))
    if p.static_fit:
        located = refined(mean_image, located, p.static_diameter // 2)
    positions = located.withColumn("particle", F.col("seq").cast("bigint"))
    corrected = fr.illumination_corrected(dynamic, 30.0, gain, offset)
    traces = photometry.constant_positions(corrected, positions, p.lip_int_size, p.lip_BG_size, p.gap_size, means=True)
    moving = fr.locate(corrected, TrackingParams(p.dynamic_diameter, minmass=first_frame_mean(corrected) * p.dynamic_mean_multiplier, separation=p.dynamic_sep))
    measured = photometry.lab_roi(corrected, moving, p.lip_int_size, p.lip_BG_size, p.gap_size, means=True)
    tracks = link(measured, p.dynamic_search_range, p.dynamic_memory)
    return {"static": positions, "traces": unique_ids(traces, run_id), "tracks": unique_ids(tracks, run_id)}


def canonical(tracks: DataFrame, order: str = "seq") -> DataFrame:
    """Ids by first appearance, for comparing the results of two linkers."""
    return relabelled(tracks, "particle", order)


def as_array(detections: DataFrame) -> np.ndarray:
    """Collected rows of a small result, as floats."""
    return detections.toPandas().to_numpy(float)
