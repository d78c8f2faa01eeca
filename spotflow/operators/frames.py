"""Frames as rows (video_id, frame, nrows, ncols, px) and operators that work on one frame at a time.

Each is a narrow Arrow map: a frame never leaves its task, so nothing is shuffled before linking.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import imaging
from ..params import TrackingParams


def frames_from_array(spark: SparkSession, video, video_id: str = "video") -> DataFrame:
    """A frames table from an array [frame, row, column]."""
    a = np.asarray(video)
    if a.ndim != 3:
        raise ValueError("a video has the axes frame, row, column")
    n, h, w = a.shape
    table = pa.table({"video_id": [video_id] * n, "frame": pa.array(range(n), pa.int32()), "nrows": pa.array([h] * n, pa.int32()), "ncols": pa.array([w] * n, pa.int32()), "px": pa.array([f.ravel().astype(np.float32) for f in a], pa.list_(pa.float32()))})
    return spark.createDataFrame(table)


def images(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray]]:
    """The other columns and the image of each row, in double precision."""
    names = batch.schema.names
    px = batch.column(names.index("px"))
    rows = batch.drop_columns(["px"]).to_pylist()
    values, ends = px.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum([0, *(len(x) for x in px)])
    for row, a, b in zip(rows, ends[:-1], ends[1:], strict=True):
        yield row, values[a:b].reshape(row["nrows"], row["ncols"])


def map_images(frames: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """frames with every image replaced by fn(image), as doubles."""
    names = frames.columns
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema} | {"px": "array<double>", "nrows": "int", "ncols": "int"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fn(image) for _, image in images(batch)]
            columns = dict(zip(names, batch.columns, strict=True))
            columns["px"] = pa.array([m.ravel() for m in made], pa.list_(pa.float64()))
            columns["nrows"], columns["ncols"] = (pa.array([m.shape[k] for m in made], pa.int32()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return frames.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names))


def map_chunks(frames: DataFrame, fn: Callable[[np.ndarray], np.ndarray], size: int = 16) -> DataFrame:
    """video_id, frame, nrows, ncols, px after fn, which takes `size` successive frames of a video as an array [frame, row, column].

    For steps that look at several frames, as a mean over time does. Chunks begin at multiples of size; frames that aren't there are left
    out, so a chunk may be shorter. fn gives as many frames as it gets. A task holds a chunk at a time, and the frames of a chunk
    are brought together by one shuffle.
    """

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(((row["frame"], image) for batch in batches for row, image in images(batch)), key=lambda f: f[0])
        made = np.asarray(fn(np.stack([image for _, image in found])), float)
        if made.ndim != 3 or len(made) != len(found):
            raise ValueError("a chunk's function has to give as many frames as it gets")
        n, h, w = made.shape
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * n, pa.string()), pa.array([f for f, _ in found], pa.int32()), pa.array([h] * n, pa.int32()), pa.array([w] * n, pa.int32()), pa.array([m.ravel() for m in made], pa.list_(pa.float64()))], ["video_id", "frame", "nrows", "ncols", "px"])

    chunk = F.floor(F.col("frame") / size).alias("chunk")
    return frames.select("video_id", "frame", "nrows", "ncols", "px").groupBy("video_id", chunk).applyInArrow(run, "video_id string, frame int, nrows int, ncols int, px array<double>")


def bandpassed(frames: DataFrame, noise_size: float, smoothing_size: int, threshold: float = 0.0, replicate: bool = False) -> DataFrame:
    if noise_size >= smoothing_size:
        raise ValueError("noise_size has to be below smoothing_size")
    return map_images(frames, lambda p: imaging.bandpass(p, noise_size**2, smoothing_size, threshold, replicate))


def blurred(frames: DataFrame, sigma: float = 0.5) -> DataFrame:
    return map_images(frames, lambda p: imaging.blur(p, sigma))


def cropped(frames: DataFrame, rows: int, cols: int) -> DataFrame:
    return map_images(frames, lambda p: p[:rows, :cols])


def gain_corrected(frames: DataFrame, gain: float, offset: float) -> DataFrame:
    """(p - offset) / gain, in the JVM."""
    return frames.withColumn("px", F.transform("px", lambda p: (p.cast("double") - offset) / gain))


def to_bytes(frames: DataFrame) -> DataFrame:
    """Whole numbers from 0 to 255, 255 at the brightest pixel of each frame; in the JVM."""
    top = F.array_max(F.transform("px", lambda p: p.cast("double")))
    return frames.withColumn("px", F.transform("px", lambda p: F.when(top > 0, F.round(F.greatest(p.cast("double"), F.lit(0.0)) * 255 / top)).otherwise(0.0)))


def inverted(frames: DataFrame) -> DataFrame:
    return frames.withColumn("px", F.transform("px", lambda p: F.array_max("px") - p))


def to_grey(frames: DataFrame, channels: list[str], out: str = "px") -> DataFrame:
    """Root of the summed squares of channel columns, scaled to 255 at the brightest pixel of the frame."""
    total = F.transform(channels[0], lambda p: p.cast("double") * p)
    for c in channels[1:]:
        total = F.zip_with(total, F.col(c), lambda a, b: a + b.cast("double") * b)
    root = F.transform(total, F.sqrt)
    return frames.withColumn(out, root).withColumn(out, F.transform(out, lambda p: p * F.lit(255.0) / F.array_max(out))).drop(*[c for c in channels if c != out])


def pixels(frames: DataFrame) -> DataFrame:
    """One row for each pixel: every other column, u, v, p."""
    kept = [c for c in frames.columns if c not in ("px", "nrows", "ncols")]
    each = frames.select(*kept, "ncols", F.posexplode("px").alias("_at", "p"))
    return each.select(*kept, F.expr("cast(_at div ncols as int)").alias("u"), F.expr("cast(_at % ncols as int)").alias("v"), F.col("p").cast("double").alias("p"))


def mean_frames(frames: DataFrame, *by: str) -> DataFrame:
    """Mean of each pixel over time: partial sums within tasks, then one row for each pixel."""
    return pixels(frames).groupBy(*by, "u", "v").agg(F.avg("p").alias("p"))


def illumination(frames: DataFrame, sigma: float = 30.0) -> np.ndarray:
    """The blurred temporal mean, 1 at its brightest; one frame's pixels reach the driver. sigma 0 doesn't blur."""
    rows = mean_frames(frames).collect()
    h, w = max(r.u for r in rows) + 1, max(r.v for r in rows) + 1
    mean = np.zeros((h, w))
    for r in rows:
        mean[r.u, r.v] = r.p
    profile = imaging.blur(mean, sigma) if sigma else mean
    return profile / profile.max()


def illumination_corrected(frames: DataFrame, sigma: float = 30.0, gain: float = 1.0, offset: float = 0.0) -> DataFrame:
    """Gain correction and division by the profile in one pass over the frames."""
    profile = illumination(gain_corrected(frames, gain, offset), sigma) * gain
    return map_images(frames, lambda p: (p - offset) / profile)


def mean_images(frames: DataFrame) -> DataFrame:
    """video_id, frame (0), nrows, ncols, px: the temporal mean of each video, as a frame of its own."""
    means = mean_frames(frames, "video_id").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("u", "v", "p"))).alias("m"), (F.max("u") + 1).cast("int").alias("nrows"), (F.max("v") + 1).cast("int").alias("ncols"))
    return means.select("video_id", F.lit(0).alias("frame"), "nrows", "ncols", F.transform("m", lambda x: x["p"]).alias("px"))


def illumination_corrected_by_video(frames: DataFrame, sigma: float = 30.0, gain: float = 1.0, offset: float = 0.0) -> DataFrame:
    """illumination_corrected() for many videos at once, each by the blurred temporal mean of its own frames.

    Profiles stay a table, a row a video, joined to the frames and divided by in the JVM; nothing reaches the driver. Frames of
    a video have one shape.
    """

    def profile(mean: np.ndarray) -> np.ndarray:
        made = imaging.blur(mean, sigma) if sigma else mean
        return made / made.max()

    profiles = map_images(mean_images(gain_corrected(frames, gain, offset)), profile).select("video_id", F.col("px").alias("_profile"))
    joined = frames.join(profiles, "video_id")
    return joined.withColumn("px", F.zip_with("px", "_profile", lambda p, q: (p.cast("double") - offset) / (q * gain))).select(*frames.columns)


def foam_mask(frames: DataFrame, block: int = 91, dilations: int = 5) -> DataFrame:
    """1 where a pixel exceeds the Gaussian mean of its block, grown by cross-shaped dilations."""
    sigma = (block - 1) / 6.0

    def mask(p: np.ndarray) -> np.ndarray:
        on = p > imaging.blur(p, sigma)
        for _ in range(dilations):
            on = on | np.logical_or.reduce([imaging.shifted(on, i, j, False) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))])
        return on.astype(float)

    return map_images(frames, mask)


def background_pixels(frames: DataFrame, cutoff: float = 0.985) -> DataFrame:
    """1 where a moment-fitted gamma density, times a bin width of the values' range, leaves less than cutoff."""
    from math import lgamma

    def mask(p: np.ndarray) -> np.ndarray:
        mean, sd = p.mean(), p.std()
        if not sd or mean <= 0:
            return np.zeros(p.shape)
        shape, scale = (mean / sd) ** 2, sd**2 / mean
        width = (np.percentile(p, 99.9) - np.percentile(p, 0.1)) / 200
        with np.errstate(divide="ignore", invalid="ignore"):
            density = np.where(p > 0, np.exp((shape - 1) * np.log(p) - p / scale - lgamma(shape) - shape * np.log(scale)), 0.0)
        return (1 - width * density < cutoff).astype(float)

    return map_images(frames, mask)


def locate_frame(image: np.ndarray, params: TrackingParams, minmass: float | None = None) -> dict[str, np.ndarray]:
    """Detections of one frame in raster order of their candidates (u, v); minmass stands in for that of params."""
    raw = image.max() - image if params.invert else image
    p = imaging.bandpass(raw, params.variance, params.smoothing_size, params.threshold) if params.preprocess else np.where(raw >= params.threshold, raw, 0.0)
    planes = imaging.centres(p, params.diameter)
    top = imaging.maxima(p, params.separation)
    if params.percentile is not None:
        top &= p > np.percentile(p, params.percentile)
    if params.margin:
        inner = np.zeros(top.shape, bool)
        inner[params.margin : top.shape[0] - params.margin, params.margin : top.shape[1] - params.margin] = True
        top &= inner
    u, v = np.nonzero(top & (planes[0] > 0))
    y, x, mass = imaging.walk(u, v, planes, params.max_iterations, params.shift_threshold)
    kept = mass > (params.minmass if minmass is None else minmass)
    u, v, y, x, mass = (a[kept] for a in (u, v, y, x, mass))
    if params.maxsize is not None:
        kept = imaging.character(p, u, v, mass, params.diameter)[0] < params.maxsize
        u, v, y, x, mass = (a[kept] for a in (u, v, y, x, mass))
    if params.filter_close and len(u):
        kept = ~imaging.close_losers(y, x, mass, params.separation)
        u, v, y, x, mass = (a[kept] for a in (u, v, y, x, mass))
    if params.topn is not None:
        kept = np.sort(np.lexsort((x, y, -mass))[: params.topn])
        u, v, y, x, mass = (a[kept] for a in (u, v, y, x, mass))
    out = {"u": u, "v": v, "mass": mass, "y": y, "x": x}
    if params.cpu_processed:
        out["Rg"], out["ecc"], out["signal"] = imaging.character(p, u, v, mass, params.diameter)
    if params.sig_radius is not None:
        total, median, corrected = imaging.native_roi(image, y, x, params.sig_radius, params.bg_radius, params.gap_radius or 0.0)
        out["raw_mass"] = total
        if params.bg_radius is not None:
            out["raw_bg_median"], out["raw_mass_corrected"] = median, corrected
    if params.characterize:
        rg, ecc, signal = imaging.character(p, u, v, planes[0][u, v], params.diameter)
        out["Rg_gpu"], out["raw_mass_gpu"], out["signal_gpu"], out["ecc_gpu"] = rg, imaging.native_roi(image, u.astype(float), v.astype(float), (params.diameter - 1) / 2)[0], signal, ecc
    return out


def locate(frames: DataFrame, params: TrackingParams) -> DataFrame:
    """Detections of all frames: video_id, frame, seq (order in the frame), and the parameters' columns but particle.

    A column minmass of frames holds for its frame instead of the parameter, so that videos can differ.
    """
    own_minmass = ["minmass"] if "minmass" in frames.columns else []
    names = [n for n, _ in params.columns() if n not in ("frame", "particle")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            video, frame, seq, found = [], [], [], {n: [] for n in names}
            for row, image in images(batch):
                own = locate_frame(image, params, row.get("minmass"))
                n = len(own["mass"])
                video += [row["video_id"]] * n
                frame += [row["frame"]] * n
                seq += range(n)
                for k in names:
                    found[k].append(own[k])
            columns = [pa.array(np.concatenate([np.zeros(0), *found[k]]), pa.float64(), from_pandas=True) for k in names]
            yield pa.RecordBatch.from_arrays([pa.array(video, pa.string()), pa.array(frame, pa.int32()), pa.array(seq, pa.int32()), *columns], ["video_id", "frame", "seq", *names])

    return frames.select("video_id", "frame", "nrows", "ncols", "px", *own_minmass).mapInArrow(run, ", ".join(["video_id string, frame int, seq int", *(f"{n} double" for n in names)]))


def stages(frames: DataFrame, params: TrackingParams) -> dict[str, DataFrame]:
    """Intermediate results for inspection: processed frames, centres of every pixel, candidates."""
    processed = bandpassed(frames, params.variance**0.5, params.smoothing_size, params.threshold)
    return {"processed": processed, "centres": centre_planes(processed, params.diameter), "candidates": maxima_of(processed, params.separation)}


def _pixel_rows(frames: DataFrame, fn: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]], columns: list[str]) -> DataFrame:
    """Rows (video_id, frame, u, v, columns) of the pixels that fn picks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            video, frame, us, vs, found = [], [], [], [], {c: [] for c in columns}
            for row, image in images(batch):
                u, v, own = fn(image)
                video += [row["video_id"]] * len(u)
                frame += [row["frame"]] * len(u)
                us.append(u)
                vs.append(v)
                for c in columns:
                    found[c].append(own[c])
            none = [np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(video, pa.string()), pa.array(frame, pa.int32()), *(pa.array(np.concatenate(none + a).astype(np.int32)) for a in (us, vs)), *(pa.array(np.concatenate(none + found[c]), pa.float64(), from_pandas=True) for c in columns)], ["video_id", "frame", "u", "v", *columns])

    return frames.select("video_id", "frame", "nrows", "ncols", "px").mapInArrow(run, ", ".join(["video_id string, frame int, u int, v int", *(f"{c} double" for c in columns)]))


def centre_planes(frames: DataFrame, diameter: int) -> DataFrame:
    """mass, c0, c1 of every pixel that has mass."""
    def pick(p: np.ndarray):
        mass, c0, c1 = imaging.centres(p, diameter)
        u, v = np.nonzero(mass)
        return u, v, {"mass": mass[u, v], "c0": c0[u, v], "c1": c1[u, v]}

    return _pixel_rows(frames, pick, ["mass", "c0", "c1"])


def maxima_of(frames: DataFrame, separation: float, percentile: float | None = None, margin: int = 0) -> DataFrame:
    """Local maxima and their values; percentile: only above that of their frame; margin: not so near the border."""
    def pick(p: np.ndarray):
        top = imaging.maxima(p, separation)
        if percentile is not None:
            top &= p > np.percentile(p, percentile)
        if margin:
            inner = np.zeros(p.shape, bool)
            inner[margin : p.shape[0] - margin, margin : p.shape[1] - margin] = True
            top &= inner
        u, v = np.nonzero(top)
        return u, v, {"p": p[u, v]}

    return _pixel_rows(frames, pick, ["p"])


def walked(frames: DataFrame, diameter: int, separation: float, iterations: int = 10) -> DataFrame:
    """y, x, mass of every candidate with mass, by its pixel."""
    def pick(p: np.ndarray):
        planes = imaging.centres(p, diameter)
        u, v = np.nonzero(imaging.maxima(p, separation) & (planes[0] > 0))
        y, x, mass = imaging.walk(u, v, planes, iterations)
        return u, v, {"y": y, "x": x, "mass": mass}

    return _pixel_rows(frames, pick, ["y", "x", "mass"])


def refined(frames: DataFrame, diameter: int, separation: float, iterations: int = 10) -> DataFrame:
    """y, x, mass, signal of every candidate, refined with the centroid taken anew at each step, by its pixel."""
    def pick(p: np.ndarray):
        u, v = np.nonzero(imaging.maxima(p, separation) & (p > 0))
        y, x, mass, signal = imaging.refine(p, u, v, diameter // 2, iterations)
        return u, v, {"y": y, "x": x, "mass": mass, "signal": signal}

    return _pixel_rows(frames, pick, ["y", "x", "mass", "signal"])


def characterised(frames: DataFrame, diameter: int) -> DataFrame:
    """Rg, ecc and signal of every pixel whose disc has mass, of frames processed already."""
    def pick(p: np.ndarray):
        mass = imaging.centres(p, diameter)[0]
        u, v = np.nonzero(mass > 0)
        rg, ecc, signal = imaging.character(p, u, v, mass[u, v], diameter)
        return u, v, {"rg": rg, "ecc": ecc, "signal": signal}

    return _pixel_rows(frames, pick, ["rg", "ecc", "signal"])
