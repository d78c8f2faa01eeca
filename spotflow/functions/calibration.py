"""Camera calibration: photon-gain densities fitted to single pixels over time, and Gaussian refinement of spots."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bessel_i1e(x: np.ndarray) -> np.ndarray:
    """exp(-x) * I1(x) for x >= 0: power series below 20, asymptotic series above."""
    x = np.asarray(x, float)
    low = np.minimum(x, 20.0)
    term = low / 2
    total = term.copy()
    for k in range(1, 60):
        term = term * (low / 2) ** 2 / (k * (k + 1))
        total += term
    high = np.maximum(x, 20.0)
    part, tail = np.ones_like(high), np.ones_like(high)
    for k in range(1, 12):
        part = part * -(4.0 - (2 * k - 1) ** 2) / (8 * k * high)
        tail += part
    return np.where(x < 20.0, total * np.exp(-low), tail / np.sqrt(2 * np.pi * high))


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        step = -i * (i - a)
        b += 2
        d = 1 / ((step * d + b) or tiny)
        c = b + step / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_survival(x: float, freedom: int) -> float:
    return upper_gamma(freedom / 2.0, x / 2.0)


def simplex_minimum(fn: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.1, rounds: int = 400, tolerance: float = 1e-8) -> tuple[np.ndarray, float]:
    """Downhill simplex: reflect, stretch, contract or shrink round the best corner."""
    n = len(start)
    corners = [np.array(start, float)] + [np.array(start, float) + (step * (abs(start[k]) or 1.0)) * np.eye(n)[k] for k in range(n)]
    values = [fn(c) for c in corners]
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        corners, values = [corners[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tolerance * (abs(values[0]) + tolerance):
            break
        middle = np.mean(corners[:-1], axis=0)
        toward = lambda t: middle + t * (corners[-1] - middle)  # noqa: E731, B023
        tried = toward(-1.0)
        value = fn(tried)
        if value < values[0]:
            further = toward(-2.0)
            best = fn(further)
            corners[-1], values[-1] = (further, best) if best < value else (tried, value)
        elif value < values[-2]:
            corners[-1], values[-1] = tried, value
        else:
            inner = toward(0.5) if value >= values[-1] else toward(-0.5)
            best = fn(inner)
            if best < min(value, values[-1]):
                corners[-1], values[-1] = inner, best
            else:
                corners = [corners[0]] + [(c + corners[0]) / 2 for c in corners[1:]]
                values = [values[0]] + [fn(c) for c in corners[1:]]
    k = int(np.argmin(values))
    return corners[k], values[k]


def gain_density(x: np.ndarray, photons: float, rate: float, offset: float) -> np.ndarray:
    """Density of an amplified photon count above an offset; rate is the inverse gain."""
    y = np.maximum(x - offset, 1e-12)
    z = 2 * np.sqrt(photons * rate * y)
    return np.where(x > offset, np.sqrt(photons * rate / y) * np.exp(z - rate * y - photons) * bessel_i1e(z), 0.0)


def fit_pixel(values: np.ndarray, bins: int = 100, least: int = 3) -> tuple[float, float, float]:
    """gain, offset and p-value of a pixel's values over time, by least chi-square over bins of more than `least`."""
    counts, edges = np.histogram(values, bins)
    return fit_counts(counts, edges, values.mean(), values.var(), least)


def fit_counts(counts: np.ndarray, edges: np.ndarray, mean: float, spread: float, least: int = 3) -> tuple[float, float, float]:
    """The same from the values' histogram, mean and variance; the first edge is their least one."""
    mids, width, low, total = (edges[1:] + edges[:-1]) / 2, edges[1] - edges[0], edges[0], counts.sum()
    used = counts > least
    if used.sum() < 5:
        return math.nan, math.nan, 0.0

    def loss(w: np.ndarray) -> float:
        photons, rate = math.exp(min(w[0], 50)), math.exp(min(w[1], 50))
        expected = total * width * gain_density(mids[used], photons, rate, w[2])
        return float(np.sum((counts[used] - expected) ** 2 / counts[used]))

    offset = low - 0.05 * (mean - low)
    gain = max(spread / (2 * max(mean - offset, 1e-9)), 1e-9)
    start = np.array([math.log(max((mean - offset) / gain, 1e-9)), -math.log(gain), offset])
    best, value = simplex_minimum(loss, start)
    best, value = simplex_minimum(loss, best, step=0.02)
    return math.exp(-best[1]), float(best[2]), chi2_survival(value, int(used.sum()) - 3)


def pixel_histograms(frames: DataFrame, pixels: int = 400, bins: int = 100) -> DataFrame:
    """u, v, mean, spread, edges, counts: the values over time of `pixels` pixels, picked by a hash of their place.

    Extents first, then counts: both are partial aggregates of fixed size, so a pixel's series is never gathered, however many frames there are.
    Bins are those of numpy's histogram; null and NaN values don't count, and a pixel that never changes has no histogram.
    """
    spark = frames.sparkSession
    shape = frames.select("nrows", "ncols").first()
    every = [(u, v) for u in range(shape.nrows) for v in range(shape.ncols)]
    rng = np.random.default_rng(1)
    chosen = [every[i] for i in sorted(rng.permutation(len(every))[:pixels])]
    at = F.array(*(F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v in chosen))
    picked = frames.select("ncols", "px", F.explode(at).alias("a")).select(F.col("a.u").alias("u"), F.col("a.v").alias("v"), F.get("px", F.col("a.u") * F.col("ncols") + F.col("a.v")).cast("double").alias("p")).where(F.abs("p") < float("inf"))
    ends = picked.groupBy("u", "v").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.avg("p").alias("mean"), F.var_pop("p").alias("spread")).where("low < high").collect()  # a row a pixel
    rows = [(r.u, r.v, r.mean, r.spread, np.linspace(r.low, r.high, bins + 1).tolist()) for r in ends]
    known = spark.createDataFrame(rows, "u int, v int, mean double, spread double, edges array<double>")
    edge = lambda k: F.get("edges", k)
    rough = F.least(F.floor((F.col("p") - edge(F.lit(0))) * (bins / (edge(F.lit(bins)) - edge(F.lit(0))))), F.lit(bins - 1)).cast("int")
    placed = picked.join(F.broadcast(known.select("u", "v", "edges")), ["u", "v"]).withColumn("_b", rough)
    down, up = F.col("p") < edge(F.col("_b")), (F.col("p") >= edge(F.col("_b") + 1)) & (F.col("_b") < bins - 1)
    counted = placed.groupBy("u", "v", (F.col("_b") - down.cast("int") + up.cast("int")).alias("bin")).count()
    lists = counted.groupBy("u", "v").agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("_n"))
    full = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.element_at("_n", k), F.lit(0)).cast("bigint"))
    return known.join(lists, ["u", "v"]).select("u", "v", "mean", "spread", "edges", full.alias("counts"))


def random_pixel_calibration(frames: DataFrame, pixels: int = 400, least_p: float = 0.01) -> tuple[float, float]:
    """Mean gain and offset of well-fitted pixels, `pixels` of them picked by a hash of their place; fitted to their histograms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fit_counts(np.array(n), np.array(edges), mean, spread) for _, _, mean, spread, edges, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.float64()) for k in range(3)], ["gain", "offset", "p"])

    fitted = pixel_histograms(frames, pixels).repartition("u", "v").mapInArrow(run, "gain double, offset double, p double")
    row = fitted.where(F.col("p") > least_p).agg(F.avg("gain").alias("gain"), F.avg("offset").alias("offset")).first()
    if row.gain is None:
        raise ValueError("no pixel fits the camera's density")
    return row.gain, row.offset


def fit_spot(image: np.ndarray, y: float, x: float, radius: int, rounds: int = 30) -> tuple[float, float, float, float, float]:
    """y, x, signal, size, background of a round Gaussian fitted to a disc by damped Gauss-Newton steps."""
    u, v = int(round(y)), int(round(x))
    rows = np.arange(max(0, u - radius), min(image.shape[0], u + radius + 1))
    cols = np.arange(max(0, v - radius), min(image.shape[1], v + radius + 1))
    yy, xx = np.meshgrid(rows, cols, indexing="ij")
    near = (yy - u) ** 2 + (xx - v) ** 2 <= radius * radius
    a, b, data = yy[near].astype(float), xx[near].astype(float), image[yy[near], xx[near]].astype(float)
    low = float(data.min())
    w = np.array([y, x, float(data.max()) - low, max(radius / 2, 0.5), low])

    def model(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dy, dx = a - w[0], b - w[1]
        bell = np.exp(-(dy * dy + dx * dx) / (2 * w[3] ** 2))
        slope = np.stack([w[2] * bell * dy / w[3] ** 2, w[2] * bell * dx / w[3] ** 2, bell, w[2] * bell * (dy * dy + dx * dx) / w[3] ** 3, np.ones_like(bell)], axis=1)
        return w[2] * bell + w[4], slope

    damping, (value, slope) = 1e-2, model(w)
    cost = float(((data - value) ** 2).sum())
    for _ in range(rounds):
        normal = slope.T @ slope
        step = np.linalg.solve(normal + damping * np.diag(np.diag(normal) + 1e-12), slope.T @ (data - value))
        tried = w + step
        tried[3] = max(abs(tried[3]), 0.1)
        made, tilt = model(tried)
        less = float(((data - made) ** 2).sum())
        if less < cost:
            done = cost - less < 1e-12 * (cost + 1e-12)
            w, value, slope, cost, damping = tried, made, tilt, less, damping / 3
            if done:
                break
        else:
            damping *= 4
    return tuple(float(k) for k in w)


def refined(frames: DataFrame, detections: DataFrame, radius: int = 5) -> DataFrame:
    """detections with y, x, signal, size and background of fitted Gaussians."""
    from ..operators.photometry import _measure

    made = {c: "double" for c in ("y_fit", "x_fit", "signal_fit", "size_fit", "background")}

    def measure(image, y, x):
        found = [fit_spot(image, a, b, radius) for a, b in zip(y, x, strict=True)]
        return {c: [f[k] for f in found] for k, c in enumerate(made)}

    out = _measure(frames, detections.drop("background"), ["video_id", "frame"], measure, made)
    return out.withColumns({"y": F.col("y_fit"), "x": F.col("x_fit")}).drop("y_fit", "x_fit")
