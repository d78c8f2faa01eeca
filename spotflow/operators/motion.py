"""Track analytics as DataFrame expressions: steps, durations, displacements, diffusion."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.displacement import lag_sums


def steps(tracks: DataFrame, pixel_size: float = 1.0, by: list[str] | None = None, frame: str = "frame") -> DataFrame:
    """x, y scaled by pixel_size, then x_step, y_step (0 for a track's first row) and steplength."""
    w = Window.partitionBy(*(by or ["particle"])).orderBy(frame)
    scaled = tracks.withColumns({"x": F.col("x") * pixel_size, "y": F.col("y") * pixel_size})
    moved = scaled.withColumns({f"{c}_step": F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)) for c in ("x", "y")})
    return moved.withColumn("steplength", F.sqrt(F.col("x_step") * F.col("x_step") + F.col("y_step") * F.col("y_step")))


def durations(tracks: DataFrame, by: list[str] | None = None) -> DataFrame:
    return tracks.withColumn("duration", F.count("*").over(Window.partitionBy(*(by or ["particle"]))))


def filter_stubs(tracks: DataFrame, least: int, by: list[str] | None = None) -> DataFrame:
    """Tracks of at least so many rows."""
    return durations(tracks, by).where(F.col("duration") >= least).drop("duration")


def last_rows(tracks: DataFrame, by: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return tracks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Frames in one block of a track, unless lags are longer.
BLOCK = 4096


def msd(tracks: DataFrame, max_lag: int, mpp: float = 1.0, fps: float = 1.0, by: list[str] | None = None, scale: int | None = None, block: int = BLOCK) -> DataFrame:
    """by, lag, time, msd, n: mean squared displacement over pairs exactly lag frames apart.

    Tracks are dealt in blocks of frames, each with as many frames behind it as the longest lag has; a task sums a block's displacements
    for all lags, so rows grow with detections and not with lags. With scale, coordinates are whole multiples of 1/scale and are summed
    as integers, so that the result doesn't depend on the order of rows. Rows without a position or frame take no part.
    """
    keys = by or ["particle"]
    span = max(block, max_lag)
    exact = (lambda c: F.round(F.col(c) * scale).cast("bigint")) if scale else (lambda c: F.col(c).cast("double"))
    known = tracks.where(F.col("frame").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))  # neither null nor NaN
    now = known.select(*keys, F.col("frame").cast("bigint").alias("_f"), exact("x").alias("_x"), exact("y").alias("_y"))
    own = F.floor(F.col("_f") / span)
    before = F.when(F.col("_f") - own * span < max_lag, own - 1)  # rows near a block's begin end pairs of the one before
    dealt = now.withColumn("_b", F.explode(F.array_compact(F.array(own, before)))).withColumn("_own", F.floor(F.col("_f") / span) == F.col("_b"))
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    value = kinds["_x"]

    def sums(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks come one after the other; the last one of a batch may go on in the next."""
        rest = None
        for pdf in chain(pdfs, [None]):
            known = [p for p in (rest, pdf) if p is not None and len(p)]
            if not known:
                continue
            rows = pd.concat(known, ignore_index=True)
            group = rows.groupby([*keys, "_b"], sort=False, dropna=False).ngroup().to_numpy()
            cut = len(rows) if pdf is None else int(np.searchsorted(group, group[-1]))
            rest = rows.iloc[cut:]
            if cut:
                g, lag, s, n = lag_sums(*(rows[c].to_numpy()[:cut] if c else group[:cut] for c in ("", "_f", "_x", "_y", "_own")), max_lag)
                first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))[g]
                yield rows.iloc[first][keys].reset_index(drop=True).assign(lag=lag, _s=s, n=n)

    ordered = dealt.repartition(*keys, "_b").sortWithinPartitions(*keys, "_b", "_f")
    parts = ordered.mapInPandas(sums, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"lag int, _s {value}, n long"]))
    found = parts.groupBy(*keys, "lag").agg(F.sum("_s").alias("_s"), F.sum("n").alias("n"))
    unit = mpp * mpp / (scale * scale if scale else 1)
    return found.select(*keys, "lag", (F.col("lag") / F.lit(float(fps))).alias("time"), (F.col("_s").cast("double") * F.lit(unit) / F.col("n")).alias("msd"), "n")


def imsd(tracks: DataFrame, mpp: float, fps: float, max_lagtime: int = 100, particles: list | None = None) -> DataFrame:
    """One row for each lag time, one column for each particle.

    Naming the particles spares a pass over the data; without names their number has to fit a row.
    """
    long = msd(tracks, max_lagtime, mpp, fps)
    return long.groupBy("time").pivot("particle", particles).agg(F.first("msd"))


def imsd_groups(tracks: DataFrame, mpp: float, fps: float, max_lagtime: int = 100, width: int = 10, scale: int | None = None) -> DataFrame:
    """imsd of any number of particles with whole-number ids: time, first, and a column for each of first .. first + width - 1.

    One row for each lag time and group of width ids, so neither a row nor the plan grows with the particles.
    """
    place = F.pmod(F.col("particle"), F.lit(width))
    long = msd(tracks, max_lagtime, mpp, fps, scale=scale).withColumn("_place", place.cast("int"))
    return long.groupBy("time", (F.col("particle") - place).alias("first")).pivot("_place", list(range(width))).agg(F.first("msd"))


def imsd_long(wide: DataFrame) -> DataFrame:
    """time, particle, msd; empty cells have no row."""
    columns = [c for c in wide.columns if c != "time"]
    return wide.unpivot(["time"], columns, "particle", "msd").where("msd IS NOT NULL")


def longest_duration(tracks: DataFrame, by: list[str] | None = None) -> int:
    return tracks.groupBy(*(by or ["particle"])).count().agg(F.max("count")).first()[0] or 0


def diffusion_constant(r: Column, time: float, cap: float = 5.0) -> Column:
    """Maximum-likelihood D of Rayleigh-distributed step lengths: mean(r²) / 4t, at most cap."""
    return F.least(F.lit(cap), F.avg(r * r) / F.lit(4.0 * time))


def track_spread(tracks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean position and root of the summed sample variances of each track."""
    return tracks.groupBy(*(by or ["particle"])).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.sqrt(F.var_samp("x") + F.var_samp("y")).alias("spread"))


def set_zero(traces: DataFrame, value: str, by: list[str] | None = None, frame: str = "frame") -> DataFrame:
    """value less its track's smallest pair mean; a first row's pair is itself and 0. Adds lowest_state 0."""
    keys = by or ["particle"]
    w = Window.partitionBy(*keys).orderBy(frame)
    pair = (F.col(value) + F.coalesce(F.lag(value).over(w), F.lit(0.0))) / 2
    return traces.withColumn("_p", pair).withColumn(value, F.col(value) - F.min("_p").over(Window.partitionBy(*keys))).withColumn("lowest_state", F.lit(0)).drop("_p")


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)
