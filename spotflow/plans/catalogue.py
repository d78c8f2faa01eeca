"""Registered queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detections as det
from ..operators import frames as fr
from ..operators import motion, photometry, tiles
from ..operators.link import link, relinked_counts
from ..params import TrackingParams
from ..storage import stored
from . import lens, web
from .lens import SQL, band_sql, centre_sql, maxima_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def r6_fast(name: str):
    """r6() of a column of many rows: where six decimals aren't near a tie, the nearest number of millionths is the same without decimal numbers."""
    scaled = F.col(name) * 1e6
    return F.when((F.abs(F.col(name)) < 1e6) & (F.abs(scaled - F.floor(scaled) - 0.5) > 0.001), F.rint(scaled) / 1e6).otherwise(F.round(name, 6)).alias(name)


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


# preprocessing and locating


@query(f"WITH {SQL['px']}, {band_sql(1, 3)} SELECT video_id, frame, u, v, round(p, 6) AS p FROM band")
def bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.pixels(fr.bandpassed(lens.frames(spark, sf_dir), 1, 3)).select("video_id", "frame", "u", "v", *r6("p"))


_REPLICATED = f"""WITH {SQL['px']}, ker(d, w) AS (VALUES {", ".join(f"({d}, exp(-{d * d} / 2.0))" for d in range(-4, 5))}), box(d) AS (VALUES (-2), (-1), (0), (1), (2)), tot AS (SELECT sum(w) AS s FROM ker),
gr AS (SELECT a.frame, a.video_id, a.u, a.v, sum(w * b.p) / any_value(s) AS g FROM px a CROSS JOIN ker CROSS JOIN tot JOIN px b ON b.frame = a.frame AND b.u = a.u AND b.v = a.v + d GROUP BY ALL),
gg AS (SELECT a.frame, a.video_id, a.u, a.v, sum(w * b.g) / any_value(s) AS g FROM gr a CROSS JOIN ker CROSS JOIN tot JOIN gr b ON b.frame = a.frame AND b.v = a.v AND b.u = a.u + d GROUP BY ALL),
bx AS (SELECT a.frame, a.u, a.v, sum(b.p) / 25 AS c FROM px a CROSS JOIN box x CROSS JOIN box y JOIN px b ON b.frame = a.frame AND b.u = least(greatest(a.u + x.d, 0), 7) AND b.v = least(greatest(a.v + y.d, 0), 7) GROUP BY ALL)
SELECT video_id, gg.frame, gg.u, gg.v, round(CASE WHEN g - c >= 0.5 THEN g - c ELSE 0 END, 6) AS p FROM gg JOIN bx ON gg.frame = bx.frame AND gg.u = bx.u AND gg.v = bx.v"""


@query(_REPLICATED)
def bandpass_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.pixels(fr.bandpassed(lens.frames(spark, sf_dir), 1, 5, threshold=0.5, replicate=True)).select("video_id", "frame", "u", "v", *r6("p"))


@query(f"WITH {SQL['px']}, {band_sql(1, 3)}, {centre_sql(1)}, {maxima_sql(3)} SELECT top.frame, round(mass, 6) AS mass, round(top.u + c0, 6) AS y, round(top.v + c1, 6) AS x FROM top JOIN cen ON cen.frame = top.frame AND cen.u = top.u AND cen.v = top.v WHERE mass > 0")
def locate_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids at the local maxima of band-passed frames, without walking."""
    processed = fr.bandpassed(lens.frames(spark, sf_dir), 1, 3)
    return _unwalked(processed, 3, 3)


@query(ORACLES["bandpass"])
def bandpass_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band pass in tiles of three by three pixels, with a halo of one."""
    return tiles.tile_pixels(tiles.bandpassed_tiles(lens.frames(spark, sf_dir), 1, 3, tile=3)).select("video_id", "frame", "u", "v", *r6("p"))


@query(ORACLES["locate_slice"])
def locate_slice_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids at local maxima, each found by the tile that owns its pixel."""
    from ..functions import imaging

    def pick(image):
        import numpy as np

        p = imaging.bandpass(image, 1, 3)
        mass, c0, c1 = imaging.centres(p, 3)
        u, v = np.nonzero(imaging.maxima(p, 3) & (mass > 0))
        return u, v, {"mass": mass[u, v], "c0": c0[u, v], "c1": c1[u, v]}

    found = tiles.picked_tiles(lens.frames(spark, sf_dir), pick, ["mass", "c0", "c1"], 4, tile=3)
    return found.select("frame", *r6("mass"), F.round(F.col("u") + F.col("c0"), 6).alias("y"), F.round(F.col("v") + F.col("c1"), 6).alias("x"))


def _unwalked(processed: DataFrame, diameter: int, separation: float) -> DataFrame:
    from ..functions import imaging

    def pick(p):
        import numpy as np

        mass, c0, c1 = imaging.centres(p, diameter)
        u, v = np.nonzero(imaging.maxima(p, separation) & (mass > 0))
        return u, v, {"mass": mass[u, v], "y": u + c0[u, v], "x": v + c1[u, v]}

    return fr._pixel_rows(processed, pick, ["mass", "y", "x"]).select("frame", *r6("mass", "y", "x"))


@query(f"WITH {SQL['px']}, {band_sql(1, 3)}, {centre_sql(1)} SELECT video_id, frame, u, v, {rounded('mass', 'c0', 'c1')} FROM cen WHERE mass > 0")
def centre_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.centre_planes(fr.bandpassed(lens.frames(spark, sf_dir), 1, 3), 3).select("video_id", "frame", "u", "v", *r6("mass", "c0", "c1"))


@query(f"WITH {SQL['px']}, {maxima_sql(3, 'px')} SELECT video_id, frame, u, v, round(p, 6) AS p FROM top")
def dilation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.maxima_of(lens.frames(spark, sf_dir), 3).select("video_id", "frame", "u", "v", *r6("p"))


@query(f"WITH {SQL['px']}, {maxima_sql(3, 'px')}, q AS (SELECT frame, quantile_cont(p, 0.64) AS b FROM px GROUP BY frame) SELECT video_id, top.frame, u, v, round(p, 6) AS p FROM top JOIN q ON q.frame = top.frame WHERE p > b AND u BETWEEN 1 AND 6 AND v BETWEEN 1 AND 6")
def maxima_percentile_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.maxima_of(lens.frames(spark, sf_dir), 3, percentile=64, margin=1).select("video_id", "frame", "u", "v", *r6("p"))


_WALK = f"""WITH RECURSIVE {SQL['px']}, {band_sql(1, 3)}, {centre_sql(1)}, {maxima_sql(3)},
full_ AS (SELECT band.frame, band.video_id, band.u, band.v, coalesce(mass, 0) AS mass, coalesce(c0, 0) AS c0, coalesce(c1, 0) AS c1 FROM band LEFT JOIN cen ON cen.frame = band.frame AND cen.u = band.u AND cen.v = band.v),
stp AS (SELECT *, CASE WHEN c0 > 0.6 AND u < 7 THEN 1 WHEN c0 < -0.6 AND u > 0 THEN -1 ELSE 0 END AS du, CASE WHEN c1 > 0.6 AND v < 7 THEN 1 WHEN c1 < -0.6 AND v > 0 THEN -1 ELSE 0 END AS dv FROM full_),
wlk AS (
  SELECT s.video_id, s.frame, s.u AS u0, s.v AS v0, s.u + du AS nu, s.v + dv AS nv, s.u + du + c0 AS y, s.v + dv + c1 AS x, s.mass, du <> 0 OR dv <> 0 AS going, 1 AS n
  FROM stp s JOIN top ON top.frame = s.frame AND top.u = s.u AND top.v = s.v WHERE s.mass > 0
  UNION ALL
  SELECT s.video_id, s.frame, w.u0, w.v0, s.u + du, s.v + dv, s.u + du + c0, s.v + dv + c1, s.mass, du <> 0 OR dv <> 0, n + 1
  FROM wlk w JOIN stp s ON s.frame = w.frame AND s.u = w.nu AND s.v = w.nv WHERE w.going AND n < 10
)"""


@query(_WALK + "\nSELECT video_id, frame, u0 AS u, v0 AS v, round(max_by(y, n), 6) AS y, round(max_by(x, n), 6) AS x, round(max_by(mass, n), 6) AS mass FROM wlk GROUP BY video_id, frame, u0, v0")
def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.walked(fr.bandpassed(lens.frames(spark, sf_dir), 1, 3), 3, 3).select("video_id", "frame", "u", "v", *r6("y", "x", "mass"))


_REFINE = f"""WITH RECURSIVE {SQL['px']}, {band_sql(1, 3)}, {centre_sql(1)}, {maxima_sql(3)},
cnt AS (SELECT frame, u, v, coalesce(c0, 0) AS c0, coalesce(c1, 0) AS c1, mass FROM cen),
rfn AS (
  SELECT video_id, frame, u AS u0, v AS v0, least(greatest(u, 1), 6) AS u, least(greatest(v, 1), 6) AS v, 0 AS n FROM top WHERE p > 0
  UNION ALL
  SELECT video_id, frame, u0, v0, nu, nv, n + 1 FROM (
    SELECT r.*, least(greatest(r.u + CASE WHEN c0 > 0.6 THEN 1 WHEN c0 < -0.6 THEN -1 ELSE 0 END, 1), 6) AS nu, least(greatest(r.v + CASE WHEN c1 > 0.6 THEN 1 WHEN c1 < -0.6 THEN -1 ELSE 0 END, 1), 6) AS nv
    FROM rfn r JOIN cnt ON cnt.frame = r.frame AND cnt.u = r.u AND cnt.v = r.v) WHERE n < 10 AND (nu <> u OR nv <> v)
), lst AS (SELECT video_id, frame, u0, v0, max_by(u, n) AS u, max_by(v, n) AS v FROM rfn GROUP BY ALL)
SELECT lst.video_id, lst.frame, u0 AS u, v0 AS v, round(any_value(lst.u + c0), 6) AS y, round(any_value(lst.v + c1), 6) AS x, round(any_value(mass), 6) AS mass, round(max(b.p), 6) AS signal
FROM lst JOIN cnt ON cnt.frame = lst.frame AND cnt.u = lst.u AND cnt.v = lst.v CROSS JOIN dsc JOIN band b ON b.frame = lst.frame AND b.u = lst.u + i AND b.v = lst.v + j GROUP BY lst.video_id, lst.frame, u0, v0"""


@query(_REFINE)
def refine_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates refined with the centroid taken anew at each step."""
    return fr.refined(fr.bandpassed(lens.frames(spark, sf_dir), 1, 3), 3, 3).select("video_id", "frame", "u", "v", *r6("y", "x", "mass", "signal"))


@query(f"WITH {SQL['px']}, t AS (SELECT frame, max(p) AS t FROM px GROUP BY frame) SELECT video_id, px.frame, u, v, round(t - p, 6) AS p FROM px JOIN t ON t.frame = px.frame")
def invert_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.pixels(fr.inverted(lens.frames(spark, sf_dir))).select("video_id", "frame", "u", "v", *r6("p"))


#: Mass limit, largest radius of gyration and separation of the query below.
_LIMITS = (3.0, 0.75, 3)


@query(_WALK + f""", cand AS (SELECT video_id, frame, u0, v0, max_by(y, n) AS y, max_by(x, n) AS x, max_by(mass, n) AS mass FROM wlk GROUP BY ALL),
rad AS (SELECT c.frame, c.u0, c.v0, sqrt(sum(b.p * (i * i + j * j)) / any_value(c.mass)) AS rg FROM cand c CROSS JOIN dsc JOIN band b ON b.frame = c.frame AND b.u = c.u0 + i AND b.v = c.v0 + j GROUP BY ALL),
kept AS (SELECT cand.*, rg FROM cand JOIN rad USING (frame, u0, v0) WHERE mass > {_LIMITS[0]} AND rg < {_LIMITS[1]})
SELECT video_id, frame, {rounded('y', 'x', 'mass', 'rg')} FROM kept a WHERE NOT EXISTS (SELECT 1 FROM kept b WHERE b.frame = a.frame AND (b.u0, b.v0) <> (a.u0, a.v0)
  AND (b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x) < {_LIMITS[2] ** 2} AND (b.mass > a.mass OR b.mass = a.mass AND (b.u0, b.v0) < (a.u0, a.v0)))""")
def locate_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located particles over a mass, below a size, the brighter one of each close pair."""
    params = TrackingParams(3, noise_size=1, smoothing_size=3, separation=_LIMITS[2], minmass=_LIMITS[0], maxsize=_LIMITS[1], cpu_processed=True)
    return fr.locate(lens.frames(spark, sf_dir), params).select("video_id", "frame", *r6("y", "x", "mass"), F.round("Rg", 6).alias("rg"))


@query(f"""WITH {SQL['px']}, pos AS (SELECT frame, video_id, u, v, greatest(p, 0) AS p FROM px), {lens.disc_sql(1)},
a AS (SELECT a.frame, a.video_id, a.u, a.v, sum(b.p) AS mass, sqrt(sum(b.p * (i * i + j * j)) / nullif(sum(b.p), 0)) AS rg, max(b.p) AS signal,
  sqrt(pow(sum(b.p * sin(2 * atan2(j, i))), 2) + pow(sum(b.p * cos(2 * atan2(j, i))), 2)) / nullif(sum(b.p) - any_value(a.p), 0) AS ecc
  FROM pos a CROSS JOIN dsc JOIN pos b ON b.frame = a.frame AND b.u = a.u + i AND b.v = a.v + j WHERE a.u BETWEEN 1 AND 6 AND a.v BETWEEN 1 AND 6 GROUP BY a.frame, a.video_id, a.u, a.v)
SELECT video_id, frame, u, v, {rounded('rg', 'signal')}, CASE WHEN rg > 1e-6 THEN round(ecc, 6) END AS ecc FROM a WHERE mass > 0""")
def characterise(spark: SparkSession, sf_dir: str) -> DataFrame:
    positive = lens.frames(spark, sf_dir).withColumn("px", F.transform("px", lambda p: F.greatest(p, F.lit(0.0))))
    return fr.characterised(positive, 3).select("video_id", "frame", "u", "v", *r6("rg", "signal"), F.when(F.col("rg") > 1e-6, F.round("ecc", 6)).alias("ecc"))


_LOCATED = ["mass", "y", "x", "Rg", "ecc", "signal", "raw_mass", "raw_bg_median", "raw_mass_corrected", "Rg_gpu", "raw_mass_gpu", "signal_gpu", "ecc_gpu"]


@query(_WALK + f""", cand AS (SELECT video_id, frame, u0, v0, max_by(y, n) AS y, max_by(x, n) AS x, max_by(mass, n) AS mass FROM wlk GROUP BY ALL),
kept AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY u0, v0) - 1 AS seq FROM cand a WHERE mass > 0 AND NOT EXISTS (SELECT 1 FROM cand b WHERE b.frame = a.frame AND (b.u0, b.v0) <> (a.u0, a.v0)
  AND (b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x) < 9 AND (b.mass > a.mass OR b.mass = a.mass AND (b.u0, b.v0) < (a.u0, a.v0)))),
chr AS (SELECT c.frame, c.u0, c.v0, sum(b.p * (i * i + j * j)) AS spread, sum(b.p) AS m0, max(b.p) AS top, max(b.p) FILTER (i = 0 AND j = 0) AS own, sqrt(pow(sum(b.p * sin(2 * atan2(j, i))), 2) + pow(sum(b.p * cos(2 * atan2(j, i))), 2)) AS skew
  FROM kept c CROSS JOIN dsc JOIN band b ON b.frame = c.frame AND b.u = c.u0 + i AND b.v = c.v0 + j GROUP BY ALL),
raw AS (SELECT c.frame, c.u0, c.v0, sum(p) FILTER (i * i + j * j <= 1) AS s, quantile_cont(p, 0.5) FILTER (i * i + j * j BETWEEN 1 AND 4) AS b
  FROM kept c CROSS JOIN range(-2, 3) r(i) CROSS JOIN range(-2, 3) q(j) JOIN px ON px.frame = c.frame AND px.u = CAST(round(c.y) AS INTEGER) + i AND px.v = CAST(round(c.x) AS INTEGER) + j GROUP BY ALL),
raw0 AS (SELECT c.frame, c.u0, c.v0, sum(p) AS s FROM kept c CROSS JOIN dsc JOIN px ON px.frame = c.frame AND px.u = c.u0 + i AND px.v = c.v0 + j GROUP BY ALL),
every AS (SELECT kept.*, sqrt(spread / mass) AS Rg, skew / (mass - own) AS ecc, top AS signal, raw.s AS raw_mass, raw.b AS raw_bg_median, raw.s - 5 * raw.b AS raw_mass_corrected, sqrt(spread / m0) AS Rg_gpu, raw0.s AS raw_mass_gpu, top AS signal_gpu, skew / (m0 - own) AS ecc_gpu
  FROM kept JOIN chr USING (frame, u0, v0) JOIN raw USING (frame, u0, v0) JOIN raw0 USING (frame, u0, v0))
SELECT video_id, frame, CAST(seq AS INTEGER) AS seq, {rounded(*_LOCATED)} FROM every""")
def locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of locating: band pass, maxima, walk, close pairs, character, raw signal."""
    params = TrackingParams(3, noise_size=1, smoothing_size=3, separation=3, cpu_processed=True, characterize=True, sig_radius=1, bg_radius=2)
    found = fr.locate(lens.frames(spark, sf_dir), params)
    return found.select("video_id", "frame", "seq", *r6(*(n for n, _ in params.columns() if n != "frame")))


@query(f"WITH {SQL['px']} SELECT video_id, u, v, round(avg(p), 6) AS p FROM px GROUP BY ALL")
def mean_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.mean_frames(lens.frames(spark, sf_dir), "video_id").select("video_id", "u", "v", *r6("p"))


@query(f"WITH {SQL['px']}, m AS (SELECT u, v, avg(p - -1) / 2 AS m FROM px GROUP BY u, v), t AS (SELECT max(m) AS t FROM m) SELECT video_id, frame, px.u, px.v, round((p - -1) / (m / t * 2), 6) AS p FROM px JOIN m ON px.u = m.u AND px.v = m.v CROSS JOIN t")
def illumination_divide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames over a profile from their own temporal mean, not blurred, at gain 2 and offset -1."""
    return fr.pixels(fr.illumination_corrected(lens.frames(spark, sf_dir), 0.0, 2.0, -1.0)).select("video_id", "frame", "u", "v", *r6("p"))


@query(f"WITH {SQL['px']}, m AS (SELECT video_id, u, v, avg((p - -1) / 2) AS m FROM px GROUP BY ALL), t AS (SELECT video_id, max(m) AS t FROM m GROUP BY video_id) SELECT px.video_id, frame, px.u, px.v, round((p - -1) / (m / t * 2), 6) AS p FROM px JOIN m ON px.video_id = m.video_id AND px.u = m.u AND px.v = m.v JOIN t ON t.video_id = px.video_id")
def illumination_by_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames over the profile of their own video, for all videos at once."""
    return fr.pixels(fr.illumination_corrected_by_video(lens.frames(spark, sf_dir), 0.0, 2.0, -1.0)).select("video_id", "frame", "u", "v", *r6("p"))


@query(f"WITH {SQL['px']} SELECT video_id, frame, u, v, round((p - 3.5) / 1.7, 6) AS p FROM px WHERE u < 5 AND v < 3")
def gain_and_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.pixels(fr.cropped(fr.gain_corrected(lens.frames(spark, sf_dir), 1.7, 3.5), 5, 3)).select("video_id", "frame", "u", "v", *r6("p"))


@query(f"WITH {SQL['px']}, q AS (SELECT frame, quantile_cont(p, 0.64) AS b FROM px GROUP BY frame) SELECT video_id, px.frame, u, v, round(p, 6) AS p FROM px JOIN q ON q.frame = px.frame WHERE p > b")
def percentile_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.above_percentile(fr.pixels(lens.frames(spark, sf_dir)), 64, ["frame"], "p").select("video_id", "frame", "u", "v", *r6("p"))


@query(f"WITH {SQL['px']} SELECT video_id, frame, u, v, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY p DESC, u, v) AS n FROM px) WHERE n <= 3")
def topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.brightest(fr.pixels(lens.frames(spark, sf_dir)), 3, ["frame"], "p", "u", "v").select("video_id", "frame", "u", "v", *r6("p"))


@query(f"WITH {SQL['px']} SELECT video_id, frame, u, v, round(p, 6) AS p FROM px ORDER BY px.p DESC, frame, u, v LIMIT 50")
def topn_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.brightest_overall(fr.pixels(lens.frames(spark, sf_dir)), 50, "p", "frame", "u", "v").select("video_id", "frame", "u", "v", *r6("p"))


# photometry


def _positions(frames: DataFrame, *at: tuple[float, float]) -> DataFrame:
    points = F.array(*(F.struct(F.lit(k).cast("bigint").alias("particle"), F.lit(float(y)).alias("y"), F.lit(float(x)).alias("x")) for k, (y, x) in enumerate(at)))
    return frames.select("video_id", "frame", F.explode(points).alias("_p")).select("video_id", "frame", "_p.*")


@query(f"""WITH {SQL['px']}, pos(particle, y, x) AS (VALUES (0, 0, 0), (1, 0, 5), (2, 4, 0), (3, 4, 5)), off(i, j) AS (SELECT i, j FROM range(-2, 3) a(i), range(-2, 3) b(j)),
j AS (SELECT frame, video_id, particle, pos.y, pos.x, i * i + j * j AS r2, p FROM pos CROSS JOIN off JOIN px ON u = y + i AND v = x + j)
SELECT video_id, frame, CAST(particle AS BIGINT) AS particle, round(sum(p) FILTER (r2 <= 1), 6) AS raw_mass, round(quantile_cont(p, 0.5) FILTER (r2 BETWEEN 1 AND 4), 6) AS raw_bg_median,
  round(sum(p) FILTER (r2 <= 1) - 5 * quantile_cont(p, 0.5) FILTER (r2 BETWEEN 1 AND 4), 6) AS raw_mass_corrected FROM j GROUP BY ALL""")
def roi_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = lens.frames(spark, sf_dir)
    found = photometry.native_roi(frames, _positions(frames, (0, 0), (0, 5), (4, 0), (4, 5)), 1, 2, 0)
    return found.select("video_id", "frame", "particle", *r6("raw_mass", "raw_bg_median", "raw_mass_corrected"))


_LAB = """j AS (SELECT frame, video_id, particle, (u - y) * (u - y) + (v - x) * (v - x) AS r2, p FROM pos JOIN px ON u BETWEEN floor(y) - 2 AND floor(y) + 3 AND v BETWEEN floor(x) - 2 AND floor(x) + 3),
a AS (SELECT video_id, frame, particle, sum(p) FILTER (r2 <= 2) AS s, quantile_cont(p, 0.5) FILTER (r2 > 3 AND r2 <= 8) AS b, count(*) FILTER (r2 <= 2) AS n, avg(p) FILTER (r2 <= 2) AS sm, avg(p) FILTER (r2 > 3 AND r2 <= 8) AS bm FROM j GROUP BY ALL)
SELECT video_id, frame, CAST(particle AS BIGINT) AS particle, round(s, 6) AS red_int, round(b, 6) AS red_bg, n AS red_sig_pixel_size, round(sm, 6) AS red_int_mean, round(bm, 6) AS red_bg_mean, round(s - b * n, 6) AS red_int_corrected FROM a"""
_LAB_COLUMNS = ["red_int", "red_bg", "red_int_mean", "red_bg_mean", "red_int_corrected"]


@query(f"WITH {SQL['px']}, pos(particle, y, x) AS (VALUES (0, 0.25, 0.5), (1, 3.5, 4.25), (2, 6.75, 7.125)), {_LAB}")
def roi_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = lens.frames(spark, sf_dir)
    found = photometry.lab_roi(frames, _positions(frames, (0.25, 0.5), (3.5, 4.25), (6.75, 7.125)), 2, 8, 1, means=True)
    return found.select("video_id", "frame", "particle", "red_sig_pixel_size", *r6(*_LAB_COLUMNS))


@query(f"WITH {SQL['px']}, pos(particle, y, x) AS (VALUES (0, 0.25, 0.5), (1, 3.5, 4.25)), {_LAB.replace('s - b * n', 's - b * 9')}")
def roi_nominal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Background taken for a nominal area of nine pixels, in the frame or not."""
    frames = lens.frames(spark, sf_dir)
    found = photometry.lab_roi(frames, _positions(frames, (0.25, 0.5), (3.5, 4.25)), 2, 8, 1, means=True)
    return photometry.corrected(found, nominal=9).select("video_id", "frame", "particle", "red_sig_pixel_size", *r6(*_LAB_COLUMNS))


@query(f"WITH {SQL['px']}, pos(particle, y, x) AS (VALUES (0, 2.5, 2.5), (1, 5.25, 6.0)), {_LAB}")
def constant_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = spark.createDataFrame([(0, 2.5, 2.5), (1, 5.25, 6.0)], "particle long, y double, x double")
    found = photometry.constant_positions(lens.frames(spark, sf_dir), at, 2, 8, 1, means=True)
    return found.select("video_id", "frame", "particle", "red_sig_pixel_size", *r6(*_LAB_COLUMNS))


@query(f"WITH {SQL['ev']}, {SQL['trk']}, p AS (SELECT *, (x + coalesce(lag(x) OVER (PARTITION BY particle ORDER BY frame), 0)) / 2 AS q FROM trk) SELECT particle, frame, round(x - min(q) OVER (PARTITION BY particle), 6) AS x, 0 AS lowest_state FROM p")
def set_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.set_zero(lens.tracks(spark, sf_dir), "x").select("particle", "frame", *r6("x"), "lowest_state")


@query("SELECT o_orderkey, round(CASE WHEN bg = 0 THEN avg(nullif(bg, 0)) OVER () ELSE bg END, 4) AS background FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE o_totalprice END AS bg FROM orders)")
def background_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = lens.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("background"))
    return det.filled_background(orders).select("o_orderkey", F.round("background", 4).alias("background"))


# linking


@query(f"WITH {SQL['ev']}, {SQL['det']} SELECT frame, seq, y, x, mass FROM det a WHERE NOT EXISTS (SELECT 1 FROM det b WHERE b.frame = a.frame AND b.seq <> a.seq AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) < 100 AND (b.mass > a.mass OR (b.mass = a.mass AND b.seq < a.seq)))")
def close_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.suppress_close(lens.detections(spark, sf_dir), 10, ["frame"], "seq").select("frame", "seq", "y", "x", "mass")


_EDGES = f"{SQL['ev']}, {SQL['det']}, e AS (SELECT b.frame, a.seq AS src, b.seq AS dst, (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) AS d2 FROM det a JOIN det b ON b.frame = a.frame + 1 WHERE (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) < 225)"


_PLACES = f"{SQL['ev']}, {SQL['det']}, p AS (SELECT frame, y, x, min(seq) AS place, count(*) AS n FROM det WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY ALL)"


@query(f"WITH {_EDGES} SELECT frame, src, dst, round(d2, 6) AS d2 FROM e")
def link_edges_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of detections of neighbouring frames in range."""
    return det.link_edges(lens.detections(spark, sf_dir), 15, [], "seq").select("frame", "src", "dst", r6_fast("d2"))


@query(f"WITH {_PLACES} SELECT b.frame, a.place AS src, b.place AS dst, a.n AS n_src, b.n AS n_dst, round((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x), 6) AS d2 FROM p a JOIN p b ON b.frame = a.frame + 1 WHERE (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) < 225")
def link_place_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in range, with the number of detections at each; link_places says which these are. link_edges_grid has each edge."""
    return det.place_edges(lens.detections(spark, sf_dir), 15, [], "seq").select("frame", "src", "dst", "n_src", "n_dst", r6_fast("d2"))


@query(f"WITH {_PLACES} SELECT det.frame, seq, place FROM det LEFT JOIN p ON p.frame = det.frame AND p.y = det.y AND p.x = det.x")
def link_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.place_members(lens.detections(spark, sf_dir), [], "seq").select("frame", "seq", "place")


@query(f"WITH {_EDGES} SELECT frame, src, dst, round(d2, 6) AS d2 FROM e")
def link_edges_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edges: a condition on distances alone, which the operator turns into blocks and their surroundings."""
    return det.link_edges(lens.detections(spark, sf_dir), 15, [], "seq").select("frame", "src", "dst", r6_fast("d2"))


@query(f"WITH {_EDGES}, s AS (SELECT src AS seq, count(*) AS n FROM e GROUP BY src), d AS (SELECT dst AS seq, count(*) AS n FROM e GROUP BY dst) SELECT det.frame, det.seq, coalesce(d.n, 0) AS n_before, coalesce(s.n, 0) AS n_after FROM det LEFT JOIN d ON d.seq = det.seq LEFT JOIN s ON s.seq = det.seq")
def link_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detection's number of edges to the frame before and to the one behind."""
    return det.link_degrees(lens.detections(spark, sf_dir), 15, [], "seq").select("frame", "seq", "n_before", "n_after")


@query(f"WITH {_EDGES} SELECT frame, src, dst FROM (SELECT *, count(*) OVER (PARTITION BY frame, src) AS s, count(*) OVER (PARTITION BY frame, dst) AS d FROM e) WHERE s = 1 AND d = 1")
def trivial_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.sole_links(lens.detections(spark, sf_dir), 15, [], "seq").select("frame", "src", "dst")


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of one user each as a video, so that frames are small."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lit(1704067200)
    return lens.events(spark, sf_dir).select(F.concat(F.lit("v"), F.col("user_id") % 16).alias("video_id"), F.floor(seconds / 21600).cast("int").alias("frame"), F.col("event_id").alias("seq"), F.col("value").alias("y"), F.col("k").alias("x"))


@query()
def link_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(_sparse(spark, sf_dir), 15).select("video_id", "frame", "seq", "particle")


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a particle in a band of its own, 1,000 pixels from the next; sixteen videos with as many bands as there are users."""
    track = lens.tracks(spark, sf_dir)
    band = F.floor(F.col("particle") / 16) * 1000
    return track.select(F.concat(F.lit("v"), F.col("particle") % 16).alias("video_id"), "frame", F.col("event_id").alias("seq"), (band + F.col("x")).cast("double").alias("y"), F.col("y").alias("x"))


_BANDS = f"{SQL['ev']}, {SQL['trk']}, d AS (SELECT particle AS lane, 'v' || CAST(particle % 16 AS VARCHAR) AS video_id, frame, event_id AS seq, particle // 16 * 1000 + x AS y, y AS x FROM trk)"
_NUMBERED = "n AS (SELECT video_id, id, row_number() OVER (PARTITION BY video_id ORDER BY {order}) - 1 AS particle FROM r WHERE seq = id) SELECT r.video_id, r.frame, r.seq, particle FROM r JOIN n ON n.video_id = r.video_id AND n.id = r.id"


@query(f"""WITH {_BANDS}, b AS (SELECT *, coalesce((y - lag(y) OVER w) * (y - lag(y) OVER w) + (x - lag(x) OVER w) * (x - lag(x) OVER w) >= 225, true) AS fresh FROM d WINDOW w AS (PARTITION BY lane ORDER BY frame)),
c AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY lane ORDER BY frame) AS part FROM b), r AS (SELECT *, first_value(seq) OVER (PARTITION BY lane, part ORDER BY frame) AS id FROM c), {_NUMBERED.format(order='frame, seq')}""")
def link_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without memory a track goes on while the band's next detection is in range."""
    return link(_bands(spark, sf_dir), 15).select("video_id", "frame", "seq", "particle")


#: Ends of tracks: the latest detection, and those one and two frames before it unless their tracks went on.
_MEMORY = f"""WITH RECURSIVE {_BANDS}, w AS (
  SELECT lane, video_id, frame, seq, y, x, seq AS id, [struct_pack(age := 0, y := y, x := x, id := seq)] AS ends FROM d WHERE frame = 1
  UNION ALL
  SELECT lane, video_id, frame, seq, y, x, coalesce(best.id, seq), list_prepend(struct_pack(age := 0, y := y, x := x, id := coalesce(best.id, seq)),
    list_transform(list_filter(ends, lambda e: e.age < 2 AND (best IS NULL OR e.id <> best.id)), lambda e: struct_pack(age := e.age + 1, y := e.y, x := e.x, id := e.id)))
  FROM (
    SELECT d.*, w.ends, list_sort(list_filter(list_transform(w.ends, lambda e: struct_pack(d2 := (e.y - d.y) * (e.y - d.y) + (e.x - d.x) * (e.x - d.x), y := e.y, x := e.x, age := e.age, id := e.id)), lambda e: e.d2 < 225))[1] AS best
    FROM w JOIN d ON d.lane = w.lane AND d.frame = w.frame + 1
  )
), r AS (SELECT * FROM w), """


@query(_MEMORY + _NUMBERED.format(order="frame, y, x, seq"))
def link_with_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A particle that was lost for up to two frames may be nearer than the latest one."""
    return link(_bands(spark, sf_dir), 15, memory=2).select("video_id", "frame", "seq", "particle")


def _lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a particle in a lane of its own, three pixels further a frame; every fifth frame is missing."""
    track = lens.tracks(spark, sf_dir)
    frame = F.col("frame") + F.floor(F.col("frame") / 5)
    return track.select(F.lit("v").alias("video_id"), frame.cast("int").alias("frame"), F.col("event_id").alias("seq"), (F.col("particle") * 100.0).alias("y"), (frame * 3.0).alias("x"))


_LANES = f"{SQL['ev']}, {SQL['trk']}, d AS (SELECT particle AS lane, frame + frame // 5 AS frame, frame // 5 AS g, event_id FROM trk)"


@query(f"WITH {_LANES}, r AS (SELECT lane, g, min(frame) AS f0, arg_min(event_id, frame) AS e0 FROM d GROUP BY 1, 2), k AS (SELECT lane, g, row_number() OVER (ORDER BY f0, e0) - 1 AS particle FROM r) SELECT event_id, particle FROM d JOIN k USING (lane, g)")
def link_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without memory a lane's track ends at each gap."""
    return link(_lanes(spark, sf_dir), 15).select(F.col("seq").alias("event_id"), "particle")


@query(f"WITH {_LANES}, k AS (SELECT lane, row_number() OVER (ORDER BY min(frame), lane) - 1 AS particle FROM d GROUP BY lane) SELECT event_id, particle FROM d JOIN k USING (lane)")
def link_over_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With memory it is one track."""
    return link(_lanes(spark, sf_dir), 15, memory=2).select(F.col("seq").alias("event_id"), "particle")


@query("SELECT 'v' || CAST(user_id % 16 AS VARCHAR) AS video_id, count(*) AS n FROM events GROUP BY 1")
def linked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linking loses and adds no detection, and no track has two in a frame."""
    return relinked_counts(link(_sparse(spark, sf_dir), 15))


@query(f"WITH {SQL['ev']}, f AS (SELECT user_id, min(event_id) AS first FROM ev GROUP BY user_id), r AS (SELECT user_id, row_number() OVER (ORDER BY first) - 1 AS particle FROM f) SELECT event_id, particle FROM ev JOIN r USING (user_id)")
def relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.relabelled(lens.events(spark, sf_dir).select("event_id", F.col("user_id").alias("particle")), "particle", "event_id").select("event_id", "particle")


@query("SELECT event_id, CAST(user_id AS VARCHAR) || '_run7' AS particle FROM events")
def unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.unique_ids(lens.events(spark, sf_dir).select("event_id", F.col("user_id").alias("particle")), "run7").select("event_id", "particle")


# motion


@query(f"WITH {SQL['ev']}, {SQL['trk']}, s AS (SELECT particle, frame, x * 0.5 AS x, y * 0.5 AS y FROM trk), d AS (SELECT *, coalesce(x - lag(x) OVER w, 0) AS x_step, coalesce(y - lag(y) OVER w, 0) AS y_step FROM s WINDOW w AS (PARTITION BY particle ORDER BY frame)) SELECT particle, frame, {rounded('x_step', 'y_step')}, round(sqrt(x_step * x_step + y_step * y_step), 6) AS steplength FROM d")
def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.steps(lens.tracks(spark, sf_dir), 0.5).select("particle", "frame", *r6("x_step", "y_step", "steplength"))


@query(f"WITH {SQL['ev']}, {SQL['trk']}, d AS (SELECT particle, frame, count(*) OVER (PARTITION BY particle) AS duration FROM trk) SELECT * FROM d WHERE duration >= 60")
def stubs_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.durations(motion.filter_stubs(lens.tracks(spark, sf_dir), 60)).select("particle", "frame", "duration")


_MSD = f"{SQL['ev']}, {SQL['trk']}, m AS (SELECT a.particle, b.frame - a.frame AS lag, CAST(sum(pow(CAST(round(b.x * 100) AS BIGINT) - CAST(round(a.x * 100) AS BIGINT), 2) + pow(CAST(round(b.y * 100) AS BIGINT) - CAST(round(a.y * 100) AS BIGINT), 2)) AS DOUBLE) AS s, count(*) AS n FROM trk a JOIN trk b ON a.particle = b.particle AND b.frame - a.frame BETWEEN 1 AND 10 GROUP BY 1, 2)"


@query(f"WITH {_MSD} SELECT particle, CAST(lag AS INTEGER) AS lag, round(s * 0.0001 / n, 4) AS msd, n FROM m")
def msd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.msd(lens.tracks(spark, sf_dir), 10, scale=100).select("particle", "lag", F.round("msd", 4).alias("msd"), "n")


@query(f"WITH {_MSD} SELECT CAST(lag AS DOUBLE) AS time, particle - particle % 10 AS first, {', '.join(f'round(max(s * 0.0001 / n) FILTER (particle % 10 = {k}), 4) AS p{k}' for k in range(10))} FROM m GROUP BY 1, 2")
def imsd_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All particles, ten to a row."""
    wide = motion.imsd_groups(lens.tracks(spark, sf_dir), 1.0, 1.0, 10, 10, scale=100)
    return wide.select("time", "first", *(F.round(str(k), 4).alias(f"p{k}") for k in range(10)))


@query(f"WITH {_MSD} SELECT CAST(lag AS DOUBLE) AS time, particle, round(s * 0.0001 / n, 4) AS msd FROM m")
def imsd_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All particles, straight from the displacements."""
    return motion.msd(lens.tracks(spark, sf_dir), 10, scale=100).select("time", "particle", F.round("msd", 4).alias("msd"))


@query(f"WITH {SQL['ev']} SELECT user_id AS particle, round(least(5.0, avg((value / 100) * (value / 100)) / (4 * 0.036)), 6) AS d FROM ev GROUP BY user_id")
def diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.tracks(spark, sf_dir).groupBy("particle").agg(F.round(motion.diffusion_constant(F.col("x") / 100, 0.036), 6).alias("d"))


@query(f"WITH {SQL['ev']}, {SQL['trk']} SELECT particle, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(sqrt(var_samp(x) + var_samp(y)), 4) AS spread FROM trk GROUP BY particle")
def track_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.track_spread(lens.tracks(spark, sf_dir)).select("particle", *(F.round(c, 4).alias(c) for c in ("x", "y", "spread")))


@query(f"WITH {SQL['ev']}, {SQL['trk']}, m AS (SELECT particle, avg(x) AS x, avg(y) AS y FROM trk GROUP BY particle), d AS (SELECT a.particle, b.particle AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM m a JOIN m b ON a.particle <> b.particle) SELECT particle, min_by(other, d2) AS nearest_other, round(sqrt(min(d2)), 6) AS distance FROM d WHERE d2 < 25 GROUP BY particle")
def nearest_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = motion.track_spread(lens.tracks(spark, sf_dir))
    found = det.nearest(means, means, 5.0, "particle", "particle", others=True)
    return found.select("particle", F.col("nearest_particle").alias("nearest_other"), *r6("distance"))


@query(f"WITH {SQL['ev']}, {SQL['trk']}, m AS (SELECT particle, avg(x) AS x, avg(y) AS y FROM trk GROUP BY particle), d AS (SELECT a.particle, b.particle AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM m a JOIN m b ON a.particle <> b.particle) SELECT particle, other AS nearest_other, round(sqrt(d2), 6) AS distance, CAST(row_number() OVER (PARTITION BY particle ORDER BY d2, other) - 1 AS INTEGER) AS rank FROM d QUALIFY row_number() OVER (PARTITION BY particle ORDER BY d2, other) <= 3")
def nearest_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest other tracks of each, however far."""
    means = stored(motion.track_spread(lens.tracks(spark, sf_dir)), "means")
    found = det.nearest_k(means, means, 3, "particle", "particle", others=True)
    return found.select("particle", F.col("nearest_particle").alias("nearest_other"), *r6("distance"), "rank")


@query(f"""WITH {SQL['ev']}, {SQL['det']}, p AS (SELECT a.frame, a.seq AS l, b.seq AS r, (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) AS d2 FROM det a JOIN det b ON a.frame = b.frame AND a.seq % 2 = 0 AND b.seq % 2 = 1),
n AS (SELECT * FROM p WHERE d2 < 4), f AS (SELECT frame, l, arg_min(r, row(d2, r)) AS r FROM n GROUP BY ALL), g AS (SELECT frame, r, arg_min(l, row(d2, l)) AS l FROM n GROUP BY ALL)
SELECT frame, l AS left_id, r AS right_id, round(sqrt(d2), 6) AS distance FROM f JOIN g USING (frame, l, r) JOIN n USING (frame, l, r)""")
def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of two engines, those of even and of odd number, that are each other's nearest."""
    found = lens.detections(spark, sf_dir)
    both = det.matched(found.where("seq % 2 = 0"), found.where("seq % 2 = 1"), 2.0)
    return both.select("frame", "left_id", "right_id", *r6("distance"))


@query("WITH r AS (SELECT min(value) AS a, max(value) AS b, count(*) AS n FROM events) SELECT CAST(least(floor((value - a) / ((b - a) / 50)), 49) AS INTEGER) AS bin, count(*) AS count, round(count(*) / (any_value(n) * any_value((b - a) / 50)), 8) AS density FROM events CROSS JOIN r GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.histogram(lens.events(spark, sf_dir), "value", 50).select("bin", "count", F.round("density", 8).alias("density"))


@query("SELECT 'value' AS axis, CAST(least(floor((value - floor(value)) * 10), 9) AS INTEGER) AS bin, count(*) AS count FROM events GROUP BY 2")
def subpixel_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.subpixel_bias(lens.events(spark, sf_dir), 10, "value").select("axis", "bin", "count")


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean, count(*) AS n, min(l_discount) AS low, max(l_discount) AS high, count(*) FILTER (l_tax > 0.04) AS taxed FROM lineitem GROUP BY l_returnflag")
def weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(motion.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("mean"), F.count("*").alias("n"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"), F.count_if(F.col("l_tax") > 0.04).alias("taxed"))


@query("SELECT event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY event_type")
def last_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.last_rows(lens.table(spark, sf_dir, "events").select("event_type", "event_id", "value"), ["event_type"], "event_id")


# relational and scalar


@query("SELECT c_custkey AS key, c_name AS name, 'customer' AS kind, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier', NULL FROM supplier")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lens.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment"))
    b = lens.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").dropDuplicates()


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def ids_left_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = lens.table(spark, sf_dir, "customer").select("c_custkey"), lens.table(spark, sf_dir, "orders")
    return customers.join(orders, customers.c_custkey == orders.o_custkey, "left_anti")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2 + CAST(x AS DOUBLE))), 6) AS total, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS argmax, round(CAST(list_max(embedding) AS DOUBLE), 6) AS top, round(quantile_cont(p, 0.5), 6) AS median FROM (SELECT vec_id, any_value(embedding) AS embedding, NULL AS _, unnest(any_value(embedding)) AS p FROM embeddings GROUP BY vec_id) GROUP BY vec_id, embedding".replace(", NULL AS _", ""))
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """axpy and scaling, sum, argmax, maximum and median of arrays, in the JVM."""
    e = lens.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    axpy = F.zip_with("a", "a", lambda x, y: x * 2 + y)
    ordered = F.array_sort("a")
    n = F.size("a")
    median = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    return e.select("vec_id", F.round(F.aggregate(axpy, F.lit(0.0), lambda s, x: s + x), 6).alias("total"), (F.array_position("a", F.array_max("a")) - 1).cast("int").alias("argmax"), F.round(F.array_max("a"), 6).alias("top"), F.round(median, 6).alias("median"))


# crawled pages


@query(web.EMAIL_SQL)
def page_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.emails(lens.table(spark, sf_dir, "pages"))


@query(web.LINK_SQL)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.links(lens.table(spark, sf_dir, "pages"))


@query(web.HOST_SQL)
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.hosts(lens.table(spark, sf_dir, "pages"))
