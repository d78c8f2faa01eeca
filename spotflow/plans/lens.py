"""The driver's tables seen as frames, tracks and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str, scale: float = 100.0) -> DataFrame:
    """Each embedding as an 8x8 frame, scaled; the label is the video."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return e.select(F.col("label").cast("string").alias("video_id"), F.col("vec_id").cast("int").alias("frame"), F.lit(8).alias("nrows"), F.lit(8).alias("ncols"), F.transform("embedding", lambda p: p.cast("double") * scale).alias("px"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, ts, value and the whole number in props."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as detections: frames of six hours, y = mass = value, x = k."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lit(1704067200)  # 2024-01-01
    return events(spark, sf_dir).select(F.floor(seconds / 21600).cast("bigint").alias("frame"), F.col("event_id").alias("seq"), F.col("value").alias("y"), F.col("k").alias("x"), F.col("value").alias("mass"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tracks: the user is the particle, its n-th event is in frame n, x = value, y = k."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, sf_dir).select(F.col("user_id").alias("particle"), F.row_number().over(w).alias("frame"), F.col("value").alias("x"), F.col("k").alias("y"), "event_id")


#: The same views in SQL, for the queries that check ours.
SQL = {
    "px": "px AS (SELECT CAST(vec_id AS INTEGER) AS frame, CAST(label AS VARCHAR) AS video_id, CAST((i - 1) // 8 AS INTEGER) AS u, CAST((i - 1) % 8 AS INTEGER) AS v, CAST(embedding[i] AS DOUBLE) * 100 AS p FROM embeddings, range(1, 65) t(i))",
    "ev": "ev AS (SELECT event_id, user_id, ts, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)",
    "det": "det AS (SELECT CAST(floor(floor(epoch(ts) - 1704067200) / 21600) AS BIGINT) AS frame, event_id AS seq, value AS y, k AS x, value AS mass FROM ev)",
    "trk": "trk AS (SELECT user_id AS particle, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS frame, value AS x, k AS y, event_id FROM ev)",
}


def band_sql(noise: float, size: int, source: str = "px") -> str:
    """CTEs rowpass, colpass and band (frame, video_id, u, v, p) of an 8x8 band pass."""
    r = size // 2
    weights = ", ".join(f"({d}, exp(-{d * d} / (2.0 * {noise * noise})))" for d in range(-r, r + 1))
    mirrored = lambda c: f"CASE WHEN {c} + d < 0 THEN -({c} + d) - 1 WHEN {c} + d > 7 THEN 15 - ({c} + d) ELSE {c} + d END"
    return f"""ker(d, w) AS (VALUES {weights}), tot AS (SELECT sum(w) AS s FROM ker),
rowpass AS (SELECT a.frame, a.video_id, a.u, a.v, sum(CASE WHEN a.v + d BETWEEN 0 AND 7 THEN w * b.p ELSE 0 END) / any_value(s) AS g, sum(b.p) AS c
  FROM {source} a CROSS JOIN ker CROSS JOIN tot JOIN {source} b ON b.frame = a.frame AND b.u = a.u AND b.v = {mirrored("a.v")} GROUP BY ALL),
band AS (SELECT a.frame, a.video_id, a.u, a.v, greatest(sum(CASE WHEN a.u + d BETWEEN 0 AND 7 THEN w * b.g ELSE 0 END) / any_value(s) - sum(b.c) / {size * size}.0, 0) AS p
  FROM rowpass a CROSS JOIN ker CROSS JOIN tot JOIN rowpass b ON b.frame = a.frame AND b.v = a.v AND b.u = {mirrored("a.u")} GROUP BY ALL)"""


def disc_sql(radius: int) -> str:
    cells = ", ".join(f"({i}, {j})" for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius)
    return f"dsc(i, j) AS (VALUES {cells})"


def centre_sql(radius: int, source: str = "band") -> str:
    return f"""{disc_sql(radius)}, cen AS (SELECT a.frame, a.video_id, a.u, a.v, sum(b.p) AS mass, sum(b.p * i) / nullif(sum(b.p), 0) AS c0, sum(b.p * j) / nullif(sum(b.p), 0) AS c1
  FROM {source} a CROSS JOIN dsc JOIN {source} b ON b.frame = a.frame AND b.u = a.u + i AND b.v = a.v + j
  WHERE a.u BETWEEN {radius} AND {7 - radius} AND a.v BETWEEN {radius} AND {7 - radius} GROUP BY a.frame, a.video_id, a.u, a.v)"""


def maxima_sql(separation: float, source: str = "band") -> str:
    """CTEs rowmax and top: pixels that none in their window exceeds."""
    from ..functions.imaging import window_size

    k = window_size(separation)
    before = int(k / 2 - 0.5)
    span = f"RANGE BETWEEN {before} PRECEDING AND {k - 1 - before} FOLLOWING"
    return f"""rowmax AS (SELECT *, max(p) OVER (PARTITION BY frame, u ORDER BY v {span}) AS m1 FROM {source}),
top AS (SELECT frame, video_id, u, v, p FROM (SELECT *, max(m1) OVER (PARTITION BY frame, v ORDER BY u {span}) AS m2 FROM rowmax) WHERE p >= m2)"""
