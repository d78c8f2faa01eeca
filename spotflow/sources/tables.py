"""Detections and track tables as files, and readers by file extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ets import read_ets
from .tiff import read_tiff

DETECTIONS = "x double, y double, frame int"


def read_frames(spark: SparkSession, path: str, channel: int = 0) -> DataFrame:
    """Frames of one file by its extension: tif, tiff or ets."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if kind in ("tif", "tiff"):
        return read_tiff(spark, path, "*")
    if kind == "ets":
        return read_ets(spark, path, channel, glob="*").drop("channel")
    raise ValueError(f"no reader for files of type {kind!r}")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=DETECTIONS)


def read_mails(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="page_path string, mail string")


def write_results(df: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = ("experiment_type", "replicate")) -> None:
    """One folder for each run; an existing result is replaced."""
    writer = df.write.mode("overwrite").partitionBy(*[c for c in by if c in df.columns])
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


#: What the files of a run's tables are called.
RUN_KINDS = {"tracked": "full_tracked_", "msd": "MSD_"}
TRACE_KINDS = {"tracks": "_dynamic_tracks.csv", "traces": "_dynamic_signal_in_static_positions.csv", "static": "_static_df.csv"}


def write_run(tables: dict[str, DataFrame], save: str, experiment: str, replicate: int | str) -> list[str]:
    """A run's tables (tracked, msd) as CSV folders named by save, experiment and replicate; their paths."""
    paths = []
    for kind, df in tables.items():
        paths.append(f"{save}__{experiment}__{replicate}__{RUN_KINDS[kind]}.csv")
        df.write.mode("overwrite").option("header", True).csv(paths[-1])
    return paths


def gathered_runs(spark: SparkSession, paths: list[str], save: str | None = None) -> dict[str, DataFrame]:
    """The runs' tables together, told apart by their names; with save also written as all_tracked.csv and all_msd.csv."""
    found = {}
    for kind, part in RUN_KINDS.items():
        own = [p for p in paths if part in p.rstrip("/").rsplit("/", 1)[-1]]
        if own:
            found[kind] = merged_results(spark, own, "csv")
            if save:
                found[kind].write.mode("overwrite").option("header", True).csv(f"{save}/all_{kind}.csv")
    return found


def write_traces(found: dict[str, DataFrame], save: str, video: int) -> list[str]:
    """The results of extract_traces for one pair of videos, under the video's counter; their paths."""
    paths = []
    for kind, name in TRACE_KINDS.items():
        paths.append(f"{save}/{video}{name}")
        found[kind].write.mode("overwrite").option("header", True).csv(paths[-1])
    return paths


def merged_results(spark: SparkSession, paths: list[str], kind: str = "parquet") -> DataFrame:
    """All runs under one schema; columns that a run lacks are null."""
    if not paths:
        raise ValueError("no results to merge")
    read = (lambda p: spark.read.csv(p, header=True, inferSchema=False)) if kind == "csv" else spark.read.parquet
    merged = read(paths[0])
    for p in paths[1:]:
        merged = merged.unionByName(read(p), allowMissingColumns=True)
    return merged


def dropped_blank_names(df: DataFrame) -> DataFrame:
    """Without index columns that had no name when a file was written."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c and not c.startswith(("_c", "Unnamed"))])
